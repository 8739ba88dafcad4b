"""Set-at-a-time transcript analytics on Spark: chunk, embed, retrieve, answer."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
