"""Registered queries over the driver tables, each with its SQL counterpart."""

from talkmill.queries.registry import ORACLES, QUERIES
from talkmill.queries import answers, chunks, flows, retrieval, scalars, tables  # noqa: F401, E402

__all__ = ["ORACLES", "QUERIES"]
