"""Session helper for tests, the benchmark and local runs; a cluster brings its own."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def local_session(name: str, cores: int | str = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared folder that the cluster names in
    ``spark.checkpoint.dir``. Where it is unset, a session that is one local process (tests, the
    benchmark) gets a temporary one; a cluster, whose machines share none, gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="talkmill-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, on whatever file system it is."""
    where, files = _file_system(spark, path)
    files.delete(where, True)


def dir_exists(spark: SparkSession, path: str) -> bool:
    where, files = _file_system(spark, path)
    return files.exists(where)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, hidden ones left out; none if there is no such folder."""
    where, files = _file_system(spark, path)
    if not files.exists(where):
        return []
    return [n for n in (s.getPath().getName() for s in files.listStatus(where)) if n[0] not in "._"]


def read_small_file(spark: SparkSession, path: str) -> str:
    where, files = _file_system(spark, path)
    stream = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def add_small_file(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this content, whole or not at all; False if the name is taken."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    where, files = _file_system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.makeQualified(where).toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(where), options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True
