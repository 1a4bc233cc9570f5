"""Reading inputs and cutting lineage for the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
BATCH = 500  # rows of text sent to Python at once


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a local session has one of its own and a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/fieldloom-{spark.sparkContext.applicationId}"


def long_id(df: DataFrame, id_col: str) -> Column:
    """``id_col`` as a long; ids of another than an integer type are an error."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"column {id_col} must hold integers, not {kind.simpleString()}")
    return F.col(f"`{id_col}`").cast("long")


def small_batches(spark: SparkSession) -> None:
    """From now on, tasks of this session send Python at most ``BATCH`` rows at once; a lower number that is set stays.

    A batch lies in the JVM and in Python several times over, and by default it holds 10,000 whole texts.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run within leaves no shuffle files behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _path_of(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    The written table survives lost executors, and what is read back has no
    lineage behind it. The folder goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = path or _new_path(spark)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    files, where = _path_of(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/fieldloom/{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A :func:`materialise` whose tables go at the end of the block; what is used later has to be written by then."""
    paths: list[str] = []

    def write(df: DataFrame) -> DataFrame:
        paths.append(_new_path(spark))
        return materialise(df, paths[-1])

    try:
        yield write
    finally:
        for path in paths:
            files, where = _path_of(spark, path)
            files.delete(where, True)
            files.cancelDeleteOnExit(where)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
