"""Cut lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; one of our own only where it is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tetraflow-"))
    return context.getCheckpointDir().rstrip("/")


#: Shuffle files of a query go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here leave no shuffle files; else they lie on disk until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str = "staged", instead: DataFrame | None = None) -> DataFrame:
    """Write and reread ``df``: later plans start here, and a lost executor repeats nothing above.

    ``instead`` is a staged table that nothing reads from then on; its files go.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if instead is not None:
        discarded(instead)
    return out


def measured(df: DataFrame) -> DataFrame:
    """``df``, a staged table, of which Spark expects several times the bytes of its compressed files.

    Else it broadcasts what takes ten times the threshold in memory. A join
    with one number multiplies by that number's bytes; it stands in the
    condition, so it is not left out.
    """
    one = df.sparkSession.range(1, 2).toDF("__one")
    return df.join(F.broadcast(one), F.col("__one") >= df[df.columns[0]].isNull().cast("long")).select(*df.columns)


def discarded(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads from now on."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
