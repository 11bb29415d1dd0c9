"""Consistency checks. Each returns the rows that break a rule: an empty result is a pass."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetraflow.operators.exchange import SAME_PLACE, places
from tetraflow.operators.topology import CORNERS, face_adjacency
from tetraflow.schema import MeshDegraded, MeshInvalid
from tetraflow.staging import shuffles_dropped


def split_nodes(copies: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(gid, spread): ids whose copies (gid, x, y, z) stand at different places."""
    spread = F.greatest(*[F.max(c) - F.min(c) for c in "xyz"])
    return copies.groupBy("gid").agg(spread.alias("spread")).where(F.col("spread") > eps)


def merged_nodes(copies: DataFrame, eps: float = SAME_PLACE) -> DataFrame:
    """(gid, n): places at which several ids stand, by the smallest of them."""
    at = places(copies.select(F.col("gid").cast("long").alias("id"), "x", "y", "z"), eps)
    return at.groupBy(F.col("place").alias("gid")).agg(F.countDistinct("id").alias("n")).where("n > 1")


def crowded_faces(tetra: DataFrame) -> DataFrame:
    """(f0, f1, f2, n): faces of more than two tetra."""
    return face_adjacency(tetra).where("n > 2").select("f0", "f1", "f2", "n")


def unmirrored(iface: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Interface rows whose opposite is missing, or stands there another number of times."""
    here = iface.groupBy("part_in", "part_out", *key).agg(F.count("*").alias("n"))
    there = here.select(F.col("part_in").alias("part_out"), F.col("part_out").alias("part_in"), *key, "n")
    return here.join(there, ["part_in", "part_out", "n", *key], "left_anti")


def dangling(tetra: DataFrame, vertices: DataFrame) -> DataFrame:
    """(tid, vid): corners without a vertex."""
    each = tetra.select("tid", F.explode(F.array(*CORNERS)).alias("vid"))
    return each.join(vertices.select("vid"), "vid", "left_anti").select("tid", "vid")


def inverted(measured: DataFrame) -> DataFrame:
    """(tid, volume): tetra without a positive volume."""
    return measured.where("volume <= 0").select("tid", "volume")


def unused_vertices(tetra: DataFrame, vertices: DataFrame) -> DataFrame:
    used = tetra.select(F.explode(F.array(*CORNERS)).alias("vid"))
    return vertices.select("vid").join(used, "vid", "left_anti")


def differing(declared: DataFrame, read_back: DataFrame) -> DataFrame:
    """Rows of either table that the other has not, or has less often."""
    names = declared.columns
    one = declared.exceptAll(read_back.select(*names)).withColumn("side", F.lit("declared"))
    return one.unionAll(read_back.select(*names).exceptAll(declared).withColumn("side", F.lit("read")))


def counted(spark: SparkSession, found: dict[str, DataFrame]) -> DataFrame:
    """(rule, broken): how many rows each check has found, worked out one after the other; a row per rule."""
    rows = []
    with shuffles_dropped(spark):
        for rule, df in found.items():
            rows.append((rule, df.count()))
    return spark.createDataFrame(rows, "rule string, broken long")


def require_empty(df: DataFrame, what: str, strong: bool = True) -> None:
    """Raise (or, for a low failure, warn) if a check has found a row."""
    if not df.isEmpty():
        if strong:
            raise MeshInvalid(what)
        warnings.warn(what, MeshDegraded, stacklevel=2)
