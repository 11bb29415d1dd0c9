"""Owners and dense global numbers without a single-partition sort.

Two rules of ownership exist side by side: the highest partition that touches
an entity owns it for numbering the mesh, the lowest for interface lists.
Numbers are a rank within a range partition plus the partition's offset; only
the partitions' counts, a row each, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetraflow.staging import measured, staged


def owners(touch: DataFrame, key: tuple[str, ...] = ("vid",), rule: str = "highest") -> DataFrame:
    """(key, owner, n_parts) of entities that partitions touch (part, key)."""
    pick = {"highest": F.max, "lowest": F.min}[rule]
    return touch.groupBy(*key).agg(pick("part").alias("owner"), F.countDistinct("part").alias("n_parts"))


def offsets(counts: DataFrame, by: str, n: str = "n") -> DataFrame:
    """``counts`` (by, n), one row per partition, with offset: the sum over all smaller."""
    before = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum(n).over(before), F.lit(0)))


def number_by_owner(owned: DataFrame, key: tuple[str, ...] = ("vid",), first: int = 1) -> DataFrame:
    """``owned`` (key, owner, ...) with gnum: consecutive, owners in order, keys in order within an owner.

    Range partitions over (owner, key) even out owners of any size.
    """
    return dense_ids(owned, ("owner", *key), first, "gnum")


def global_vertices(touch: DataFrame) -> DataFrame:
    """(part, vid, owner, gnum): every partition's copy of each vertex with its owner (highest) and number."""
    return touch.join(number_by_owner(owners(touch)), "vid").select("part", "vid", "owner", "gnum")


def global_triangles(touch: DataFrame) -> DataFrame:
    """(fid, owner, gnum) of triangles (part, fid, pure): true boundary ones first, then pure interface ones, without an owner.

    pure is true for a triangle that only separates partitions.
    """
    one = touch.groupBy("fid").agg(F.max("part").alias("top"), F.max("pure").alias("pure"))
    return dense_ids(one, ("pure", "top", "fid"), 1, "gnum").select("fid", F.when(~F.col("pure"), F.col("top")).alias("owner"), "gnum")


def interface_node_owners(iface_nodes: DataFrame) -> DataFrame:
    """(gid, owner, gnum): interface nodes, owned by the lowest partition, numbered from 1."""
    touch = iface_nodes.select(F.col("part_in").alias("part"), "gid").distinct()
    return number_by_owner(touch.groupBy("gid").agg(F.min("part").alias("owner")), ("gid",))


def interface_node_counts(iface_nodes: DataFrame) -> DataFrame:
    """(part, n_shared, n_owned): interface nodes a partition sees and owns."""
    owned = interface_node_owners(iface_nodes).groupBy(F.col("owner").alias("part")).agg(F.count("*").alias("n_owned"))
    seen = iface_nodes.groupBy(F.col("part_in").alias("part")).agg(F.countDistinct("gid").alias("n_shared"))
    return seen.join(owned, "part", "left").na.fill(0, ["n_owned"])


def interface_face_owners(iface_faces: DataFrame) -> DataFrame:
    """(f0, f1, f2, owner, other, gnum): interface faces once, owned by the lowest partition, pair by pair."""
    one = iface_faces.where("part_in < part_out").select("f0", "f1", "f2", F.col("part_in").alias("owner"), F.col("part_out").alias("other"))
    return dense_ids(one, ("owner", "other", "f0", "f1", "f2"), 1, "gnum")


def edge_owners(edge_touch: DataFrame) -> DataFrame:
    """(a, b, owner, n_parts): edges by the lowest partition that sees them."""
    return owners(edge_touch, ("a", "b"), "lowest")


def stable_labels(iface_nodes: DataFrame) -> DataFrame:
    """(gid, label, owner): labels that need not be consecutive; the higher partition owns them."""
    return iface_nodes.groupBy("gid").agg(F.max("part_in").alias("owner")).withColumn("label", F.col("gid"))


def dense_ids(keys: DataFrame, order: tuple[str, ...], first: int = 0, name: str = "id") -> DataFrame:
    """``keys`` with dense numbers in the given order, for any number of rows.

    Range partitions are staged once, so their bounds hold; a rank within each
    and the partition's offset make the number. No task sorts the whole table.
    """
    dealt = staged(keys.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "dense")
    starts = F.broadcast(offsets(dealt.groupBy("__p").agg(F.count("*").alias("n")), "__p").select("__p", "offset"))  # a row per partition
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return measured(dealt).withColumn(name, rank).join(starts, "__p").withColumn(name, F.col("offset") + F.col(name) - 1 + first).drop("__p", "offset")


def point_counts(touch: DataFrame) -> DataFrame:
    """(part, n): points counted once over all partitions, each by the highest that touches it."""
    return owners(touch).groupBy(F.col("owner").alias("part")).agg(F.count("*").alias("n"))


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, part, n, offset): rows of each table by partition, and where a partition's rows begin."""
    out = None
    for name, df in tables.items():
        one = offsets(df.groupBy("part").agg(F.count("*").alias("n")), "part").select(F.lit(name).alias("entity"), "part", "n", "offset")
        out = one if out is None else out.unionAll(one)
    return out
