"""A lattice of tetrahedra from any dense key: the mesh that queries on plain tables run on.

n rows give m = floor(n ** (1/3)) points a side. Cells are cut into six Kuhn
tetrahedra, so the mesh conforms, every volume is 1/6 and counts have closed
forms. All columns are computed from the row's own key: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_PARTS = 4
#: A table of fewer rows is read as one split or two, from which all cores get a share; larger ones have splits enough.
FEW_ROWS = 4_000_000


def side(n: int) -> int:
    """The largest m with m**3 <= n."""
    m = round(n ** (1 / 3)) if n > 0 else 0
    while m**3 > n:
        m -= 1
    while (m + 1) ** 3 <= n:
        m += 1
    return m


def lattice_vertices(orders: DataFrame, m: int) -> DataFrame:
    """(vid, i, j, k, x, y, z, val, cust, size) from the rows with o_orderkey < m**3.

    m comes as a table of one row: Spark takes a table for as large as its
    compressed file, and this join makes that eight times as much, which its
    rows take in memory. Else millions of vertices pass for few and are broadcast.
    m stands in the join's condition, so it is not left out where only ids are
    asked for: of a row without columns AQE measures no bytes, and of the
    product with any table neither.
    """
    key = F.col("o_orderkey")
    sides = orders.sparkSession.range(m, m + 1).toDF("m")
    base = orders.where(key < m**3).join(F.broadcast(sides), key < F.col("m") * F.col("m") * F.col("m")).select(
        key.alias("vid"),
        (key % F.col("m")).alias("i"),
        (F.expr("o_orderkey div m") % F.col("m")).alias("j"),
        F.expr("o_orderkey div (m * m)").alias("k"),
        F.col("o_totalprice").alias("val"),
        F.col("o_custkey").alias("cust"),
        (F.lit(0.5) + ((key * 7919) % 100) / F.lit(64.0)).alias("size"),
    )
    return base.select("*", *[F.col(a).cast("double").alias(b) for a, b in zip("ijk", "xyz")])


def lattice_tetra(vertices: DataFrame, m: int, n_parts: int = N_PARTS) -> DataFrame:
    """(tid, v0..v3, ref, part, block): part cuts slabs along i, block is 2 x 2 in i and j.

    The six tetra of a cell come by a join with six rows; of an ``explode``
    Spark expects no more rows than go in, and would broadcast all tetra.
    """
    cells = vertices.where((F.col("i") < m - 1) & (F.col("j") < m - 1) & (F.col("k") < m - 1))
    steps, kinds = (1, m, m * m), []
    for a in range(3):
        for b in range(3):
            if a != b:
                kinds.append((len(kinds), *((steps[a], steps[a] + steps[b]) if (b - a) % 3 == 1 else (steps[a] + steps[b], steps[a]))))
    step = lambda n: F.element_at(F.array(*[F.lit(kind[n]).cast("long") for kind in kinds]), F.col("p").cast("int") + 1)
    each = vertices.sparkSession.range(len(kinds)).toDF("p").select("p", step(1).alias("d1"), step(2).alias("d2"))
    cuts = max(1, m - 1)
    slab = F.least(F.floor(F.col("i") * n_parts / cuts), F.lit(n_parts - 1)).cast("int")
    block = (F.floor(F.col("i") * 2 / cuts) * 2 + F.floor(F.col("j") * 2 / cuts)).cast("int")
    cells = cells.select("vid", slab.alias("part"), block.alias("block"), (F.col("cust") % 2).cast("int").alias("ref"))
    return cells.crossJoin(F.broadcast(each)).select(
        (F.col("vid") * 6 + F.col("p")).alias("tid"),
        F.col("vid").alias("v0"),
        (F.col("vid") + F.col("d1")).alias("v1"),
        (F.col("vid") + F.col("d2")).alias("v2"),
        (F.col("vid") + (1 + m + m * m)).alias("v3"),
        "ref",
        "part",
        "block",
    )


def lattice(spark: SparkSession, sf_dir: str, n_parts: int = N_PARTS) -> tuple[DataFrame, DataFrame, int]:
    """(vertices, tetra, m) of the orders table."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = orders.count()
    m = side(n)
    if n <= FEW_ROWS:
        orders = orders.select("o_orderkey", "o_totalprice", "o_custkey").repartition(spark.sparkContext.defaultParallelism)
    vertices = lattice_vertices(orders, m)
    return vertices, lattice_tetra(vertices, m, n_parts), m
