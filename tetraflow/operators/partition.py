"""Partitioning: dual graph and weights, bisection, groups, repair, displacement, balancing.

The partitioner is coordinate bisection over a histogram, level by level, into
any number of parts, and a refinement that moves elements along the dual graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tetraflow.functions import geometry as G
from tetraflow.operators.components import fix_contiguity
from tetraflow.operators.topology import CORNERS, FEW_VERTICES, attach_corners, dual_edges, face_adjacency, interface_faces, part_vertices
from tetraflow.schema import WEIGHT_EXPONENT, WEIGHT_MOST, AdaptParams
from tetraflow.staging import staged

RESOLUTION = 1024


def face_weights(faces: DataFrame, vertices: DataFrame, metric: str | None = "size") -> DataFrame:
    """``faces`` (f0, f1, f2, ...) with weight: heavy where edges are far from unit length; the ceiling without a metric."""
    if metric is None:
        return faces.withColumn("weight", F.lit(WEIGHT_MOST))
    keyed = faces.withColumn("__f", F.struct("f0", "f1", "f2"))
    once = keyed.select("__f", "f0", "f1", "f2").distinct()
    met = attach_corners(once, vertices, ("x", "y", "z", metric), ("f0", "f1", "f2"), "__f")
    p = [tuple(F.col(f"{c}{i}") for c in "xyz") for i in range(3)]
    lengths = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        e = G.sub(p[j], p[i])
        lengths.append(G.scalar_length(F.sqrt(G.dot(e, e)), F.col(f"{metric}{i}"), F.col(f"{metric}{j}")))
    weighed = met.select("f0", "f1", "f2", G.interface_weight(lengths, WEIGHT_EXPONENT, WEIGHT_MOST).alias("weight"))
    return faces.join(weighed, ["f0", "f1", "f2"])


def dual_graph(tetra: DataFrame, vertices: DataFrame | None = None, metric: str | None = None) -> DataFrame:
    """(tid_a, tid_b, weight): the element graph as an edge list; weights are integers of one at least, or all one."""
    pairs = dual_edges(tetra)
    if vertices is None:
        return pairs.select("tid_a", "tid_b", F.lit(1).cast("long").alias("weight"))
    return face_weights(pairs, vertices, metric).select("tid_a", "tid_b", F.greatest(F.lit(1), F.floor("weight")).cast("long").alias("weight"))


def group_graph(tetra: DataFrame, group: str = "part") -> DataFrame:
    """(group_a, group_b, weight): groups that share faces, and how many."""
    cut = interface_faces(tetra, group).where("part_in < part_out")
    return cut.groupBy(F.col("part_in").alias("group_a"), F.col("part_out").alias("group_b")).agg(F.count("*").alias("weight"))


def centres(tetra: DataFrame, vertices: DataFrame) -> DataFrame:
    """(tid, x, y, z) of each tetra's barycentre, times four."""
    met = attach_corners(tetra.select("tid", *CORNERS), vertices)
    return met.select("tid", *[sum((F.col(f"{c}{i}") for i in range(1, 4)), F.col(f"{c}0")).alias(c) for c in "xyz"])


def bisect(points: DataFrame, n_parts: int, key: str = "tid", resolution: int = RESOLUTION) -> DataFrame:
    """(key, part): ``n_parts`` parts, any number, by cutting along x, y, z in turn.

    Each level cuts a group of k parts in one of k // 2 and one of the rest, at
    the fitting share of its points; a group of one part is left. A level bins
    each group's coordinate at ``resolution`` steps of its extent and cuts
    after the first bin up to which that share lies. It costs two aggregations
    to groups x resolution rows at most; no sort, and nothing whose size
    follows the points comes to one task. Groups are numbered by halving, so a
    power of two gets the parts 0 to n - 1 in that order; others are numbered anew.
    """
    if n_parts < 1:
        raise ValueError("a mesh has one part at least")
    state, groups, level = points.select(key, "x", "y", "z").withColumn("part", F.lit(0)), {0: n_parts}, 0
    while any(k > 1 for k in groups.values()):
        axis = "xyz"[level % 3]
        state = staged(state, "bisect")
        share = F.element_at(F.create_map(*[F.lit(x) for g, k in groups.items() for x in (g, (k + 1) // 2 / k)]), F.col("part"))  # an entry per group
        extent = F.broadcast(state.groupBy("part").agg(F.min(axis).alias("lo"), F.max(axis).alias("hi")))  # a row per group
        step = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(axis) - F.col("lo")) * resolution / (F.col("hi") - F.col("lo")))).otherwise(0)
        binned = state.join(extent, "part").withColumn("bin", F.least(step, F.lit(resolution - 1)).cast("int")).drop("lo", "hi")
        counts = binned.groupBy("part", "bin").agg(F.count("*").alias("n"))
        up_to = F.sum("n").over(Window.partitionBy("part").orderBy("bin"))
        total = F.sum("n").over(Window.partitionBy("part"))
        at = counts.withColumn("c", up_to).withColumn("t", total).where(F.col("c") >= share * F.col("t")).groupBy("part").agg(F.min("bin").alias("cut"))
        state = binned.join(F.broadcast(at), "part").withColumn("part", F.col("part") * 2 + (F.col("bin") > F.col("cut")).cast("int")).drop("bin", "cut")
        groups = {2 * g + i: k for g, whole in groups.items() for i, k in enumerate(((whole + 1) // 2, whole // 2)) if k}
        level += 1
    if len(groups) == 2**level:
        return state.select(key, "part")
    names = F.create_map(*[F.lit(x) for i, g in enumerate(sorted(groups)) for x in (g, i)])
    return state.select(key, F.element_at(names, F.col("part")).alias("part"))


def refined(tetra: DataFrame, assigned: DataFrame, n_parts: int, imbalance: float = AdaptParams.imbalance, passes: int = 8) -> DataFrame:
    """(tid, part): ``assigned`` after tetra have moved along the dual graph to parts in which they have more neighbours.

    In a pass a tetra may move to the part of most of its neighbours (the
    smallest on ties) if it gains by it. Of two neighbours that want to move
    only the one with the greater gain does (the smaller tid on ties), so that
    no two undo each other's; and a part takes in no more than ``imbalance``
    times the mean leaves room for. Each pass is kept only if the cut shrinks.
    """
    pairs = staged(dual_edges(tetra).select("tid_a", "tid_b"), "dual")
    both = pairs.unionAll(pairs.select("tid_b", "tid_a")).toDF("tid", "tid_n")
    state = staged(assigned.select("tid", F.col("part").cast("int").alias("part")), "parts")
    most = int(imbalance * state.count() / max(1, n_parts))
    cut = lambda df: pairs.join(df.toDF("tid_a", "p"), "tid_a").join(df.toDF("tid_b", "q"), "tid_b").where("p <> q").count()
    now = cut(state)
    for _ in range(passes):
        seen = both.join(state.toDF("tid_n", "part_n"), "tid_n").groupBy("tid", "part_n").agg(F.count("*").alias("n"))
        votes = seen.join(state, "tid").groupBy("tid", "part").agg(F.max(F.struct("n", (-F.col("part_n")).alias("to"))).alias("best"), F.sum(F.when(F.col("part_n") == F.col("part"), F.col("n")).otherwise(0)).alias("own"))
        wish = staged(votes.select("tid", "part", (-F.col("best.to")).alias("to"), (F.col("best.n") - F.col("own")).alias("gain")).where("gain > 0 and to <> part"), "wishes")
        rank = F.struct("gain", (-F.col("tid")).alias("tid"))
        beside = both.join(wish.select(F.col("tid").alias("tid_n"), rank.alias("other")), "tid_n").groupBy("tid").agg(F.max("other").alias("other"))
        free = wish.join(beside, "tid", "left").where(F.col("other").isNull() | (F.col("other") < rank))
        sizes = F.broadcast(state.groupBy(F.col("part").alias("to")).agg(F.count("*").alias("n")))  # a row per part
        asked = F.broadcast(free.groupBy("to").agg(F.count("*").alias("asked")))  # a row per part
        room = F.greatest(F.lit(0), F.lit(most) - F.col("n")) / F.col("asked")
        taken = free.join(sizes, "to").join(asked, "to").where(F.pmod(F.xxhash64("tid"), F.lit(10_000)) < F.floor(room * 10_000))
        new = staged(state.join(taken.select("tid", "to"), "tid", "left").select("tid", F.coalesce("to", "part").alias("part")), "parts")
        less = cut(new)
        if less >= now:
            break
        state, now = new, less
    return state


def partitioned(tetra: DataFrame, vertices: DataFrame, n_parts: int, imbalance: float = AdaptParams.imbalance) -> DataFrame:
    """(tid, part): bisection by place, then refinement along the dual graph; its cut is no larger than the bisection's."""
    return refined(tetra, bisect(centres(tetra, vertices), n_parts), n_parts, imbalance)


def n_groups(n_elements: int, target: int, params: AdaptParams | None = None, redistribution: bool = False) -> int:
    """How many groups: enough for the target size, within the caps, with the least number of elements in each."""
    p = params or AdaptParams()
    cap = p.max_redistribution_groups if redistribution else p.max_groups
    wanted = max(1, -(-n_elements // max(1, target)))
    return max(1, min(wanted, cap, n_elements // p.min_group_elements or 1))


def repair_empty(assigned: DataFrame, n_parts: int, key: str = "tid") -> DataFrame:
    """(key, part) with one element of the largest part moved to each part that has none."""
    spark = assigned.sparkSession
    counts = assigned.groupBy("part").agg(F.count("*").alias("n"))
    every = spark.range(n_parts).select(F.col("id").cast("int").alias("part"))
    empty = every.join(counts, "part", "left_anti")
    missing = [r.part for r in empty.orderBy("part").collect()]  # at most n_parts
    if not missing:
        return assigned
    largest = counts.orderBy(F.desc("n"), "part").first()
    if largest is None or largest.n <= len(missing):
        raise ValueError("there are not enough elements for the parts")
    taken = assigned.where(F.col("part") == largest.part).orderBy(key).limit(len(missing)).select(key)
    numbered = taken.withColumn("i", F.row_number().over(Window.orderBy(key)) - 1)  # as many rows as parts are empty
    to = numbered.withColumn("to", F.element_at(F.array(*[F.lit(x) for x in missing]), F.col("i") + 1)).drop("i")
    return assigned.join(F.broadcast(to), key, "left").select(key, F.coalesce("to", "part").cast("int").alias("part"))


def split(tetra: DataFrame, vertices: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tetra, vertices, interface faces) by partition: tetra with their part, vertices once for each part that touches them."""
    dealt = tetra.drop("part").join(assigned.select("tid", "part"), "tid")
    own = part_vertices(dealt).join(vertices.drop("part"), "vid")
    return dealt, own, interface_faces(dealt)


def displaced_front(tetra: DataFrame, layers: int = 2, least: int = 6) -> DataFrame:
    """``tetra`` with parts after the interfaces moved by ``layers`` of tetra.

    In each step every vertex takes the smallest part around it by (elements,
    part), so the smaller part wins and grows; a tetra with a vertex that took
    another, smaller part follows it. All vertices move at once, from the
    sizes at the start. A step that would leave a part below
    min(least, n / 2 + 1) elements is undone for that part.
    """
    from pyspark.sql.types import IntegerType

    state = staged(tetra.withColumn("part", F.col("part").cast(IntegerType())), "front")
    counts = state.where("part is not null").groupBy("part").agg(F.count("*").alias("n"))
    # a row per part; the place in the order by (n, part) stands for both and is a plain number, which is hashed and not sorted
    sizes = staged(counts.withColumn("rank", F.row_number().over(Window.orderBy("n", "part"))), "front-sizes")
    for _ in range(layers):
        ranked = state.join(F.broadcast(sizes.select("part", "rank")), "part").select("rank", F.explode(F.array(*CORNERS)).alias("vid"))
        around = ranked.groupBy("vid").agg(F.min("rank").alias("best"), F.max("rank").alias("most"))
        vertex = staged(around.where("best <> most").select("vid", "best"), "front-vertices")
        moved = _followed(state, vertex).join(F.broadcast(sizes.select(F.col("rank").alias("__best"), F.col("part").alias("to"))), "__best", "left").drop("__best")
        moved = moved.withColumn("to", F.when(F.col("part").isNotNull(), F.coalesce("to", "part")))
        left = moved.groupBy("to").agg(F.count("*").alias("m")).withColumnRenamed("to", "part")
        enough = F.least(F.lit(least), F.floor(F.col("n") / 2) + 1)
        frozen = sizes.join(left, "part", "left").where(F.coalesce("m", F.lit(0)) < enough).select("part", F.lit(True).alias("frozen"))
        moved = moved.join(F.broadcast(frozen), "part", "left").withColumn("part", F.when(F.col("frozen"), F.col("part")).otherwise(F.col("to")))
        state = staged(moved.drop("to", "frozen").select(*tetra.columns), "front", instead=state)
    return state


def _followed(state: DataFrame, vertex: DataFrame) -> DataFrame:
    """``state`` with __best: the least ``best`` of its corners in ``vertex`` (vid, best); few of these are broadcast and no tetra is exchanged."""
    if vertex.count() > FEW_VERTICES:
        each = state.select("tid", F.explode(F.array(*CORNERS)).alias("vid"))
        return state.join(each.join(vertex.hint("merge"), "vid").groupBy("tid").agg(F.min("best").alias("__best")), "tid", "left")
    out, names = state, [f"__{c}" for c in CORNERS]
    for corner, name in zip(CORNERS, names):
        out = out.join(F.broadcast(vertex.select(F.col("vid").alias(corner), F.col("best").alias(name))), corner, "left")
    return out.withColumn("__best", F.least(*names)).drop(*names)


def load_balance(tetra: DataFrame, vertices: DataFrame, params: AdaptParams) -> DataFrame:
    """``tetra`` with new parts: displaced interfaces, or a fresh bisection if that leaves the parts out of balance; contiguous."""
    moved = displaced_front(tetra, params.ifc_layers, params.min_group_elements)
    stat = moved.groupBy("part").agg(F.count("*").alias("n")).agg((F.max("n") / F.avg("n")).alias("r"), F.count("*").alias("k")).first()
    if stat.r and stat.r > params.groups_ratio:
        assigned = partitioned(tetra, vertices, stat.k, params.imbalance)
        moved = tetra.drop("part").join(assigned, "tid").select(*tetra.columns)
    return fix_contiguity(moved)


def cut_size(tetra: DataFrame) -> DataFrame:
    """One row on a partition: faces in its interfaces, of all inner faces."""
    inner = face_adjacency(tetra).where("n = 2")
    return inner.agg(F.count("*").alias("n_inner"), F.count_if(F.col("a.part") != F.col("b.part")).alias("n_cut"))
