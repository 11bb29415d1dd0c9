"""Point location: grids of several widths, equi-joins on their cells, an exact test of the candidates.

An element is dealt to the cells that its box meets in the grid whose cells
are the power of two next above its own extent: eight cells at most, however
graded the mesh. A point is looked up once in each grid that has elements.
Only numbers travel with cells; corners meet the hits. Points outside go to
the nearest vertex by rings of cells that widen until one is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetraflow.functions import geometry as G
from tetraflow.operators.topology import FEW_VERTICES, attach_corners
from tetraflow.schema import EPS
from tetraflow.staging import measured, staged


def _corner(i: int) -> G.Vec:
    return tuple(F.col(f"{c}{i}") for c in "xyz")


#: Grids start off the origin by this part of a cell: elements that end on multiples of their extent then meet fewer cells.
SHIFT = 0.37


def _extent(corners: int) -> Column:
    return F.greatest(*[F.greatest(*x) - F.least(*x) for x in ([F.col(f"{c}{i}") for i in range(corners)] for c in "xyz")])


def _leveled(at: DataFrame, corners: int, least: float = 0.0) -> DataFrame:
    """``at`` with level: the power of two of its grid's cells, no less than the extent or ``least``."""
    extent = F.greatest(_extent(corners), F.lit(least), F.lit(2.0**-1000))
    return at.withColumn("level", F.ceil(F.log2(extent)).cast("int"))


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level) + SHIFT)


def _cells(at: DataFrame, key: str, corners: int, margin: Column) -> DataFrame:
    """(key, level, ci, cj, ck): the cells of its grid that each element's box meets."""
    ranges = []
    for c in "xyz":
        values = [F.col(f"{c}{i}") for i in range(corners)]
        ranges.append(F.sequence(_cell(F.least(*values) - margin, F.col("level")), _cell(F.greatest(*values) + margin, F.col("level"))))
    cells = F.flatten(F.transform(ranges[0], lambda i: F.flatten(F.transform(ranges[1], lambda j: F.transform(ranges[2], lambda k: F.struct(i.alias("ci"), j.alias("cj"), k.alias("ck")))))))
    return at.select(key, "level", F.inline(cells))


def _few_or_exchanged(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, n of them: for Spark to broadcast if they are few, else never; it expects no more of an ``explode`` than goes in, and goes by compressed files."""
    return rows if n <= FEW_VERTICES else rows.hint("merge")


def _candidates(points: DataFrame, at: DataFrame, key: str, corners: int, margin: Column) -> DataFrame:
    """(pid, px, py, pz, the columns of ``at``): each point with the elements whose box may hold it."""
    levels = [r.level for r in at.select("level").distinct().collect()]  # exponents of doubles: 2,100 at most
    grids = F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>"))
    asked = points.select("pid", *[F.col(c).alias(f"p{c}") for c in "xyz"], grids.alias("level"))
    asked = asked.select("*", *[_cell(F.col(f"p{c}"), F.col("level")).alias(f"c{n}") for c, n in zip("xyz", "ijk")])
    asked = _few_or_exchanged(asked, points.count() * len(levels))
    hits = asked.join(_cells(at, key, corners, margin), ["level", "ci", "cj", "ck"]).select("pid", "px", "py", "pz", key)
    return hits.join(at.drop("level"), key)


def _own_cell(size: float, prefix: str = "") -> list[Column]:
    return [F.floor(F.col(f"{prefix}{c}") / size).alias(f"c{n}") for c, n in zip("xyz", "ijk")]


def locate(points: DataFrame, tetra: DataFrame, vertices: DataFrame, eps: float = EPS) -> DataFrame:
    """(pid, tid, phi, how, candidates): the tetra that holds each point (pid, x, y, z).

    phi holds the four barycentric coordinates, ``how`` is inside or nearest.
    Points on a shared face go to the smallest tid. A point in no tetra takes
    the nearest vertex, with weight one on it (the smallest tid of its ball).
    """
    at = measured(staged(_leveled(attach_corners(tetra.select("tid", "v0", "v1", "v2", "v3"), vertices), 4), "located-tetra"))
    met = _candidates(points, at, "tid", 4, eps * F.pow(F.lit(2.0), F.col("level")))
    q = (F.col("px"), F.col("py"), F.col("pz"))
    phi = F.array(*G.barycentric([_corner(i) for i in range(4)], q))
    tested = met.select("pid", "tid", phi.alias("phi"))
    inside = F.array_min("phi") > -eps
    hit = F.when(inside, F.struct("tid", "phi"))
    found = tested.groupBy("pid").agg(F.min(hit).alias("hit"), F.count("*").alias("candidates")).where("hit is not null")
    found = staged(found.select("pid", "hit.tid", "hit.phi", F.lit("inside").alias("how"), "candidates"), "located")
    lost = points.join(_few_or_exchanged(found.select("pid"), found.count()), "pid", "left_anti")
    return found.unionByName(_nearest(lost, at))


def _nearest(points: DataFrame, at: DataFrame) -> DataFrame:
    """The nearest vertex of each point, in rings of cells twice as wide each time.

    Rings lie around the place of the mesh's box that is nearest to the point.
    A vertex that no ring has met yet is farther from there than the ring
    reaches, and so from the point by Pythagoras at least; a nearer one is the
    nearest, else the next ring decides. A round with no points left ends it.
    """
    corners = F.explode(F.array(*[F.struct(F.col(f"v{i}").alias("vid"), F.lit(i).alias("corner"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), F.col(f"z{i}").alias("z")) for i in range(4)]))
    each = at.select("tid", corners.alias("c")).select("tid", "c.*")
    vertex = each.groupBy("vid").agg(F.min(F.struct("tid", "corner")).alias("home"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"))
    schema = "pid {}, tid long, phi array<double>, how string, candidates long".format(points.schema["pid"].dataType.simpleString())
    out = points.sparkSession.createDataFrame([], schema)
    left = staged(points.select("pid", "x", "y", "z"), "lost")
    vertex = staged(vertex, "corners") if not left.isEmpty() else vertex
    box = at.agg(F.avg(_extent(4)).alias("size"), *[f(*[g(f"{c}{i}") for i in range(4)]).alias(f"{n}{c}") for n, f, g in (("lo", F.least, F.min), ("hi", F.greatest, F.max)) for c in "xyz"]).first()
    ring = box.size or 1.0
    if box.size is not None:
        left = left.select("*", *[F.greatest(F.lit(box[f"lo{c}"]), F.least(F.lit(box[f"hi{c}"]), F.col(c))).alias(f"q{c}") for c in "xyz"])
    while box.size is not None and not left.isEmpty():
        around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.struct(i.alias("i"), j.alias("j"), k.alias("k"))))))))
        off = sum(((F.col(c) - F.col(f"q{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("qx")) ** 2)
        near = left.select("pid", "x", "y", "z", off.alias("off"), *_own_cell(ring, "q"), around.alias("d")).select("pid", "off", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), *[(F.col(f"c{n}") + F.col(f"d.{n}")).alias(f"c{n}") for n in "ijk"])
        met = near.join(vertex.select("home", "vid", "x", "y", "z", *_own_cell(ring)), ["ci", "cj", "ck"])
        d2 = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 + (F.col("z") - F.col("pz")) ** 2
        best = met.groupBy("pid").agg(F.min(F.struct(d2.alias("d2"), "vid", "home")).alias("b"), F.count("*").alias("candidates"), F.first("off").alias("off"))
        done = staged(best.where(F.col("b.d2") <= F.col("off") + ring * ring), "nearest")
        phi = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i == F.col("b.home.corner")).cast("double"))
        out = out.unionByName(done.select("pid", F.col("b.home.tid").alias("tid"), phi.alias("phi"), F.lit("nearest").alias("how"), "candidates"))
        left = staged(left.join(done.select("pid"), "pid", "left_anti"), "lost")
        ring *= 2.0
        if ring > 1e150:
            break
    return out


def locate_on_surface(points: DataFrame, triangles: DataFrame, vertices: DataFrame, hausd: float) -> DataFrame:
    """(pid, fid, phi, distance): the surface triangle nearest to each point, within ``hausd`` of its box.

    phi are the coordinates of the closest point of the triangle, exact for
    its inside, edges and corners, so no cone or wedge about them is needed.
    """
    met = attach_corners(staged(triangles.select("fid", "v0", "v1", "v2"), "triangles"), vertices, corners=("v0", "v1", "v2"), key="fid")
    at = measured(staged(_leveled(met.select("fid", *[f"{c}{i}" for i in range(3) for c in "xyz"]), 3, hausd), "surface"))
    pairs = _candidates(points, at, "fid", 3, F.lit(hausd))
    p, q = [_corner(i) for i in range(3)], (F.col("px"), F.col("py"), F.col("pz"))
    flat, _ = G.barycentric2d(p, q)
    options = [F.struct(F.array_min(F.array(*flat)).alias("low"), F.array(*flat).alias("phi"))]
    for i, j in ((0, 1), (1, 2), (2, 0)):  # the closest point of each edge
        e, d = G.sub(p[j], p[i]), G.sub(q, p[i])
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(G.dot(e, e) > 0, G.dot(d, e) / G.dot(e, e)).otherwise(0.0)))
        weights = [F.lit(0.0)] * 3
        weights[i], weights[j] = 1.0 - t, t
        options.append(F.struct(F.lit(0.0).alias("low"), F.array(*weights).alias("phi")))

    def distance(phi: Column) -> Column:
        total = None
        for n, c in enumerate("xyz"):
            here = sum((F.get(phi, F.lit(i)) * F.col(f"{c}{i}") for i in range(1, 3)), F.get(phi, F.lit(0)) * F.col(f"{c}0"))
            total = (here - q[n]) ** 2 if total is None else total + (here - q[n]) ** 2
        return total

    valid = F.filter(F.array(*options), lambda o: o["low"] >= 0)
    each = F.transform(valid, lambda o: F.struct(distance(o["phi"]).alias("d2"), o["phi"].alias("phi")))
    best = pairs.select("pid", "fid", F.array_min(each).alias("o")).groupBy("pid").agg(F.min(F.struct("o.d2", "fid", "o.phi")).alias("b"))
    return best.where(F.col("b.d2") <= hausd * hausd).select("pid", "b.fid", "b.phi", F.sqrt("b.d2").alias("distance"))


def border(phi: Column, eps: float = EPS) -> Column:
    """vertex, edge, face or inside: how many of the four coordinates vanish.

    Counted without a lambda, which would have Spark interpret the coordinates' own expressions, once for each outcome.
    """
    small = sum((F.coalesce(F.get(phi, F.lit(i)) < eps, F.lit(False)).cast("int") for i in range(1, 4)), F.coalesce(F.get(phi, F.lit(0)) < eps, F.lit(False)).cast("int"))
    return F.element_at(F.array(*[F.lit(x) for x in ("inside", "face", "edge", "vertex", "vertex")]), small + 1)
