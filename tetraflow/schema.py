"""Tables, tag bits, tolerances and run parameters of a mesh.

A mesh is a set of DataFrames keyed by global ids; a partition is the value of
a column, not a process. Entities hold their corners in scalar columns, so that
every expression stays inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import types as T

_L, _D, _I, _S = T.LongType(), T.DoubleType(), T.IntegerType(), T.StringType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


VERTICES = _table(vid=_L, x=_D, y=_D, z=_D, ref=_I, tag=_I)
TETRA = _table(tid=_L, v0=_L, v1=_L, v2=_L, v3=_L, ref=_I, part=_I, tag=_I)
TRIANGLES = _table(fid=_L, v0=_L, v1=_L, v2=_L, ref=_I, tag=_I)
EDGES = _table(eid=_L, a=_L, b=_L, ref=_I, tag=_I)
QUADS = _table(qid=_L, v0=_L, v1=_L, v2=_L, v3=_L, ref=_I)
PRISMS = _table(pid=_L, v0=_L, v1=_L, v2=_L, v3=_L, v4=_L, v5=_L, ref=_I)
SOLS = _table(kind=_S, name=_S, vid=_L, val=T.ArrayType(_D))
IFACE = _table(kind=_S, part_in=_I, part_out=_I, pos=_L, lid=_L, gid=_L)
NORMALS = _table(vid=_L, nx=_D, ny=_D, nz=_D)
TABLES = {"vertices": VERTICES, "tetra": TETRA, "triangles": TRIANGLES, "edges": EDGES, "quads": QUADS, "prisms": PRISMS, "sols": SOLS, "iface": IFACE, "normals": NORMALS, "tangents": NORMALS}

#: Tag bits; our own values.
REQ, CRN, GEO, REF, NOM, BDY, PARBDY, PARBDYBDY, OLDPARBDY, NOSURF, OVERLAP, OPNBDY = (1 << i for i in range(12))

EPS, EPSD, EPSD2, EPSOK = 1e-6, 1e-30, 1e-200, 1e-15
RIDGE_ANGLE_DEGREES = 45.0

#: Local corner numbers: faces opposite to each corner, outward for a positive tetra; edges; faces of an edge.
FACE_CORNERS = ((1, 2, 3), (0, 3, 2), (0, 1, 3), (0, 2, 1))
EDGE_CORNERS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))

#: Half-open bins of metric edge lengths, the last one open; five bins of quality.
LENGTH_BINS = (0.0, 0.3, 0.6, 0.7071, 0.9, 1.3, 1.4142, 2.0, 5.0)
QUALITY_BINS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
#: Interface weights: exponent and ceiling.
WEIGHT_EXPONENT, WEIGHT_MOST = 28.0, 1e6


class MeshInvalid(ValueError):
    """No conforming mesh can be given."""


class MeshDegraded(UserWarning):
    """The mesh conforms, but an operation on it was not completed."""


#: Read, kept and written, but of kernels and machines that this engine has not: points are neither moved nor swapped, Spark sizes memory.
IDLE = (
    "mesh_size", "metis_ratio", "hausd", "hgradreq", "angle_detection", "noswap", "nomove", "optim", "optim_les",
    "open_boundary", "memory_mb", "debug", "use_required_metric", "local",
)


@dataclass(frozen=True)
class AdaptParams:
    """Run parameters with their defaults; lengths of zero or less are not set."""

    niter: int = 3
    mesh_size: int = 30_000_000
    metis_ratio: int = 82
    ifc_layers: int = 2
    groups_ratio: float = 2.0
    max_groups: int = 100
    max_redistribution_groups: int = 1000
    min_group_elements: int = 6
    imbalance: float = 1.05
    n_parts: int = 4
    api_mode: str = "faces"
    hmin: float = -1.0
    hmax: float = -1.0
    hsiz: float = -1.0
    hausd: float = 0.01
    hgrad: float = 1.3
    hgradreq: float = 2.3
    ls_value: float = 0.0
    angle_detection: bool = True
    angle: float = RIDGE_ANGLE_DEGREES
    optim: bool = False
    optim_les: bool = False
    noinsert: bool = False
    noswap: bool = False
    nomove: bool = False
    nosurf: bool = False
    level_set: bool = False
    lagrangian: int = -1
    open_boundary: bool = False
    snap: bool = False
    nobalance: bool = False
    pure_partitioning: bool = False
    distributed_output: bool = False
    verbose: int = 1
    memory_mb: int = 0
    debug: bool = False
    global_numbering: bool = False
    use_required_metric: bool = False
    local: dict[tuple[str, int], tuple[float, float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.api_mode not in ("faces", "nodes"):
            raise MeshInvalid(f"api_mode {self.api_mode!r} is neither faces nor nodes")
        if self.niter < 0 or self.ifc_layers < 0 or self.n_parts < 1 or self.groups_ratio <= 0:
            raise MeshInvalid("a count or ratio is out of its range")
        if 0 < self.hmax < self.hmin:
            raise MeshInvalid("hmin is larger than hmax")

    def idle(self) -> list[str]:
        """Parameters set to other than their defaults that no operator of this engine acts on."""
        usual = type(self)()
        return [x for x in IDLE if getattr(self, x) != getattr(usual, x)]

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]
