"""Meshes, solutions and interface tables: one file, or one per partition; text, or binary to be read.

A text file is one whitespace-separated token stream of keyword sections. Text is
read in splits, twice: numbers are counted first, so that every split knows in
which section and row it begins, then tokenised in Arrow batches. Binary files
are read whole. Every section becomes rows of (part, section, pos, numbers) that
the tables select from. Both a keyword and its rows may break lines anywhere, a
row may go on in the next split; # starts a comment.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tetraflow import schema as S
from tetraflow.frame import MeshFrame
from tetraflow.staging import discarded, shuffles_dropped, staged

# Section keywords with the numbers in a row of each.
SECTIONS = {
    "Vertices": 4,
    "Edges": 3,
    "Triangles": 4,
    "Quadrilaterals": 5,
    "Tetrahedra": 5,
    "Prisms": 7,
    "Corners": 1,
    "RequiredVertices": 1,
    "RequiredEdges": 1,
    "RequiredTriangles": 1,
    "RequiredTetrahedra": 1,
    "Ridges": 1,
    "ParallelVertices": 1,
    "ParallelEdges": 1,
    "ParallelTriangles": 1,
    "Normals": 3,
    "NormalAtVertices": 2,
    "Tangents": 3,
    "TangentAtVertices": 2,
    "ParallelTriangleCommunicators": 2,
    "ParallelVertexCommunicators": 2,
}
ITEMS = {"ParallelCommunicatorTriangles": "ParallelTriangleCommunicators", "ParallelCommunicatorVertices": "ParallelVertexCommunicators"}
SINGLE = ("MeshVersionFormatted", "Dimension", "NumberOfPartitions")
# The same in binary files, by code.
CODES = {
    3: "Dimension", 4: "Vertices", 5: "Edges", 6: "Triangles", 7: "Quadrilaterals", 8: "Tetrahedra", 9: "Prisms", 12: "RequiredTetrahedra", 13: "Corners", 14: "Ridges",
    15: "RequiredVertices", 16: "RequiredEdges", 17: "RequiredTriangles", 20: "NormalAtVertices", 54: "End", 60: "Normals", 62: "SolAtVertices",
    70: "ParallelTriangleCommunicators", 71: "ParallelVertexCommunicators", 72: "ParallelCommunicatorTriangles", 73: "ParallelCommunicatorVertices", 74: "NumberOfPartitions",
}
# End of fixed values.
#: Sections of real numbers, with how many of a row's are; all others hold integers.
_REALS = {"Vertices": 3, "Normals": 3}
_COMMENT = re.compile(r"#[^\n]*")
#: A keyword; numbers that are written as words are none.
_WORD = re.compile(r"(?<!\S)(?!(?i:nan|inf|infinity)(?!\S))[^\s\d+.-]\S*")
_PART = re.compile(r"\.(\d+)\.(?:mesh|sol)b?$|/part=(\d+)/[^/]*$")
#: Keys that differ in these bits only are packed by the same task.
BLOB_BITS = 16
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_SCHEMA = "part int, section string, pos long, v array<double>"


def _stretches(text: str) -> Iterator[tuple[str, int, int]]:
    """Each keyword of a text without comments, and where the numbers after it begin and end."""
    found = None
    for word in _WORD.finditer(text):
        if found:
            yield found[0], found.end(), word.start()
        found = word
    if found:
        yield found[0], found.end(), len(text)


def _numbers(text: str, word: str) -> np.ndarray:
    """The numbers of a text, parsed without a Python object for each."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error", DeprecationWarning)
            return np.fromstring(text, dtype=np.float64, sep=" ")
    except (DeprecationWarning, ValueError):
        raise S.MeshInvalid(f"section {word} holds what is no number") from None


def _count(numbers: np.ndarray, word: str) -> int:
    if not len(numbers) or not numbers[0] >= 0 or numbers[0] != int(numbers[0]):
        raise S.MeshInvalid(f"section {word} has no count")
    return int(numbers[0])


def tokenise(text: str) -> dict[str, np.ndarray]:
    """Sections of a mesh file by keyword, each a matrix of numbers; unknown ones are passed over."""
    text, out = _COMMENT.sub(" ", text) if "#" in text else text, {}
    for word, start, end in _stretches(text):
        if word == "End":
            break
        if word not in SINGLE and word not in SECTIONS and word not in ITEMS:
            continue
        numbers = _numbers(text[start:end], word)
        if word in SINGLE:
            n, width = 1, 1
        elif word in SECTIONS:
            n, width, numbers = _count(numbers, word), SECTIONS[word], numbers[1:]
        else:
            n, width = int(out.get(ITEMS[word], np.empty((0, 2)))[:, 1].sum()), 3
        if len(numbers) < n * width:
            raise S.MeshInvalid(f"section {word} ends early")
        out[word] = numbers[: n * width].reshape(n, width)
    return out


def tokenise_sol(text: str) -> tuple[list[int], np.ndarray]:
    """(component counts of the solutions, one row of values per vertex)."""
    text = _COMMENT.sub(" ", text) if "#" in text else text
    for word, start, end in _stretches(text):
        if word == "SolAtVertices":
            break
    else:
        raise S.MeshInvalid("the file has no solution at vertices")
    numbers = _numbers(text[start:end], word)
    n, k = _count(numbers, word), _count(numbers[1:], word)
    sizes = [{1: 1, 2: 3, 3: 6}[int(x)] for x in numbers[2 : 2 + k]]
    values = numbers[2 + k : 2 + k + n * sum(sizes)]
    if len(sizes) != k or len(values) != n * sum(sizes):
        raise S.MeshInvalid("the solution ends early")
    return sizes, values.reshape(n, sum(sizes))


class _Bytes:
    """A binary file: numbers in the byte order and widths that its first eight bytes say."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        code = int(np.frombuffer(data, "<i4", 1)[0]) if len(data) >= 8 else 0
        self.order = {1: "<", 1 << 24: ">"}.get(code)
        if self.order is None:
            raise S.MeshInvalid("the file is no binary mesh")
        self.at = 4
        self.version = int(self.take("i4", 1)[0])
        if not 1 <= self.version <= 4:
            raise S.MeshInvalid(f"binary version {self.version} is not known")
        self.real, self.whole, self.place = "f4" if self.version == 1 else "f8", "i8" if self.version == 4 else "i4", "i8" if self.version >= 3 else "i4"

    def take(self, kind: str, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        if self.at + size > len(self.data):
            raise S.MeshInvalid("the binary file ends early")
        out = np.frombuffer(self.data, self.order + kind, n, self.at)
        self.at += size
        return out

    def sections(self) -> Iterator[str]:
        """The names of the known sections, each with the place at its first number."""
        while self.at + 4 <= len(self.data):
            name = CODES.get(int(self.take("i4", 1)[0]))
            after = int(self.take(self.place, 1)[0])
            if name == "End":
                return
            if name:
                yield name
            if after > 0:
                self.at = after
            elif not name:
                return


def unpack(data: bytes) -> dict[str, np.ndarray]:
    """Sections of a binary mesh file by keyword, each a matrix of numbers; unknown ones are passed over."""
    file, out = _Bytes(data), {}
    for name in file.sections():
        if name in SINGLE:
            out[name] = file.take("i4", 1).astype(np.float64).reshape(1, 1)
            continue
        if name in ITEMS:
            n, width = int(out.get(ITEMS[name], np.empty((0, 2)))[:, 1].sum()), 3
        elif name in SECTIONS:
            n, width = int(file.take(file.whole, 1)[0]), SECTIONS[name]
        else:
            continue
        reals = _REALS.get(name, 0)
        row = np.dtype([("r", file.order + file.real, (reals,)), ("i", file.order + file.whole, (width - reals,))])
        if file.at + n * row.itemsize > len(data):
            raise S.MeshInvalid(f"section {name} ends early")
        rows = np.frombuffer(data, row, n, file.at)
        file.at += n * row.itemsize
        out[name] = np.concatenate((rows["r"].astype(np.float64), rows["i"].astype(np.float64)), axis=1)
    return out


def unpack_sol(data: bytes) -> tuple[list[int], np.ndarray]:
    """The same of a binary file as ``tokenise_sol`` has of a text."""
    file = _Bytes(data)
    for name in file.sections():
        if name == "SolAtVertices":
            n, k = int(file.take(file.whole, 1)[0]), int(file.take(file.whole, 1)[0])
            sizes = [{1: 1, 2: 3, 3: 6}[int(t)] for t in file.take(file.whole, k)]
            return sizes, file.take(file.real, n * sum(sizes)).astype(np.float64).reshape(n, sum(sizes))
    raise S.MeshInvalid("the file has no solution at vertices")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(value, path) of each file, whole: text, or bytes where the name ends in b."""
    if _is_binary(path):
        return spark.read.format("binaryFile").load(path).select(F.col("content").alias("value"), "path")
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def _part_of(path: str) -> int:
    found = _PART.search(path)
    return int(found[1] or found[2]) if found else 0


def _rows(part: int, section: str, first: int, rows: np.ndarray, start: int = -1) -> Iterator[pa.RecordBatch]:
    """Rows of a section from number ``first`` on; start: the column of the first number, where a row is not whole."""
    for at in range(0, len(rows), 100_000):
        some = rows[at : at + 100_000]
        n = len(some)
        values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * rows.shape[1]), pa.array(some.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([section] * n), pa.array(np.arange(first + at, first + at + n)), values, pa.array([start] * n, pa.int32())], ["part", "section", "pos", "v", "start"])


def _lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value, path, block): the lines of each file, and where the split begins that holds them."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    """(path, block, text without comments) of lines that follow each other in a split."""
    for batch in batches:
        values, path, block = batch.columns[0], batch.columns[1].to_pylist(), batch.columns[2].to_pylist()
        cuts = [0, *(i for i in range(1, len(path)) if block[i] != block[i - 1] or path[i] != path[i - 1]), len(path)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                text = "\n".join(values.slice(i, j - i).to_pylist())
                yield path[i], block[i], _COMMENT.sub(" ", text) if "#" in text else text


_NUMERALS = b"0123456789+-.eE \t\r\n"
_WORD_OF_E = re.compile(r"(?<!\S)[eE]")


def _segments(text: str) -> Iterator[tuple[str | None, str]]:
    """The numbers before a text's first keyword, without one, and each keyword with the numbers after it."""
    if not text.encode("utf-8", "replace").translate(None, _NUMERALS) and not _WORD_OF_E.search(text):
        yield None, text
        return
    found = [None, *_WORD.finditer(text)]
    for word, after in zip(found, [*found[1:], None]):
        yield word and word[0], text[word.end() if word else 0 : after.start() if after else len(text)]


def _counted(spark: SparkSession, path: str) -> dict[tuple[str, int], list[tuple[str | None, int, float | None]]]:
    """The keywords of each split in order, with how many numbers follow and the first of them; a row for each comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # path, block, k, word, n, first
        for name, block, text in _chunks(batches):
            if held and held[-1][:2] != [name, block]:
                yield given(held)
                held = []
            for word, body in _segments(text):
                if word is not None or not held:
                    if not held and word is not None:
                        held.append([name, block, 0, None, 0, None])
                    held.append([name, block, len(held), word, 0, None])
                numbers = body.split()
                if numbers and held[-1][4] == 0:
                    try:
                        held[-1][5] = float(numbers[0])
                    except ValueError:
                        held[-1][5] = float("nan")
                held[-1][4] += len(numbers)
        if held:
            yield given(held)

    def given(held: list[list]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], ["path", "block", "k", "word", "n", "first"])

    out: dict = {}
    rows = _lines_of(spark, path).mapInArrow(run, "path string, block long, k int, word string, n long, first double").collect()
    for r in sorted(rows, key=lambda r: (r.path, r.block, r.k)):
        out.setdefault((r.path, r.block), []).append((r.word, r.n, r.first))
    return out


def _placed(counted: dict) -> tuple[dict, dict[str, dict[int, int]], set[str]]:
    """(places, numbers of interface items by section and part, sections there are).

    places has for each split and keyword in it (section, numbers of the
    section before, numbers it has in all), or None where nothing is to be
    read; as in ``tokenise`` a keyword that comes again replaces the one before.
    """
    files: dict[str, list[dict]] = {}
    for key in sorted(counted):
        runs = files.setdefault(key[0], [{"word": "", "n": 0, "first": None, "at": []}])
        for i, (word, n, first) in enumerate(counted[key]):
            if word is not None:
                runs.append({"word": word, "n": 0, "first": None, "at": []})
            own = runs[-1]
            own["at"].append((key, i, own["n"]))
            own["first"] = first if own["n"] == 0 and n else own["first"]
            own["n"] += n
    places, items, there = {key: [None] * len(x) for key, x in counted.items()}, {x: {} for x in ITEMS}, set()
    for path, runs in files.items():
        out: dict[str, dict] = {}
        for run in runs:
            word = run["word"]
            if word == "End":
                break
            if word in ITEMS:
                run["all"] = None if ITEMS[word] in out else 0
            elif word in SINGLE or word in SECTIONS:
                run["skip"], numbers = int(word in SECTIONS), np.array([run["first"]] if run["n"] else [])
                run["all"] = _count(numbers, word) * SECTIONS[word] if word in SECTIONS else 1
                if run["n"] - run["skip"] < run["all"]:
                    raise S.MeshInvalid(f"section {word} ends early")
            else:
                continue
            out[word] = run
        there |= out.keys()
        for word, run in out.items():
            if word in ITEMS and run["all"] is None:
                items[word][_part_of(path)] = items[word].get(_part_of(path), 0) + run["n"]
                run["all"] = run["n"] // 3 * 3
            for key, i, at in run["at"]:
                places[key][i] = (word, at - run.get("skip", 0), run["all"])
    return places, items, there


def _read_text(spark: SparkSession, path: str) -> tuple[DataFrame, set[str]]:
    """(sections, staged, and their names) of text files."""
    places, items, there = _placed(_counted(spark, path))
    broken = any(x and x[1] > 0 and x[1] % _width(x[0]) for split in places.values() for x in split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, k, done, left = None, 0, 0, np.empty(0)
        for name, block, text in _chunks(batches):
            if split != (name, block):
                yield from rest(split, k, done, left)
                split, k, done, left = (name, block), -1, 0, np.empty(0)
            for word, body in _segments(text):
                if word is not None or k < 0:
                    yield from rest(split, k, done, left)
                    k, done, left = k + 1, 0, np.empty(0)
                place = places[split][k]
                if place is None:
                    continue
                section, before, total = place
                numbers = _numbers(body, section)
                at = before + done  # of the section's numbers
                done += len(numbers)
                numbers = numbers[max(0, -at) : max(0, total - at)]
                at, width = max(0, at), _width(section)
                if not len(numbers):
                    continue
                if len(left):
                    at, numbers = at - len(left), np.concatenate((left, numbers))
                elif at % width:
                    head = numbers[: width - at % width]
                    yield from _rows(_part_of(name), section, at // width, head[None], at % width)
                    at, numbers = at + len(head), numbers[len(head) :]
                whole = len(numbers) // width * width
                yield from _rows(_part_of(name), section, at // width, numbers[:whole].reshape(-1, width))
                left = numbers[whole:]
        yield from rest(split, k, done, left)

    def rest(split: tuple[str, int] | None, k: int, done: int, left: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What a split has of a row that goes on in the next."""
        if split is not None and len(left):
            section, before, total = places[split][k]
            yield from _rows(_part_of(split[0]), section, (min(before + done, total) - len(left)) // _width(section), left[None], 0)

    out = staged(_lines_of(spark, path).mapInArrow(run, _SCHEMA + ", start int"), "sections")
    columns = ["part", "section", "pos", "v"]
    if broken:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "v"))), lambda x: x["v"])
        out = out.where("start < 0").select(columns).unionByName(out.where("start >= 0").groupBy("part", "section", "pos").agg(F.flatten(parts).alias("v")))
    out = out.select(columns)
    for word, numbers in items.items():
        if numbers:
            rows = out.where(F.col("section") == ITEMS[word]).groupBy("part").agg(F.sum(F.get("v", F.lit(1))).cast("long").alias("n"))
            declared = {r.part: r.n for r in rows.collect()}  # a row for each file
            if any(n < 3 * declared.get(p, 0) for p, n in numbers.items()):
                raise S.MeshInvalid(f"section {word} ends early")
            if any(n // 3 > declared.get(p, 0) for p, n in numbers.items()):
                limits = spark.createDataFrame([(p, declared.get(p, 0)) for p in numbers], "part int, most long")
                out = out.join(F.broadcast(limits), "part", "left").where((F.col("section") != word) | (F.col("pos") < F.col("most"))).select(columns)
    return out, there


def _width(section: str) -> int:
    return SECTIONS.get(section, 3 if section in ITEMS else 1)


def _is_binary(path: str) -> bool:
    return re.search(r"\.(?:mesh|sol)b$", path) is not None


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(part, section, pos, v): all sections of a file, or of all files of a glob like ``name.*.mesh``; of text files staged."""
    if not _is_binary(path):
        return _read_text(spark, path)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for section, rows in unpack(data).items():
                    yield from _rows(_part_of(name), section, 0, rows)

    return _files(spark, path).mapInArrow(run, _SCHEMA + ", start int").drop("start")


def _select(sections: DataFrame, name: str, first: str, columns: dict[str, str]) -> DataFrame:
    rows = sections.where(F.col("section") == name)
    return rows.select("part", (F.col("pos") + 1).alias(first), *[F.get("v", F.lit(i)).cast(t).alias(c) for i, (c, t) in enumerate(columns.items())])


def mesh_tables(sections: DataFrame, there: set[str] | None = None) -> dict[str, DataFrame]:
    """Tables with the file's local ids, from 1, and the part of the file; tags are set from the id lists.

    there: the sections that the files have, where that is known; no table meets a list that no file has.
    """
    ids = lambda name: sections.where(F.col("section") == name).select("part", F.get("v", F.lit(0)).cast("long").alias("id")).distinct()
    corner = lambda n: {f"v{i}": "long" for i in range(n)} | {"ref": "int"}
    shapes = {
        "vertices": ("Vertices", "vid", {"x": "double", "y": "double", "z": "double", "ref": "int"}, {"Corners": S.CRN, "RequiredVertices": S.REQ, "ParallelVertices": S.PARBDY}),
        "tetra": ("Tetrahedra", "tid", corner(4), {"RequiredTetrahedra": S.REQ}),
        "triangles": ("Triangles", "fid", corner(3), {"RequiredTriangles": S.REQ, "ParallelTriangles": S.PARBDY}),
        "edges": ("Edges", "eid", {"a": "long", "b": "long", "ref": "int"}, {"RequiredEdges": S.REQ, "Ridges": S.GEO, "ParallelEdges": S.PARBDY}),
        "quads": ("Quadrilaterals", "qid", corner(4), {}),
        "prisms": ("Prisms", "pid", corner(6), {}),
    }
    out = {}
    for table, (name, key, columns, lists) in shapes.items():
        df = _select(sections, name, key, columns)
        given = {k: bit for k, bit in lists.items() if there is None or k in there}
        if lists and not given:
            df = df.withColumn("tag", F.lit(0))
        if given:
            marks = None
            for section, bit in given.items():
                one = ids(section).withColumn("bit", F.lit(bit))
                marks = one if marks is None else marks.unionAll(one)
            bits = marks.groupBy("part", F.col("id").alias(key)).agg(F.bit_or("bit").alias("tag"))
            df = df.join(bits, ["part", key], "left").withColumn("tag", F.coalesce("tag", F.lit(0)))
        out[table] = df
    for table, name in (("normals", "Normal"), ("tangents", "Tangent")):
        vectors = _select(sections, f"{name}s", "k", {"nx": "double", "ny": "double", "nz": "double"})
        at = _select(sections, f"{name}AtVertices", "row", {"vid": "long", "k": "long"})
        out[table] = at.join(vectors, ["part", "k"]).select("part", "vid", "nx", "ny", "nz")
    out["iface"] = interface_tables(sections)
    return out


def interface_tables(sections: DataFrame) -> DataFrame:
    """(kind, part_in, part_out, pos, lid, gid); faces win over nodes where a part declares both."""
    out = None
    for kind, items, heads in (("face", *next(iter(ITEMS.items()))), ("node", *list(ITEMS.items())[1])):
        head = _select(sections, heads, "k", {"part_out": "int", "n": "long"})
        rows = _select(sections, items, "row", {"lid": "long", "gid": "long", "k": "long"})
        met = rows.withColumn("k", F.col("k") + 1).join(head, ["part", "k"])
        pos = F.row_number().over(Window.partitionBy("part", "k").orderBy("row")) - 1  # of a pair of parts, whatever rows stand between
        one = met.select(F.lit(kind).alias("kind"), F.col("part").alias("part_in"), "part_out", pos.cast("long").alias("pos"), "lid", "gid")
        out = one if out is None else out.unionByName(one.join(out.select("part_in").distinct(), "part_in", "left_anti"))
    return out


def read_mesh(spark: SparkSession, path: str, params: S.AdaptParams | None = None) -> MeshFrame:
    """A mesh of one file, or of one per partition (a glob). Ids are the files'; part tells them apart.

    The files found must be as many as NumberOfPartitions, where it is given.
    Their sections are staged; each table then reads its own.
    """
    binary = _is_binary(path)
    sections, there = (staged(read_sections(spark, path), "sections"), None) if binary else _read_text(spark, path)
    declared = sections.where("section = 'NumberOfPartitions'").agg(F.max(F.get("v", F.lit(0)))).first()[0]
    n_files = len((spark.read.format("binaryFile").load(path) if binary else spark.read.text(path)).inputFiles()) if declared is not None else None
    if declared is not None and int(declared) != n_files:
        raise S.MeshInvalid(f"{n_files} files are there; the mesh has {int(declared)} partitions")
    return MeshFrame(spark, mesh_tables(sections, there), params or S.AdaptParams())


def read_sol(spark: SparkSession, path: str, kind: str = "field", names: tuple[str, ...] = ()) -> DataFrame:
    """(part, kind, name, vid, val): every solution of a file or glob; names default to sol0, sol1 and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sizes, rows = unpack_sol(text) if isinstance(text, bytes) else tokenise_sol(text)
                at = 0
                for i, size in enumerate(sizes):
                    block = np.ascontiguousarray(rows[:, at : at + size])
                    at += size
                    n = len(block)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(block.ravel()))
                    label = names[i] if i < len(names) else f"sol{i}"
                    yield pa.RecordBatch.from_arrays([pa.array([_part_of(name)] * n, pa.int32()), pa.array([kind] * n), pa.array([label] * n), pa.array(np.arange(1, n + 1)), values], ["part", "kind", "name", "vid", "val"])

    return _files(spark, path).mapInArrow(run, "part int, kind string, name string, vid long, val array<double>")


def _lines(df: DataFrame, key: str, columns: list[str], numbers: DataFrame | None = None) -> DataFrame:
    return df.select("part", F.col(key).alias("k"), F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("line"))


def packed(lines: DataFrame) -> DataFrame:
    """(part, s, k, blob): lines (part, s, k, line), sorted and compressed, up to some 10,000 in a blob that has the first one's s and k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, s, k = (batch.columns[i].to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(s) != 0) | (np.diff(k >> BLOB_BITS) != 0)) + 1
            at = np.concatenate(([0], cuts)) if len(part) else cuts
            texts = batch.columns[3]
            blobs = [zlib.compress("\n".join(texts.slice(i, j - i).to_pylist()).encode(), 1) for i, j in zip(at, [*at[1:], len(part)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array(s[at], pa.int32()), pa.array(k[at], pa.int64()), pa.array(blobs, pa.binary())], ["part", "s", "k", "blob"])

    kind = lines.select(F.col("part").cast("int"), F.col("s").cast("int"), F.col("k").cast("long"), "line")
    dealt = kind.repartition("part", "s", F.shiftright("k", BLOB_BITS)).sortWithinPartitions("part", "s", "k")
    return dealt.mapInArrow(run, "part int, s int, k long, blob binary")


def write_packed(blobs: DataFrame, path: str) -> None:
    """Write packed lines in order as text, ``path``/part=<n>/ with a file in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.columns[0].to_pylist(), batch.columns[1]):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.decompress(blob.as_py()).decode()])], ["part", "value"])

    spark = blobs.sparkSession
    ordered = blobs.repartition("part").sortWithinPartitions("part", "s", "k").select("part", "blob")
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, "1000000")  # a file for each part is open; else texts would be sorted by part once more, and lose their order
    try:
        with shuffles_dropped(spark):
            ordered.mapInArrow(run, "part int, value string").write.partitionBy("part").text(path)
    finally:
        if before is None:
            spark.conf.unset(_WRITERS)
        else:
            spark.conf.set(_WRITERS, before)


def write_mesh(mesh: MeshFrame, path: str, part: int | None = None) -> None:
    """Write a mesh as text: ``path`` becomes a folder with a file for each part, part=<n>/.

    Ids must be local to the part and dense from 1, as the format names rows by
    their place. Lines are sorted and packed in blocks by all tasks; the one that
    writes a part puts its blocks in order. Tables are staged first: rows, counts
    and tags are then read, not worked out anew.
    """
    tables, pieces, order = {name: staged(df, f"write-{name}") for name, df in mesh.tables.items()}, [], 0

    def section(title: str, df: DataFrame | None, key: str, columns: list[str], sized: bool = True) -> None:
        nonlocal order
        if df is None:
            return
        order += 1
        df = df if "part" in df.columns else df.withColumn("part", F.lit(part or 0))
        body = _lines(df, key, columns).select("part", F.lit(order).alias("s"), F.col("k"), "line")
        pieces.append(body)
        if sized:
            head = df.groupBy("part").agg(F.count("*").alias("n")).select("part", F.lit(order).alias("s"), F.lit(-1).cast("long").alias("k"), F.concat(F.lit(f"\n{title}\n"), F.col("n")).alias("line"))
            pieces.append(head)

    for title, name, key, columns in (("Vertices", "vertices", "vid", ["x", "y", "z", "ref"]), ("Tetrahedra", "tetra", "tid", ["v0", "v1", "v2", "v3", "ref"]), ("Triangles", "triangles", "fid", ["v0", "v1", "v2", "ref"]), ("Edges", "edges", "eid", ["a", "b", "ref"]), ("Quadrilaterals", "quads", "qid", ["v0", "v1", "v2", "v3", "ref"]), ("Prisms", "prisms", "pid", ["v0", "v1", "v2", "v3", "v4", "v5", "ref"])):
        if name in tables:
            section(title, tables[name].na.fill(0, ["ref"]), key, columns)
    for title, name, key, bit in (("Corners", "vertices", "vid", S.CRN), ("RequiredVertices", "vertices", "vid", S.REQ), ("Ridges", "edges", "eid", S.GEO), ("RequiredEdges", "edges", "eid", S.REQ), ("RequiredTriangles", "triangles", "fid", S.REQ), ("RequiredTetrahedra", "tetra", "tid", S.REQ)):
        if name in tables and "tag" in tables[name].columns:
            section(title, tables[name].where(F.col("tag").bitwiseAND(bit) != 0), key, [key])
    if "iface" in tables:
        for kind, items, heads in (("face", *next(iter(ITEMS.items()))), ("node", *list(ITEMS.items())[1])):
            rows = tables["iface"].where(F.col("kind") == kind).withColumn("part", F.col("part_in"))
            count = rows.groupBy("part", "part_out").agg(F.count("*").alias("n"))
            section(heads, count, "part_out", ["part_out", "n"])
            slot = F.dense_rank().over(Window.partitionBy("part").orderBy("part_out")) - 1
            numbered = rows.withColumn("slot", slot)
            title = rows.select("part").distinct()
            order += 1
            pieces.append(title.select("part", F.lit(order).alias("s"), F.lit(-1).cast("long").alias("k"), F.lit(f"\n{items}").alias("line")))
            pieces.append(numbered.select("part", F.lit(order).alias("s"), "pos", F.concat_ws(" ", "lid", "gid", "slot").alias("line")))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionAll(piece)
    frame = out.select("part").distinct()
    head = frame.select("part", F.lit(0).alias("s"), F.lit(0).cast("long").alias("k"), F.lit("MeshVersionFormatted 2\nDimension 3").alias("line"))
    tail = frame.select("part", F.lit(10_000).alias("s"), F.lit(0).cast("long").alias("k"), F.lit("\nEnd").alias("line"))
    blobs = staged(packed(out.unionAll(head).unionAll(tail)), "blobs")
    for df in tables.values():
        discarded(df)
    write_packed(blobs, path)
    discarded(blobs)


def write_sol(sols: DataFrame, path: str) -> None:
    """Write solutions (part, name, vid, val), all names side by side in name order, a file for each part."""
    sizes = {r.name: r.size for r in sols.groupBy("name").agg(F.max(F.size("val")).alias("size")).orderBy("name").collect()}  # a row per solution
    kinds = " ".join(str({1: 1, 3: 2, 6: 3}[n]) for n in sizes.values())
    merged = sols.groupBy("part", "vid").agg(F.array_sort(F.collect_list(F.struct("name", "val"))).alias("c"))
    rows = merged.select("part", F.col("vid").alias("k"), F.concat_ws(" ", F.transform(F.flatten(F.transform("c", lambda s: s["val"])), lambda x: x.cast("string"))).alias("line"))
    head = merged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.lit(-1).cast("long").alias("k"), F.concat(F.lit("MeshVersionFormatted 2\nDimension 3\n\nSolAtVertices\n"), F.col("n"), F.lit(f"\n{len(sizes)} {kinds}")).alias("line"))
    tail = merged.select("part").distinct().select("part", F.lit(2**62).alias("k"), F.lit("\nEnd").alias("line"))
    rows.unionAll(head).unionAll(tail).repartition("part").sortWithinPartitions("part", "k").select("part", F.col("line").alias("value")).write.partitionBy("part").text(path)


def ranked_name(path: str, part: int) -> str:
    """The name of a partition's file: its number before the extension."""
    stem, dot, extension = path.rpartition(".")
    return f"{stem}.{part}.{extension}" if dot else f"{path}.{part}"


def globalised(mesh: MeshFrame, eps: float = 1e-9) -> MeshFrame:
    """A mesh of several files with one id for each point: corners, triangles, edges and solutions are rewritten, copies within ``eps`` merged."""
    from tetraflow.operators.exchange import merge_by_coordinates, merge_copies

    v = mesh.tables["vertices"]
    ids = merge_by_coordinates(v.select("part", F.col("vid").alias("lid"), "x", "y", "z"), eps).select("part", "lid", "gid")
    tables = dict(mesh.tables)
    moved = v.join(ids.withColumnRenamed("lid", "vid"), ["part", "vid"]).drop("vid").withColumnRenamed("gid", "vid")
    tables["vertices"] = merge_copies(moved, ("vid",))
    for name, key, corners in (("tetra", "tid", 4), ("triangles", "fid", 3)):
        df = tables[name]
        columns = [f"v{i}" for i in range(corners)]
        each = df.select("part", key, F.posexplode(F.array(*columns)).alias("i", "lid")).join(ids, ["part", "lid"])
        new = each.groupBy("part", key).agg(*[F.max(F.when(F.col("i") == i, F.col("gid"))).alias(c) for i, c in enumerate(columns)])
        packed = (F.col("part").cast("long") * F.lit(2**40) + F.col(key)).alias(key)
        tables[name] = df.drop(*columns).join(new, ["part", key]).select(*[packed if c == key else F.col(c) for c in df.columns])
    return MeshFrame(mesh.spark, tables, mesh.params)
