"""A content-addressed store of token ids.

Writing. Each document's ids, with the end id, are cut into chunks where a
rolling hash of the last ids hits a mark, so equal passages become equal
chunks wherever they stand. A chunk is named by its BLAKE2b digest. Texts are
tokenised once; one exchange by digest brings equal chunks together, and
``chunks`` keeps the payload of each once. Its other rows, narrow and without
a payload, say where the chunk stands; from those alone ``recipes`` is made:
one row per document in ascending doc_id order, where it starts, its chunks'
digests and the root of a Merkle tree over them. ``manifest`` carries the tree
on: runs of GROUP documents, recipe files of FILE_DOCS at most, the store; it
has a row for each file, with the roots of the file and the store.

Reading. Every chunk file is read once and each chunk is held against its
name; chunk lengths and CRCs meet the recipes as narrow rows, and a document's
CRC is put together from those of its chunks (CRC-32 is linear). Payloads are
joined to documents only by ``reconstruct``.

File format: Parquet; ``ids`` is little-endian, two bytes an id if the
vocabulary has at most 65536 entries, else four. Skew: a chunk of a third of
all documents is deduplicated in each task before the shuffle and meets its
recipes as one row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tetraflow.llm._shared import shared_dir, slices
from tetraflow.llm._tokens import encoder

END_ID = 0
ROLL, MEAN, LEAST, MOST = 16, 256, 64, 1024
DIGEST_BYTES = 16
TASK_DIGESTS = 1_000_000
#: Documents below a node of the Merkle tree above theirs, and in a recipe file (a thousand such nodes).
GROUP, FILE_DOCS = 4096, 4_000_000
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 2**32, 65536, dtype=np.uint32)


def marks(ids: np.ndarray) -> np.ndarray:
    """Where a chunk may end: after ids at which the hash of the last ROLL ids is a multiple of MEAN."""
    gear = _GEAR[ids & 0xFFFF]
    if ids.itemsize > 2:
        gear = gear + (ids.astype(np.uint32) >> np.uint32(16)) * np.uint32(2654435761)
    roll, width = gear, 1
    while width < ROLL:  # the hash of 2w ids from two of w: the older half shifted
        grown = roll.copy()
        grown[width:] += roll[:-width] * np.uint32(pow(0x9E3779B1, width, 2**32))
        roll, width = grown, 2 * width
    return np.flatnonzero(((roll >> np.uint32(8)) & np.uint32(MEAN - 1)) == 0) + 1


def cuts(ids: np.ndarray, bounds: list[int]) -> list[list[int]]:
    """For each document between two bounds the ends of its chunks, LEAST to MOST ids apart but for the last.

    Documents lie side by side: a hash reaches into the one before only within
    its first ROLL ids, where no chunk may end.
    """
    at, out = marks(ids).tolist(), []
    k = 0
    for start, stop in zip(bounds, bounds[1:]):
        ends, last = [], start
        while k < len(at) and at[k] < stop:
            mark = at[k]
            k += 1
            while mark - last > MOST:
                last += MOST
                ends.append(last)
            if mark - last >= LEAST:
                ends.append(mark)
                last = mark
        while stop - last > MOST:
            last += MOST
            ends.append(last)
        while k < len(at) and at[k] <= stop:
            k += 1
        out.append([*ends, stop] if stop > start else [])
    return out


def cut(ids: np.ndarray) -> list[int]:
    """The ends of one document's chunks."""
    return cuts(ids, [0, len(ids)])[0]


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST_BYTES).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary Merkle tree; an odd node moves up unchanged; leaves and nodes hash apart."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def write(docs: DataFrame, vocabulary: str, end_id: int = END_ID, path: str | None = None) -> str:
    """Write the store of ``docs`` and return its folder.

    Needs doc_id and text; other columns are ignored. Null and empty texts
    hold the end id alone. The order is ascending doc_id, null ids first; rows
    that share a doc_id follow each other in the order of the staging table
    and stay documents of their own. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(vocabulary), TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype=coder.type)
        written: set[bytes] = set()
        for batch in slices(batches, 256):
            encoded = [coder.encode(x) for x in batch.column(1).to_pylist()]
            bounds = np.cumsum([0, *(len(x) + 1 for x in encoded)]).tolist()
            ids = np.concatenate([y for x in encoded for y in (x, end)] or [end])
            flat, size, columns = ids.tobytes(), ids.itemsize, ([], [], [], [], [], [])
            for doc_id, at, ends in zip(batch.column(0).to_pylist(), bounds, cuts(ids, bounds)):
                n = len(ends)
                for stop in ends:
                    payload = flat[at * size : stop * size]
                    name = digest(payload)
                    known = name in written
                    if not known and len(written) < TASK_DIGESTS:
                        written.add(name)
                    columns[3].append(name)
                    columns[4].append(stop - at)
                    columns[5].append(None if known else payload)
                    at = stop
                for values, more in zip(columns, ([doc_id] * n, [row] * n, range(n))):
                    values.extend(more)
                row += 1
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keep the payload of each digest's first row; a digest's rows are all in one exchange partition."""
        met: set[bytes] = set()
        for batch in batches:
            keep = []
            for name, there in zip(batch.column(3).to_pylist(), batch.column(5).is_valid().to_pylist()):
                keep.append(there and name not in met)
                if there:
                    met.add(name)
            ids = pc.if_else(pa.array(keep, pa.bool_()), batch.column(5), pa.scalar(None, batch.schema.field(5).type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], ids], names)

    names = ["doc_id", "row", "seq", "digest", "n_ids", "ids"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    schema = "doc_id long, row long, seq int, digest binary, n_ids int, ids binary"
    cut_up = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenise, schema)
    refs = F.when(F.col("ids").isNull(), F.col("row")).otherwise(0)  # references need not meet their payload, so a hot digest spreads
    cut_up.repartition("digest", refs).mapInArrow(once, schema).write.option("compression", "zstd").parquet(f"{path}/chunks")
    staged = spark.read.schema(schema).parquet(f"{path}/chunks").drop("ids")
    width = _width(vocabulary)

    parts = staged.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "digest"))).alias("c"), F.sum("n_ids").alias("n_tokens"))
    ordered = parts.select("doc_id", "row", "n_tokens", F.col("c.digest").alias("digests"))
    n_files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-staged.where("seq = 0").count() // FILE_DOCS))
    ordered = ordered.repartitionByRange(n_files, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")

    def recipe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, done = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = np.array(batch.column(2).to_pylist(), dtype=np.int64)
            ends = start + np.cumsum(n)
            roots = [merkle(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(n), pa.int32()), pa.array(np.arange(done, done + len(n))), pa.array(ends - n), pa.array(roots, pa.binary())], out)
            start, done = int(ends[-1]) if len(n) else start, done + len(n)

    out = ["doc_id", "row", "n_tokens", "digests", "file", "pos", "start_in_file", "root"]
    ordered.mapInArrow(recipe, "doc_id long, row long, n_tokens long, digests array<binary>, file int, pos long, start_in_file long, root binary").write.option("compression", "zstd").parquet(f"{path}/recipes")

    files = _file_roots(spark.read.parquet(f"{path}/recipes"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per recipe file
    whole = Window.partitionBy()
    files = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("id_bytes", F.lit(width))
    files.withColumn("store_root", _node(F.collect_list(F.struct("file", "root")).over(whole))).coalesce(1).write.parquet(f"{path}/manifest")
    return path


def _node(children: Column) -> Column:
    """The digest of a Merkle node: of its children's roots in their order."""
    return F.sha2(F.concat_ws("", F.transform(F.array_sort(children), lambda s: s["root"])), 256)


def _file_roots(recipes: DataFrame) -> DataFrame:
    """(file, n_tokens, n_docs, root) of the recipe files as they are; no row holds more than GROUP roots, or a file's thousand."""
    leaf = F.struct("pos", F.hex("root").alias("root"))
    runs = recipes.groupBy("file", F.expr(f"pos div {GROUP}").alias("run")).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), _node(F.collect_list(leaf)).alias("root"))
    return runs.groupBy("file").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"), _node(F.collect_list(F.struct("run", "root"))).alias("root"))


def _width(vocabulary: str) -> int:
    return encoder(vocabulary).size


def _times_x(crc: np.ndarray, bits: int) -> np.ndarray:
    """The CRC-32 register advanced by ``bits`` zero bits, for small counts."""
    for _ in range(bits):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crc & np.uint32(1)))
    return crc


def _advance_tables(levels: int) -> list[np.ndarray]:
    """For each k, four byte tables that advance a register by 2**k bytes of zeros."""
    columns = _times_x(np.uint32(1) << np.arange(32, dtype=np.uint32), 8)
    out = []
    for _ in range(levels):
        bits = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)
        tables = np.stack([np.bitwise_xor.reduce(np.where(bits, columns[8 * i : 8 * i + 8], np.uint32(0)), axis=1) for i in range(4)])
        out.append(tables)
        columns = _apply(tables, columns)
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


_ADVANCE: list[np.ndarray] = []


def join_crcs(crcs: np.ndarray, sizes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The CRC-32 of each concatenation from the CRCs and sizes in bytes of its parts; firsts: where each begins."""
    if not _ADVANCE:
        _ADVANCE.extend(_advance_tables(48))
    ends = np.cumsum(sizes)
    stop = np.append(firsts[1:], len(sizes)) - 1
    after = np.repeat(ends[stop], stop - firsts + 1) - ends
    crcs = crcs.astype(np.uint32)
    for k, tables in enumerate(_ADVANCE):
        if not (after >> k).any():
            break
        on = np.flatnonzero(after >> k & 1)
        crcs[on] = _apply(tables, crcs[on])
    return np.bitwise_xor.reduceat(crcs, firsts)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files.

    Raises if a recipe file is missing or its root, documents or tokens differ
    from the manifest, or the files' roots from the store's; in the job, if a
    chunk does not match its name, a recipe names a missing chunk, or a
    document's Merkle root does not match its recipe. Null ids, empty texts
    and repeated rows are documents like others; an empty store gives no rows.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    said = manifest.agg(F.max("id_bytes").alias("width"), F.max("store_root").alias("root"), _node(F.collect_list(F.struct("file", "root"))).alias("own")).first()  # a row for each file
    if said.root is not None and said.root != said.own:
        raise ValueError("the manifest does not match the store's root")
    width = said.width or 4
    stored = np.dtype("<u2" if width == 2 else "<u4")
    found = _file_roots(spark.read.parquet(f"{path}/recipes"))
    met = manifest.alias("s").join(found.alias("f"), "file", "full_outer")
    bad = met.where(~F.expr("coalesce(s.root = f.root and s.n_docs = f.n_docs and s.n_tokens = f.n_tokens, false)")).select("file").first()
    if bad:
        raise ValueError(f"recipe file {bad[0]} does not match the manifest")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest(payload) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                rows.append((name, len(payload) // width, zlib.crc32(np.frombuffer(payload, stored).astype("<u4"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64()))], ["digest", "n", "crc"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            if not batch.num_rows:
                continue
            parts = batch.column(2)
            firsts, flat = np.array(parts.offsets.to_pylist(), dtype=np.int64), parts.values
            flat = flat.slice(firsts[0], firsts[-1] - firsts[0])
            bounds = (firsts - firsts[0]).tolist()
            if flat.field("n").null_count:
                raise ValueError("a recipe names a chunk that the store does not have")
            names, n = flat.field("digest").to_pylist(), flat.field("n").to_numpy(zero_copy_only=False)
            if any(merkle(names[a:b]) != root for a, b, root in zip(bounds, bounds[1:], batch.column(3).to_pylist())):
                raise ValueError("a recipe does not match its Merkle root")
            totals = np.add.reduceat(n, bounds[:-1])
            if totals.tolist() != batch.column(4).to_pylist():
                raise ValueError("a recipe's length does not match its chunks")
            crcs = join_crcs(flat.field("crc").to_numpy(zero_copy_only=False), 4 * n, np.array(bounds[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array(crcs.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    chunks = spark.read.parquet(f"{path}/chunks").where("ids is not null").select("digest", "ids").mapInArrow(check, "digest binary, n long, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    starts = F.broadcast(spark.read.parquet(f"{path}/manifest").select("file", F.col("start").alias("file_start")))  # one row per file
    each = recipes.select("row", F.posexplode("digests").alias("seq", "digest"))
    met = each.join(chunks, "digest", "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "n", "crc"))).alias("parts"))
    heads = recipes.join(starts, "file").select("row", "doc_id", (F.col("start_in_file") + F.col("file_start")).alias("start"), "root", "n_tokens")
    return heads.join(met, "row").select("doc_id", "start", "parts", "root", "n_tokens").mapInArrow(fold, "doc_id long, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) with each document's ids, in bytes as stored, put together again.

    Every document comes once, in no order: null ids, empty texts (the end id
    alone) and repeated rows too. An empty store gives no rows. Nothing is
    checked here; ``verify`` does that.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    starts = F.broadcast(spark.read.parquet(f"{path}/manifest").select("file", F.col("start").alias("file_start")))
    each = recipes.select("row", F.posexplode("digests").alias("seq", "digest")).join(spark.read.parquet(f"{path}/chunks").where("ids is not null").select("digest", "ids"), "digest")
    whole = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("c"))
    ids = F.unhex(F.concat_ws("", F.transform("c.ids", F.hex)))
    return recipes.join(starts, "file").join(whole, "row").select("doc_id", (F.col("start_in_file") + F.col("file_start")).alias("start"), "n_tokens", ids.alias("ids"))
