"""Quality rules as a bitmask ledger.

Every rule is evaluated once, where the text is read. What stays is a narrow
ledger: measurements and one integer whose bit r says that rule r failed.
Policies are versioned masks over those bits, so changing a policy, comparing
two, or asking what each rule costs never reads a text again: ablations group
by the bit pattern (at most 2**rules rows) and work on the counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tetraflow.llm._shared import slices, unused

#: Rules in the order of their bits: name, and when it fails on the ledger's measurements.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_ratio": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 4 * n_lines",
    "shouting": "2 * n_upper_words > n_words",
    "few_letters": "10 * n_letterless_words > 3 * n_words",
    "short_words": "2 * word_chars < 5 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "no_words": "n_words < 1",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BITS["too_few_words"] | BITS["repeated_windows"]
#: Policies by version: a text is kept if it fails no rule of the mask.
POLICIES: dict[str, int] = {"base": BASE, "v1": BASE | BITS["symbol_ratio"] | BITS["duplicate_lines"], "v2": sum(BITS.values()) - BITS["no_words"]}
#: As v2, but short texts stay: of the labelled ones that only too_few_words fails 157 of 161 are good (sf0.1).
POLICIES["v3"] = POLICIES["v2"] - BITS["too_few_words"] + BITS["no_words"]
CURRENT = "v2"

SYMBOLS = "#*$%&|<>"
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_LETTERLESS = re.compile(r"(?<![^\x20\x09-\x0D])[^A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_letterless_words")


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words covered by a window of ``width`` words that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    key = ids[:n]
    for k in range(1, width):
        if (int(key.max()) + 1) * len(seen) >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(seen) + ids[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    depth = np.zeros(len(words) + 1, dtype=np.int32)
    at = np.flatnonzero(hit)
    depth[at] += 1
    depth[at + width] -= 1
    return int((np.cumsum(depth) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The ledger's measurements of one text, in the order of its columns."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _BLANKS))
    lines = [x for x in text.split("\n") if x and x.strip(_BLANKS)]
    upper = sum(map(bytes.isupper, words))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines), upper, len(_LETTERLESS.findall(text)))


def ledger(docs: DataFrame) -> DataFrame:
    """One narrow row for each row of ``docs``: doc_id, measurements, failed_bits.

    Needs doc_id and text; other columns are ignored. Null texts count as
    empty: all measurements zero, too_few_words fails. Repeated rows and null
    ids keep a ledger row each. Whole texts are measured; one text at a time
    is held besides its Arrow batch. An empty table gives an empty ledger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            rows = [measure(x) for x in batch.column(1).to_pylist()]
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * len(_MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_MEASURES])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in _MEASURES)
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return measured.withColumn("failed_bits", failed_bits())


def failed_bits(within: str | None = None) -> Column:
    """The bits of the rules that a row's measurements fail; ``within`` names a struct column that holds them."""
    bits = F.lit(0)
    for name, fails in RULES.items():
        rule = re.sub(r"\b(n_\w+|word_chars)\b", rf"`{within}`.\1", fails) if within else fails
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)))
    return bits


def passes(version: str = CURRENT, bits: str = "failed_bits") -> Column:
    """Whether a ledger row passes the policy."""
    return F.col(bits).bitwiseAND(POLICIES[version]) == 0


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents it fails, those only it rejects, and those kept without it."""
    mask = POLICIES[version]
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    used = [F.struct(F.lit(k).alias("rule"), F.lit(b).alias("bit")) for k, b in BITS.items() if b & mask]
    each = patterns.withColumn("r", F.explode(F.array(*used)))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(count(hit).alias("n_failed"), count(hit & without).alias("n_only_this"), count(without).alias("n_kept_without"))


def keep_good(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass the policy, with all their columns, whatever their names.

    The ledger's measurements and bits ride beside the row, so null and
    repeated ids do no harm and nothing is shuffled. A null text is an empty
    one, which every policy rejects; an empty table stays empty.
    """
    columns = docs.columns
    measured_at, bits_at = unused(docs, "__measures", "__bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            rows = [measure(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * len(_MEASURES)
            measured = pa.StructArray.from_arrays(made, list(_MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], measured], [*columns, measured_at])

    schema = T.StructType([*docs.schema.fields, T.StructField(measured_at, T.StructType([T.StructField(x, T.LongType()) for x in _MEASURES]))])
    measured = docs.select("*", F.col("text").alias(measured_at)).mapInArrow(run, schema)
    return measured.withColumn(bits_at, failed_bits(measured_at)).where(passes(version, bits_at)).select(*columns)
