"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document is the sequence of its lines that hold a word. What must not repeat
is a stretch of ``min_run`` such lines, or one line of ``long_line`` words.

1. Winnowing. Of every window of ``min_run`` lines the line with the least hash
   (the last on ties) is selected; neighbouring windows mostly select the same
   one. A long line is a window of its own. A stretch that repeats has the same
   window, so the same line is selected in both places: no repeat is missed.
2. Positions of selected lines meet on the line's hash. Only hashes that stand
   in several places go on; most lines of a corpus end here, as one narrow row.
3. Matches extend left and right from the selected line over the lines of the
   windows that selected it, compared by two 64-bit hashes of all their lines.
   A window's first place in (doc_id, row, line) order is the original; a
   later one's lines are deleted. Windows of one match overlap, so what is
   deleted reaches as far both ways as the texts agree.

Skew: positions and windows are counted before they are shuffled (partial
aggregation), so a line that a third of all rows share costs each task one
row; no two occurrences are paired, each meets only the original; and the
joins deal by other keys than the groupings, so a hot line's rows are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetraflow.llm._shared import stage, unused

MIN_RUN, LONG_LINE = 2, 5
_BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _numbered(lines: Column, long_line: int | None) -> Column:
    """(at, h, g, long) of each line with a word: its number, two hashes, and whether it is a window of its own."""
    every = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("x"), F.btrim(x, F.lit(_BLANKS)).alias("t")))
    words = lambda t: F.size(F.split(t, r"[\x20\x09-\x0D]+", long_line)) >= long_line if long_line else F.lit(False)
    full = F.filter(every, lambda s: s["t"] != "")
    return F.transform(full, lambda s: F.struct(s["at"].alias("at"), F.xxhash64(s["x"]).alias("h"), F.xxhash64(F.lit(1), s["x"]).alias("g"), words(s["t"]).alias("long")))


def selected(docs: DataFrame, min_run: int = MIN_RUN, long_line: int | None = LONG_LINE) -> DataFrame:
    """(row, doc_id, i, fp, around): each selected line once, the i-th with words of its row, its hash, and the lines that a window of it may hold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row"), _numbered(_lines(F.col("text")), long_line).alias("s"))
    least = lambda i: F.negative(F.array_min(F.transform(F.slice("s", i + 1, min_run), lambda x, k: F.struct(x["h"].alias("h"), F.negative(i + k).alias("at"))))["at"])
    minima = F.when(F.size("s") >= min_run, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("s") - min_run), least)))
    places = F.coalesce(minima, F.array().cast("array<int>"))
    if long_line and min_run > 1:
        places = F.array_union(places, F.filter(F.transform("s", lambda x, i: F.when(x["long"], i)), lambda i: i.isNotNull()))
    each = rows.select("row", "doc_id", "s", F.explode(places).alias("i"))
    first = F.greatest(F.col("i") - (min_run - 1), F.lit(0))
    return each.select("row", "doc_id", "i", F.get("s", F.col("i"))["h"].alias("fp"), F.slice("s", first + 1, F.col("i") - first + min_run).alias("around"))


def _extended(hits: DataFrame, min_run: int, long_line: int | None) -> DataFrame:
    """(row, doc_id, i, win, chk, lines): the windows that hold each selected line, from left of it to right."""
    at = F.least(F.col("i"), F.lit(min_run - 1))  # its place in around

    def window(k: Column, n: int) -> Column:
        w = F.slice("around", k + 1, n)
        return F.struct((F.col("i") - at + k).alias("i"), F.xxhash64(F.transform(w, lambda x: x["h"])).alias("win"), F.xxhash64(F.transform(w, lambda x: x["g"])).alias("chk"), F.transform(w, lambda x: x["at"]).alias("lines"))

    last = F.least(at, F.size("around") - min_run)
    runs = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: window(k, min_run)))
    if long_line and min_run > 1:
        alone = F.when(F.get("around", at)["long"], F.array(window(at, 1)))
        runs = F.concat(*[F.coalesce(x, F.array().cast("array<struct<i: int, win: bigint, chk: bigint, lines: array<int>>>")) for x in (runs, alone)])
    return hits.select("row", "doc_id", F.inline(runs))


def _repeated(places: DataFrame, *key: str) -> DataFrame:
    """(key, first): keys that stand in several places, and the first of these."""
    place = F.struct("doc_id", "row", "i")
    return places.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")


def _met(places: DataFrame, repeated: DataFrame, *key: str) -> DataFrame:
    """``places`` with the repeated keys' columns. Joined by other keys than those grouped by: both sides are dealt anew, so that the join of a very common key can be split."""
    other = {k: F.bitwise_not(k) for k in key}
    return places.withColumns(other).join(repeated.withColumns(other), list(key))


def later_lines(docs: DataFrame, min_run: int = MIN_RUN, long_line: int | None = LONG_LINE) -> DataFrame:
    """(row, gone): for each document with a later repeat, the numbers of the lines to delete."""
    positions = selected(docs, min_run, long_line)
    hits = stage(_met(positions, _repeated(positions, "fp").drop("first"), "fp").drop("fp"), "line-matches")
    windows = _extended(hits, min_run, long_line)
    later = _met(windows, _repeated(windows, "win", "chk"), "win", "chk").where(F.col("first") < F.struct("doc_id", "row", "i"))
    return later.select("row", F.explode("lines").alias("at")).groupBy("row").agg(F.collect_set("at").alias("gone"))


def delete_later_runs(docs: DataFrame, min_run: int = MIN_RUN, long_line: int | None = LONG_LINE, report: str | None = None) -> DataFrame:
    """``docs`` with text replaced by what is left and, if ``report`` names it, a column (n_lines, gone: numbers of the deleted).

    A line goes if it lies in a run of ``min_run`` or more consecutive lines
    with words that stands earlier too, in document order (doc_id, nulls
    first) or within the document, or if it is a line of ``long_line`` words
    that does (with ``long_line`` null only runs count). Wordless lines stand
    between runs for nothing and stay. Null texts stay null; empty ones have
    no line with a word and stay. Rows that repeat doc_id and text are one
    document and get the same result. Lines are compared whole, at any length,
    through two 64-bit hashes. All other columns pass unchanged, whatever
    their names (one called ``report`` is replaced); an empty table stays empty.
    """
    key, gone_at, lines, said = unused(docs, "__row", "__gone", "__lines", report or "__said")
    gone = later_lines(docs, min_run, long_line).toDF(key, gone_at)
    joined = docs.withColumn(key, _row_key()).join(gone, key, "left")
    joined = joined.withColumn(gone_at, F.sort_array(F.coalesce(gone_at, F.array().cast("array<int>")))).withColumn(lines, _lines(F.col("text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_at))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    out = joined.withColumn("text", F.when(F.size(gone_at) > 0, left).otherwise(F.col("text")))
    if report is None:
        return out.select(*docs.columns)
    out = out.withColumn(said, F.struct(F.size(lines).alias("n_lines"), F.col(gone_at).alias("gone")))
    return out.select(*[c for c in docs.columns if c.lower() != report.lower()], F.col(said).alias(report))
