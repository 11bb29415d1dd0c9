"""The queries of this subpackage: opN_<name>(spark, sf_dir), whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetraflow.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetraflow.llm.substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), keep_text=False)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tetraflow.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the numbers of those deleted, and the SHA-256 of what is left (null text: empty)."""
    from pyspark.sql import functions as F

    from tetraflow.llm.linededup import delete_later_runs

    left = delete_later_runs(_table(spark, sf_dir, "documents"), report="lines")
    gone = F.col("lines.gone")
    return left.select("doc_id", F.col("lines.n_lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_deleted"), F.array_join(gone.cast("array<string>"), ",").alias("deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tetraflow.llm import store

    return store.verify(spark, store.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetraflow.llm.pii import find_personal

    return find_personal(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetraflow.llm.urls import judge

    return judge(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetraflow.llm.decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetraflow.llm.quality import ledger, passes

    rows = ledger(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes().alias("kept"), "n_lines", "n_upper_words", "n_letterless_words", "failed_bits")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetraflow.llm.html import extract

    return extract(_table(spark, sf_dir, "pages"))


_ALL = (op1_simhash, op2_substring, op3_packing, op4_linededup, op5_token_store, op6_personal_data, op7_url_filter, op8_decontamination, op9_quality, op10_html)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """SimHash, packing, the token store, disguised personal data, the template tree and layout have none: tests hold them against brute force."""
    from tetraflow.llm.oracles import ORACLES

    return dict(ORACLES)
