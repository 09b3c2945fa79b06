"""The corpus pipeline: documents in, encoded documents out. Each stage is written and read again before the next.

Stages keep clean documents with all their columns, whatever the names; texts of any length are handled whole; an empty
table stays empty. What each does with nulls, ties and repeated rows is said with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, decontaminate, langid, linededup, simhash
from vellum.llm.common import Scratch, small_batches, table
from vellum.llm.queries import learned_from, tokenizer_path

#: Words of a shingle in the near-duplicate stage.
WIDTH = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told. Null texts and texts without letters go; repeated rows share one fate."""
    small_batches(spark)
    return langid.keep_known(docs, langid.train(docs, learned_from()))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of repeated three-line windows; n_chars follows the text. All documents stay: a null text stays
    null, a text of repeated lines only becomes empty, rows that repeat both id and text share one fate."""
    small_batches(spark)
    found = linededup.dedup_lines(docs)
    changed = ~F.col("kept").eqNullSafe(F.col("row.text"))
    put = {"text": F.col("kept"), "n_chars": F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))}
    return found.select(*[put.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the least id (null ids last, then the least text hash). Texts
    without words are one group, null texts among them; one of equal rows stays."""
    small_batches(spark)
    return simhash.one_of_each(docs, WIDTH)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. Null and empty texts hold none and stay."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left; the decoded text is checked by its digest. Null text counts as empty; repeated rows each get a row."""
    small_batches(spark)
    coded = bpe.encode_decode(docs, tokenizer_path())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("bpe_encoding", tokens),
]

#: SQL has neither the mixture model, the fingerprints nor the encoder; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
