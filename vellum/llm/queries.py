"""The registered queries of this subpackage: each applies an operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import bpe, decontaminate, html, langid, licences, linededup, pii, search, simhash, suffix
from .common import small_batches, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def fold() -> Column:
    """The remainder that deals documents into five folds; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


def learned_from() -> Column:
    return F.coalesce(fold() != 0, F.lit(False))


#: Production takes the key from its secret store; this one makes results comparable.
PII_KEY = "public test key"


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(tables.table(spark, sf_dir, "documents"), PII_KEY)


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 asks; all documents answer."""
    small_batches(spark)
    return search.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    count = lambda c: F.regexp_count(c, F.lit("\n")) + F.when(c == "", 0).otherwise(1)
    before, after = count(F.col("row.text")), count(F.col("kept"))
    return found.select("row.doc_id", before.cast("long").alias("n_lines"), (before - after).cast("long").alias("n_removed"), F.col("kept").alias("text"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = licences.train(licences.sampled_paragraphs(docs))
    return licences.scan(docs, model).withColumn("families", F.array_join("families", ","))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    texts = suffix.remove_repeats(docs).select("t1", "t2", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", *suffix.text_hashes("text")).join(texts, ["t1", "t2"]).drop("t1", "t2")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs, learned_from()))
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", F.to_json("shares").alias("shares"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_encode_decode": op1_bpe_encode_decode,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_topk_search": op3_topk_search,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_licence_scan": op6_licence_scan,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_language_id": op8_language_id,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_html_extraction": op10_html_extraction,
}
_WINDOWS = "SELECT doc_id, h, i, w FROM (SELECT doc_id, md5(text) AS h, l, unnest(range(1, len(l) - 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)) t, LATERAL (SELECT l[i] || chr(10) || l[i+1] || chr(10) || l[i+2] AS w) WHERE trim(l[i] || l[i+1] || l[i+2]) <> ''"
ORACLES: dict[str, str] = {
    "op4_line_dedup": f"""WITH w AS MATERIALIZED ({_WINDOWS}), r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM w),
    gone AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents)
    SELECT l.doc_id, CASE WHEN count(*) = 1 AND max(line) = '' THEN 0 ELSE count(*) END::BIGINT AS n_lines, (CASE WHEN count(*) = 1 AND max(line) = '' THEN 0 ELSE count(*) END - CASE WHEN count(*) FILTER (g.p IS NULL) = 1 AND max(line) FILTER (g.p IS NULL) = '' THEN 0 ELSE count(*) FILTER (g.p IS NULL) END)::BIGINT AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY l.p) FILTER (g.p IS NULL), '') AS text FROM l LEFT JOIN gone g USING (doc_id, p) GROUP BY l.doc_id""",
}
