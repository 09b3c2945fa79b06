import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import xxhash
from pyspark.sql import Row

from vellum.llm.queries import tokenizer_path

from .test_decontaminate import brute as similarity
from .test_line_dedup import brute as without_lines
from .test_simhash import brute_components


def shingles(text):
    words = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in shingles(text)]
    fp = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    return fp - (1 << 64) if fp >> 63 else fp


def exact_pairs(texts):
    """The Jaccard similarity of all pairs that share a shingle."""
    sets, holders = [set(shingles(t)) for t in texts], defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in common.items()}


def groups(texts, ids):
    """The least id of each text's component, linked by fingerprints or by an exact similarity of 0.8."""
    root = brute_components(list(map(fingerprint, texts)), ids)
    for (i, j), s in exact_pairs(texts).items():
        if s >= 0.8 and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def test_run_against_brute_force(spark, data):
    """Each stage again, by plain loops over all rows that share no code with it."""
    from tokenizers import Tokenizer

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    rows = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    kept = without_lines([((d, 0), (d, t)) for d, t in rows])
    rows = [(d, kept[d, 0]) for d, _ in rows]
    rows = [r for r, c in zip(rows, groups([t for _, t in rows], [d for d, _ in rows])) if r[0] == c]
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not any(similarity(t, i) >= 0.8 for i in items)]
    tok = Tokenizer.from_file(tokenizer_path())
    want = {d: (len(ids), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows for ids in [tok.encode(t, add_special_tokens=False).ids]}
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, data).collect()}
    assert got == want


def test_near_duplicate_stage_on_a_whole_table(spark):
    """Recall and precision at 0.8 on the real texts, all pairs compared exactly."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    ids, texts = [d for d, _ in rows], [t for _, t in rows]
    root = groups(texts, ids)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    pairs = [(a, b) for (a, b), s in exact_pairs(texts).items() if s >= 0.8]
    caught = sum(ids[b] not in kept for a, b in pairs)
    assert len(pairs) > 20 and caught >= 0.9 * len(pairs)
    assert kept == {d for d, r in zip(ids, root) if d == r}


def test_stages_keep_the_columns_and_bear_edges(spark, data):
    rows = [Row(doc_id=1, text="the same text of words here", lang="en", source="a", n_chars=27), Row(doc_id=1, text="the same text of words here", lang="en", source="a", n_chars=27), Row(doc_id=2, text="the same text of words here", lang=None, source=None, n_chars=None), Row(doc_id=None, text=None, lang=None, source=None, n_chars=None), Row(doc_id=4, text="", lang="en", source="b", n_chars=0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = docs.selectExpr("*", "1 AS row", "2 AS kept", "3 AS fp", "4 AS id", "5 AS ids", "'x' AS node", "7 AS place", "8 AS i", "9 AS th")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, clash, docs.limit(0)):
            out = stage(spark, df, data)
            assert out.columns == (df.columns if name != "bpe_encoding" else ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]), name
            assert out.count() <= df.count()
    assert corpus_pipeline.tokens(spark, docs, data).count() == 5
    kept = corpus_pipeline.near_duplicates(spark, docs, data).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(1, "the same text of words here"), (4, "")]
    assert len(corpus_pipeline.STAGES) == 5
