import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from vellum.llm import suffix


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), kept))
    return out


def corpus(rng):
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    say = lambda n: b" ".join(rng.choice(words) for _ in range(n))
    shared = [say(30) for _ in range(4)]
    texts = [b"".join((say(rng.randint(0, 40)), rng.choice(shared), say(rng.randint(0, 40)))) for _ in range(40)]
    texts += [texts[0], texts[0] + b"x", b"y" + texts[1], b"a" * 300, b"a" * 59, b"a" * 60, b"ab" * 200, b"", "é".encode() * 100, "é".encode() * 90 + b"z"]
    return texts


def test_repeated_matches_brute_force():
    rng = random.Random(3)
    data = np.frombuffer(b"".join(corpus(rng)), dtype=np.uint8)
    starts = np.arange(len(data) - 59)
    whole = Counter(data[i : i + 60].tobytes() for i in starts)
    want = [whole[data[i : i + 60].tobytes()] > 1 for i in starts]
    assert suffix.repeated(data, starts, 60).tolist() == want


@pytest.mark.parametrize(("block", "step", "parts"), [(5000, 60_000, (40, 5, 1)), (100, 90, (40, 5, 1)), (100, 60_000, (7, 1)), (100, 60_000, (1,))])
def test_operator_matches_brute_force(spark, monkeypatch, block, step, parts):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix, "STEP", step)
    monkeypatch.setattr(suffix, "PARTS", parts)
    texts = corpus(random.Random(4))
    docs = spark.createDataFrame([Row(doc_id=i, text=t.decode(), spans=1, m="x") for i, t in enumerate(texts)] + [Row(doc_id=None, text=None, spans=None, m=None)])
    got = docs.select("doc_id", *suffix.text_hashes("text")).join(suffix.remove_repeats(docs, length=60, gram=20), ["t1", "t2"]).collect()
    assert len(got) == len(texts) + 1
    want = brute([*texts, b""], 60)
    for r in got:
        n, removed, spans, kept = want[-1 if r.doc_id is None else r.doc_id]
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == (n, removed, spans, kept), r.doc_id


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix.remove_repeats(docs).count() == 0


def test_query_on_real_rows(spark, data):
    from vellum.llm.queries import op7_suffix_array_dedup

    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text.encode() for r in rows], 200)))
    got = op7_suffix_array_dedup(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_texts_beyond_one_step(spark):
    rng = random.Random(8)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(20_000))
    texts = [long, long[:61_000] + "#" + long[61_000:], "x" + long[70_000:70_250]]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)])
    want = brute([t.encode() for t in texts], 200)
    got = docs.select("doc_id", *suffix.text_hashes("text")).join(suffix.remove_repeats(docs), ["t1", "t2"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == want[r.doc_id]


def test_one_crowded_bucket_is_split(spark, monkeypatch):
    """One passage with other words around it in every text: all its suffixes share few minimizers."""
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 3000)
    rng = random.Random(11)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(190)
    texts = [say(rng.randint(0, 150)) + passage + say(rng.randint(0, 150)) for _ in range(60)]
    texts += [texts[0][:100] + passage + texts[0][290:], "x" + passage + "y" * 30, "z" + passage + "y" * 30, passage + passage]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)])
    want = brute([t.encode() for t in texts], 200)
    got = docs.select("doc_id", *suffix.text_hashes("text")).join(suffix.remove_repeats(docs), ["t1", "t2"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == want[r.doc_id], r.doc_id
