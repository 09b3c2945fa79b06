import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.llm import langid
from vellum.llm.queries import learned_from, op8_language_id


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.train(docs, learned_from())


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op8_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures(spark, model):
    text = {r.lang: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars between 2000 and 2500").collect()}
    mixed = text["de"][:1500] + " " + text["es"][:1500]
    w = dict(zip(model.languages, model.shares([langid.normal(mixed)])[0]))
    assert w["en"] == w["fr"] == 0 and 0.35 < w["de"] < 0.65 and 0.35 < w["es"] < 0.65
    assert (model.shares([langid.normal(text["fr"])])[0] > 0).sum() == 1


def test_em_against_a_plain_loop(model):
    data = langid.normal("the and of that with ist nicht und der die das this is a mixture")
    doc, gram, n = langid.counted([data])
    w, ll = model._fit(doc, gram, n, 1, np.ones((1, len(model.languages)), dtype=np.float32))
    v = np.full(len(model.languages), 1 / len(model.languages))
    for _ in range(langid.ROUNDS):
        r = model.p[gram] * v
        new = ((r / r.sum(axis=1, keepdims=True)) * n[:, None]).sum(axis=0) / n.sum()
        done = np.abs(new - v).max() < langid.CLOSE
        v = new
        if done:
            break
    assert np.allclose(w[0], v, atol=1e-3) and np.isclose(ll[0], (n * np.log((model.p[gram] * v).sum(axis=1))).sum(), rtol=1e-4)


def plain(model, text):
    """Shares of one text by plain loops, double precision: EM for each nested set of languages, the best penalised likelihood wins."""
    data = langid.normal(text)
    if len(data) < 3:
        return None
    codes = [int(c) for c in langid.trigrams(data)]
    p, langs = model.p.astype(np.float64)[codes], len(model.languages)
    cost = langid.PENALTY * np.log(len(codes) + 1)

    def fit(allowed):
        v = np.array(allowed, dtype=np.float64) / sum(allowed)
        for _ in range(langid.ROUNDS):
            r = p * v
            new = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            moved, v = np.abs(new - v).max(), new
            if moved < langid.CLOSE:
                break
        return v, np.log((p * v).sum(axis=1)).sum()

    full, _ = fit([1] * langs)
    order = np.argsort(-full, kind="stable")
    tried = [(np.log(p[:, k]).sum() - cost, np.eye(langs)[k]) for k in range(langs)]
    for k in range(2, langs + 1):
        v, ll = fit([1 if i in order[:k] else 0 for i in range(langs)])
        tried.append((ll - k * cost, v))
    return max(tried, key=lambda x: x[0])[1]


def test_every_text_against_plain_loops(spark, data, model):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    texts = [r.text for r in rows]
    texts += [a[:400] + " " + b[-300:] for a, b in zip(texts[:40], texts[40:80])] + ["12", "", "é", "a b"]
    got = langid.LanguageModel(model.languages, model.p).shares([langid.normal(t) for t in texts])
    mixed = 0
    for t, w in zip(texts, got):
        want = plain(model, t)
        assert (want is None and not w.any()) or np.allclose(w, want, atol=5e-3), t[:80]
        mixed += (w > 0).sum() > 1
    assert mixed > 5
    one = [model.shares([langid.normal(t)])[0] for t in texts[:30]]
    assert np.array_equal(np.array(one), got[:30])  # a batch changes nothing


def test_long_texts_are_counted_whole(monkeypatch, model):
    data = [langid.normal("abc def ghi " * 200), langid.normal("x y")]
    whole = langid.counted(data)
    monkeypatch.setattr(langid, "STEP", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, langid.counted(data)))


def test_edges(spark, model):
    rows = [Row(doc_id=None, text=None, lang=None, score="x"), Row(doc_id=1, text="", lang="en", score="x"), Row(doc_id=1, text="12 %% 34²", lang="en", score="x"), Row(doc_id=2, text="the of and", lang=None, score="x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    got = sorted((r.doc_id or 0, r.lang_pred, r.score > 0) for r in langid.predict(docs, model).collect())
    assert got == [(0, "und", False), (1, "und", False), (1, "und", False), (2, "en", True)]
    assert [r.doc_id for r in langid.keep_known(docs, model).collect()] == [2]
    none = langid.train(docs.limit(0), F.lit(True))
    assert none.languages == [] and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0
