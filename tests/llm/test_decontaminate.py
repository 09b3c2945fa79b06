import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row

from vellum.llm import decontaminate as D


def brute(text, item):
    """The best weighted Jaccard similarity over all windows of the item's size."""
    a, b = re.findall(r"\w+", text.lower()), re.findall(r"\w+", item.lower())
    if len(a) < 5 or len(b) < 5:
        return 0.0
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    own, best = grams(b), 0.0
    for s in range(max(1, len(a) - len(b) + 1)):
        g = grams(a[s : s + len(b)])
        both = (g & own).total()
        best = max(best, both / (g.total() + own.total() - both))
    return best


def made(rng):
    vocab = [f"w{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(rng.randint(20, 60)) for _ in range(30)] + [["a", "b", "c"], ["x"] * 40]
    docs = []
    for k in range(120):
        words = say(rng.randint(3, 150))
        if k % 2:
            passage = list(rng.choice(items))
            for _ in range(rng.randint(0, 3)):
                passage[rng.randrange(len(passage))] = "edit"
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((k, (" " if k % 3 else "\n").join(w.upper() if k % 5 == 0 else w for w in words) + "."))
    docs += [(200, "x " * 500), (201, " ".join(items[0]) + " " + " ".join(items[1]))]
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 7)
    docs, items = made(random.Random(4))
    want = {(d, i): s for d, t in docs for i, x in items if (s := brute(t, x)) >= 0.8}
    df, bench = spark.createDataFrame([Row(doc_id=d, text=t, item_id=9, distance="x") for d, t in docs]), spark.createDataFrame([Row(item_id=i, text=t) for i, t in items])
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(df, bench).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    clean = {r.doc_id for r in D.keep_clean(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_whole_table_against_brute_force(spark):
    """Every document and item that share a shingle (others can't be alike), all windows compared exactly: nothing is missed."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - 4)}
    items = [(r.item_id, r.text, grams(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i): s for r in docs.collect() for g in [grams(r.text)] for i, t, own in items if g & own and (s := brute(r.text, t)) >= 0.8}
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(docs, bench).collect()}
    assert len(want) > 10 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("few", [46, 0, 10**9])
def test_index_finds_all_within_the_radius(monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    rng = random.Random(2)
    items = D.Items([(i, " ".join(f"w{rng.randrange(50)}" for _ in range(30))) for i in range(300)])
    for _ in range(100):
        fp = rng.choice(items.prints)
        for _ in range(rng.randint(0, 24)):
            fp ^= 1 << rng.randrange(64)
        assert dict(items.near(30, fp)) == {k: d for k, p in enumerate(items.prints) if (d := (p ^ fp).bit_count()) <= D.RADIUS}


def test_edges(spark):
    docs = spark.createDataFrame([Row(doc_id=None, text=None), Row(doc_id=None, text="a b c d e f g"), Row(doc_id=1, text=""), Row(doc_id=2, text="a b c d e f g"), Row(doc_id=2, text="a b c d e f g")], "doc_id bigint, text string")
    bench = spark.createDataFrame([Row(item_id=1, text="A b, c d e f g"), Row(item_id=2, text=None), Row(item_id=3, text="a b"), Row(item_id=None, text="a b c d e f g")], "item_id bigint, text string")
    assert sorted((r.doc_id or 0, r.item_id or 0, r.similarity) for r in D.contaminated(docs, bench).collect()) == [(0, 0, 1.0), (0, 1, 1.0), (2, 0, 1.0), (2, 0, 1.0), (2, 1, 1.0), (2, 1, 1.0)]
    only = bench.where("item_id IS NULL")
    assert D.keep_clean(docs, only).count() == 2 and {r.item_id for r in D.contaminated(docs, only).collect()} == {None}
    same = docs.withColumnRenamed("doc_id", "id"), bench.withColumnRenamed("item_id", "id")
    assert D.contaminated(*same, id_col="id", item_col="id").columns[:2] == ["id", "item"]
    assert D.contaminated(docs.withColumnRenamed("doc_id", "distance"), bench, id_col="distance").columns[:2] == ["id", "item_id"]
    assert D.keep_clean(docs, bench).count() == 2
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.keep_clean(docs, bench.limit(0)).count() == 5
    assert D.contaminated(docs.limit(0), bench).count() == 0
