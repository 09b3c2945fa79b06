import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from vellum.llm import simhash, sketches
from vellum.llm.common import Scratch
from vellum.llm.components import components


def sketch(text, width=5):
    m = sketches.Minima()
    simhash.fingerprint(text, width, m)
    return m.sketch()


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def far(a, b):
    return int(np.bitwise_count(np.array(a).view(np.uint64) ^ np.array(b).view(np.uint64)).sum())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.getrandbits(40)}"
    return words


def corpus(seed, groups, size, edits):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(3000)}" for _ in range(300)]
        out += [" ".join(edited(rng, base, rng.randint(0, edits))) for _ in range(size)]
    return out


def test_distance_follows_jaccard():
    texts = corpus(1, 6, 6, 12)
    made = [sketch(t) for t in texts]
    off = [2 * far(made[i][0], made[j][0]) / sketches.BITS - (1 - jaccard(texts[i], texts[j])) for i in range(len(texts)) for j in range(i)]
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06
    assert sketch(" ".join(texts[0].split()) + " ") == sketch(texts[0].upper().lower())


def test_a_bit_at_a_time():
    """The sketch of a text by plain loops, and in steps of seven shingles."""
    text = corpus(2, 1, 1, 0)[0]
    hashes = [xxhash.xxh64_intdigest(" ".join(s), seed=42) for s in shingles(text)]
    times, plus = sketches._hashes()
    least = [min((int(a) * ((h ^ h >> 32) & 0xFFFFFFFF) + int(b)) & 0xFFFFFFFF for h in hashes) for a, b in zip(times, plus)]
    bits = [(m * 0x9E3779B1 & 0xFFFFFFFF) >> 31 for m in least]
    wide, runs = sketch(text)
    assert [wide[i // 64] >> i % 64 & 1 for i in range(sketches.BITS)] == bits
    assert len(runs) == sketches.RUNS * sketches.RUN


@pytest.mark.parametrize(("shared", "block"), [(24, 2048), (3, 8)])
def test_links_connect_what_the_distance_connects(spark, monkeypatch, shared, block):
    monkeypatch.setattr(sketches, "SHARED", shared)
    monkeypatch.setattr(sketches, "BLOCK", block)
    texts = corpus(3, 5, 30, 10) + corpus(4, 40, 2, 6)
    made = [sketch(t) for t in texts]
    root = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            if far(made[i][0], made[j][0]) <= sketches.FAR and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    scratch = Scratch(spark, "test")
    rows = scratch.write(spark.createDataFrame([Row(node=k, wide=w, runs=bytes(r)) for k, (w, r) in enumerate(made)], "node bigint, wide array<bigint>, runs binary"), "rows")
    got = {r.node: r.root for r in components(scratch, sketches.links(scratch, rows)).collect()}
    assert [got.get(k, k) for k in range(len(made))] == root


def test_the_operator_keeps_one_of_each_at_the_threshold(spark):
    rng = random.Random(9)
    rows = []
    for g in range(150):
        base = [f"g{g}w{rng.randrange(3000)}" for _ in range(400)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(edited(rng, base, rng.randint(0, 16))))]
    rows += [(1000, None), (1001, ""), (None, " "), (1002, "one two"), (1003, "One two"), (1004, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS fp", "2 AS node", "3 AS wide")
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    texts = dict(rows)
    for g in range(150):
        s = jaccard(texts[2 * g], texts[2 * g + 1])
        assert 2 * g in kept
        if s >= 0.88:
            assert 2 * g + 1 not in kept, s
        if s < 0.72:
            assert 2 * g + 1 in kept, s
    assert kept >= {1000, 1002, 1004} and not kept & {1001, 1003, None}
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def near_pairs(seed, pairs):
    """Pairs whose exact similarity lies from 0.77 to 0.85."""
    rng, out = random.Random(seed), []
    while len(out) < pairs:
        base = [f"p{len(out)}w{rng.randrange(3000)}" for _ in range(400)]
        two = " ".join(base), " ".join(edited(rng, base, rng.randint(6, 11)))
        if 0.77 <= jaccard(*two) <= 0.85:
            out.append(two)
    return out


def test_the_sets_decide_near_the_threshold(spark):
    pairs = near_pairs(11, 150)
    docs = spark.createDataFrame([(2 * g + k, t) for g, two in enumerate(pairs) for k, t in enumerate(two)], "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert [2 * g + 1 not in kept for g in range(len(pairs))] == [jaccard(*two) >= 0.8 for two in pairs]


@pytest.mark.parametrize(("shared", "block"), [(24, 2048), (3, 8)])
def test_components_are_those_of_the_exact_similarity(spark, monkeypatch, shared, block):
    monkeypatch.setattr(sketches, "SHARED", shared)
    monkeypatch.setattr(sketches, "BLOCK", block)
    texts = corpus(5, 4, 30, 14)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    scratch = Scratch(spark, "test")
    made = [Row(node=k, wide=w, runs=bytes(r)) for k, (w, r) in enumerate(map(sketch, texts))]
    rows = scratch.write(spark.createDataFrame(made, "node bigint, wide array<bigint>, runs binary"), "rows")
    sets = simhash.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "node bigint, text string"), 5)
    found = sketches.links(scratch, rows, lambda asked: sets.join(asked, "node"))
    got = {r.node: r.root for r in components(scratch, found).collect()}
    assert [got.get(k, k) for k in range(len(texts))] == root


def test_nothing_goes_through_the_driver(spark, monkeypatch):
    """Sketches and their exploded runs look far smaller to Spark than they are; none may be broadcast."""
    monkeypatch.setattr(simhash, "SHARED", 2)
    monkeypatch.setattr(sketches, "SHARED", 4)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10485760", "10MB")
    long = [f"w{i}" for i in range(300)]
    texts = [" ".join(long + [f"x{k}"]) for k in range(12)] + [" ".join([*long[:280], "y", "z"]), "other words in here", "other words in here", None]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plans, write = [], Scratch.write

    def recorded(self, df, name, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name, **options)

    monkeypatch.setattr(Scratch, "write", recorded)
    kept = simhash.one_of_each(docs)
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.doc_id for r in kept.collect()) == [0, 13, 15]
    assert sum("Join" in p for p in plans) > 6
    assert [p for p in plans if "Broadcast" in p] == []
