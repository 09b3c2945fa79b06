import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.llm import simhash
from vellum.llm.common import Scratch
from vellum.llm.components import components


def brute_components(fps, ids, radius=3):
    fps = np.array(fps, dtype=np.int64).view(np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps ^ fps[i]) <= radius)[0]:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if least.get(r) is None else min(least[r], d if d is not None else least[r])
    return [least[find(i)] for i in range(len(fps))]


def slow_fingerprint(text):
    words = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprint():
    for text in ("", "One", "a b", "a b c", "AÉ b\x0bc d  e\nf", "x y z " * 50):
        assert simhash.fingerprint(text, 3) % (1 << 64) == slow_fingerprint(text)


def test_long_text_in_steps(monkeypatch):
    text = " ".join(str(i * 7919 % 1000) for i in range(500))
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text, 3) == whole


@pytest.mark.parametrize(("shared", "deep"), [(24, 1 << 15), (2, 1 << 15), (2, 4)])
def test_components_match_brute_force(spark, monkeypatch, shared, deep):
    monkeypatch.setattr(simhash, "SHARED", shared)
    monkeypatch.setattr(simhash, "DEEP", deep)
    monkeypatch.setattr(simhash, "TABLE_BLOCK", 16)
    monkeypatch.setattr(simhash, "PROBE_BLOCK", 64)
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    half = rng.getrandbits(32) << 32  # one half that many share, with near and far other halves
    fps += [half | rng.getrandbits(32) & mask for mask in (0xFFFFFFFF, 0xFF, 0xFF0000, 0x0000F00F) for _ in range(30)]
    fps += [0, 1, (1 << 64) - 1, 1 << 63]
    fps = np.unique(np.array(fps, dtype=np.uint64)).view(np.int64).tolist()
    scratch = Scratch(spark, "test")
    distinct = scratch.write(spark.createDataFrame(pd.DataFrame({"fp": fps}), "fp bigint"), "fps")
    roots = {r.node: r.root for r in components(scratch, simhash.links(scratch, distinct)).collect()}
    want = brute_components(sorted(fps), sorted(fps))
    assert [roots.get(f, f) for f in sorted(fps)] == want


def test_operator_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [Row(doc_id=5, text=long, fp="x", component=1), Row(doc_id=3, text=long + " end", fp="x", component=1), Row(doc_id=3, text=long + " end", fp="x", component=1), Row(doc_id=9, text=None, fp=None, component=None), Row(doc_id=8, text="  ", fp=None, component=None), Row(doc_id=None, text="other words in here", fp=None, component=None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component int")
    got = simhash.near_duplicates(docs).collect()
    want = brute_components([r.fp for r in got], [r.doc_id for r in got])
    assert [r.component for r in got] == want
    assert {r.component for r in got if r.doc_id in (8, 9)} == {8}
    assert len(got) == 6
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def written_plans(monkeypatch):
    """The plans of all tables that Scratch writes from now on."""
    plans, write = [], Scratch.write

    def recorded(self, df, name, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name, **options)

    monkeypatch.setattr(Scratch, "write", recorded)
    return plans


def test_nothing_goes_through_the_driver(spark, monkeypatch):
    """Tables of multiplied rows look as small to Spark as their files; none may be broadcast."""
    monkeypatch.setattr(simhash, "SHARED", 2)
    monkeypatch.setattr(simhash, "DEEP", 4)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10485760", "10MB")
    texts = [" ".join(f"w{i}" for i in range(400)) + f" {k}" for k in range(20)] + ["other words in here", None]
    docs = spark.createDataFrame([Row(doc_id=k, text=t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    plans = written_plans(monkeypatch)
    found = simhash.near_duplicates(docs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    got = found.collect()
    assert [r.component for r in got] == brute_components([r.fp for r in got], [r.doc_id for r in got])
    assert sum("Join" in p for p in plans) > 3
    assert [p for p in plans if "Broadcast" in p] == []


def test_blocks_of_a_shared_half_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TABLE_BLOCK", 4)
    monkeypatch.setattr(simhash, "PROBE_BLOCK", 4)
    rows = spark.range(64).select(F.lit(0).alias("s"), F.lit(7).cast("long").alias("v"), F.col("id").alias("fp"), F.lit(64).cast("long").alias("n"))
    found = simhash._grid(Scratch(spark, "test"), "grid", rows.withColumnRenamed("fp", "y"), rows.withColumnRenamed("fp", "x"), ["s", "v"], 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    grouped = plan[plan.index("FlatMapGroupsInPandas") :]
    assert re.match(r"hashpartitioning\(s#\d+, v#\d+L, t#\d+, p#\d+", grouped[grouped.index("hashpartitioning(") :])
