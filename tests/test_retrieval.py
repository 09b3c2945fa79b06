"""Ranking against plain versions: vectors in blocks, stems, keyword search, missing parents."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.functions.stemming import STOP_WORDS, lexeme, stem
from vellum.functions.text import UNSOUGHT, words
from vellum.operators import retrieval as R
from vellum.operators.search_cache import SearchCache

STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistently consist consolation consol consolatory consolatori
consolidate consolid consolidating consolid consolingly consol conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc knackeries knackeri knavish knavish
kneaded knead kneeled kneel knightly knight knitted knit knives knive knockers knocker generate generat generously generous hopping hop hoping hope falling fall flies fli dies die ties tie cries cri
agreed agre feed feed happy happi say say boys boy national nation relational relat analogies analog hopefulness hope electricity electr adjustable adjust controlling control bed bed""".split()


def test_stems_of_the_published_vocabulary():
    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))
    assert [lexeme(w) for w in ("the", "(Cats)".lower(), "running,", "--")] == ["", "cat", "run", ""]


@pytest.mark.parametrize("block", [4096, 3])
@pytest.mark.parametrize("each", [None, 2])
def test_vectors_against_plain_loops(spark, monkeypatch, block, each):
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    made = [(i, [float(x) for x in rng.integers(-2, 3, 4)], f"g{i % 5}") for i in range(120)] + [(200, None, "g1"), (201, [0.0] * 4, "g2")]
    rows = spark.createDataFrame(made, "id bigint, embedding array<float>, g string").repartition(3)
    asked = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), F.col("g").alias("own"))
    got = R.vector_topk(rows, asked, "id", 6, unlike=("g", "own"), group="g" if each else None, each=each)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0

    want = []
    for q, v, own in made:
        if q % 10 or v is None:
            continue
        scored = sorted((-cos(v, w), i, g) for i, w, g in made if w is not None and g != own)
        if each:
            scored = [x for k, x in enumerate(scored) if sum(y[2] == x[2] for y in scored[:k]) < each]
        want += [(q, i, -s, r + 1) for r, (s, i, g) in enumerate(scored[:6])]
    have = sorted((r.query_id, r.id, r.score, r["rank"]) for r in got.collect())
    assert np.allclose(have, sorted(want), atol=2e-6)


def test_no_vector_queries(spark):
    rows = spark.createDataFrame([Row(id=1, embedding=[1.0])])
    assert R.vector_topk(rows, rows.limit(0).select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), "id").count() == 0


def covers(places, need):
    """All shortest extents with every term, from their definition."""
    found = [(a, b) for a, _ in places for b, _ in places if a <= b and len({t for p, t in places if a <= p <= b}) == need]
    return [(a, b) for a, b in found if not any((c, d) != (a, b) and a <= c and d <= b for c, d in found)]


@pytest.mark.parametrize("most", [10, 0])
def test_keyword_search_with_stems(spark, data, monkeypatch, most):
    monkeypatch.setattr(R, "BROADCAST_TERMS", most)
    docs = [(i, r.text) for i, r in enumerate(spark.read.parquet(f"{data}/documents.parquet").limit(60).collect())]
    docs += [(100, "Running cats, and the cat runs."), (101, "a cat that ran; cats run running"), (102, None), (103, "the of and")]
    asked = {1: "the running cat", 2: "and the", 3: docs[5][1].split()[3], 4: " ".join(docs[7][1].split()[2:5])}
    from vellum.functions.stemming import stem_words

    lexemes = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("w", stem_words(words(F.col("text"))))
    q = lexemes(list(asked.items()), "query_id int, text string").select("query_id", F.explode("w").alias("term")).where("term <> ''").distinct()
    got = R.keyword_topk(lexemes(docs, "doc_id int, text string"), q, "doc_id", F.col("w"))
    want = []
    for i, text in asked.items():
        terms = sorted({lexeme(w) for w in text.lower().split()} - {""})
        for d, t in docs:
            w = [lexeme(x) for x in (t or "").lower().split()]
            places = [(p, terms.index(x)) for p, x in enumerate(w) if x in terms]
            if terms and len({t for _, t in places}) == len(terms):
                score = sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for p, _ in places) - 1)) for a, b in covers(places, len(terms)))
                want.append((i, d, round(score, 6)))
    have = sorted((r.query_id, r.doc_id, r.score) for r in got.collect())
    assert len(have) == len(want) and np.allclose(have, sorted(want), atol=2e-6)
    assert {100, 101} <= {d for i, d, _ in want if i == 1} and not [x for x in want if x[0] == 2]
    assert "the" in STOP_WORDS and not re.search("[A-Z]", "".join(STOP_WORDS))


def test_children_without_a_parent_stay(spark):
    children = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", None)], "chunk string, parent_id string")
    parents = spark.createDataFrame([("p1", "whole")], "parent_id string, content string")
    assert {r.chunk: r.parent_text for r in R.with_parents(children, parents).collect()} == {"a": "whole", "b": None, "c": None}


def test_search_cache(spark):
    now, made = [0.0], []

    def search():
        made.append(1)
        return spark.range(3)

    cache = SearchCache(seconds=300, most=2, clock=lambda: now[0])
    one = lambda q="a", groups=("g",): cache.get(q, {"type": "x"}, set(groups), search)
    assert one() is one() and len(made) == 1 and one().count() == 3
    one(groups=("h",))
    assert len(made) == 2  # other rights, another entry
    now[0] = 301
    one()
    assert len(made) == 3
    one("b"), one("c")
    assert len(cache.held) == 2 and len(made) == 5
    cache.clear()
    one("c")
    assert len(made) == 6
    cache.clear()


def phrases(query, text):
    """Phrases to look for in a page, word by word."""
    sought = [w for w in query.lower().split() if len(w) > 2 and w not in UNSOUGHT]
    words, out, i = re.split(r"\s+", re.sub(r"\[(?:Section|Clause):.*?\]\s*", "", text)), [], 0
    while i < len(words) - 2 and len(out) < 3:
        phrase = re.sub(r"[^a-zA-Z0-9\s-]", "", " ".join(words[i : i + 4])).strip()
        if 10 < len(phrase) < 60 and any(w in phrase.lower() for w in sought):
            out.append(phrase)
            i += 4
        else:
            i += 1
    return out or sought[:4]


def test_highlight_phrases(spark, data):
    from vellum.plans.registry import QUERIES

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r.terms for r in QUERIES["highlight_phrases"](spark, data).collect()}
    assert got == {d: "|".join(phrases("show the there and erent words", f"[Section: x] {t}")) for d, t in text.items()}
    assert len(set(got.values())) > 20
