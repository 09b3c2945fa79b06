import random

from pyspark.sql import Row

from vellum.llm import linededup


def brute(rows):
    """rows: (id, text) in order of (id, text hash); the first occurrence of a window stays."""
    seen, out = {}, {}
    for key, (d, t) in rows:
        lines = t.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if "".join(w).strip(" "):
                seen.setdefault(w, (key, i))
    for key, (d, t) in rows:
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen and seen[w] != (key, i):
                gone |= {i, i + 1, i + 2}
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 30)))) for i in range(80)]
    want = brute([((d, 0), (d, t)) for d, t in rows])
    docs = spark.createDataFrame([Row(doc_id=d, text=t, first="x", pos=1, row="y") for d, t in rows])
    got = {r.row.doc_id: r.kept for r in linededup.dedup_lines(docs).collect()}
    assert got == {d: want[d, 0] for d, _ in rows}


def test_edges(spark):
    text = "one\ntwo\nthree\nfour"
    rows = [Row(doc_id=None, text=text), Row(doc_id=None, text=None), Row(doc_id=1, text=""), Row(doc_id=2, text=text), Row(doc_id=2, text=text), Row(doc_id=3, text="x\n" + text + "\ny"), Row(doc_id=4, text="\n\n\n\n"), Row(doc_id=5, text="\n\n\n\n"), Row(doc_id=6, text="a\na\na\na\na")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.row.doc_id or -1, r.row.text or "", r.kept) for r in linededup.dedup_lines(docs).collect())
    want = [(-1, text, ""), (-1, "", None), (1, "", ""), (2, text, text), (2, text, text), (3, "x\n" + text + "\ny", "x\ny"), (4, "\n\n\n\n", "\n\n\n\n"), (5, "\n\n\n\n", "\n\n\n\n"), (6, "a\na\na\na\na", "")]
    # In the last, the second and third window repeat the first; together they cover its lines but for the first one.
    want[-1] = (6, "a\na\na\na\na", "a")
    assert got == sorted(want, key=lambda x: x[:2])
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_long_text(spark):
    text = "\n".join(f"line {i}" for i in range(50_000))
    docs = spark.createDataFrame([Row(doc_id=1, text=text), Row(doc_id=2, text=text + "\nmore")])
    got = {r.row.doc_id: r.kept for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: text, 2: "more"}
