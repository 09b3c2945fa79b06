"""Golden counts for five document shapes, and properties of chunks."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.operators import chunking
from vellum.operators.splitter import split_text
from vellum.sources.files import STRUCTURE, with_defaults


def prose(n, start="The"):
    """A text of exactly n characters in sentences."""
    words = "quality of chunks directly determines the retrieval precision and downstream answer".split()
    out, k = start, 0
    while len(out) < n - 1:
        out += (". Next " if k % 9 == 8 else " ") + words[k % len(words)]
        k += 1
    out = out[: n - 1].rstrip()
    return (out + "x" * n)[: n - 1] + "."


def section(title, level, content, kind="text"):
    return {"title": title, "level": level, "content": content, "section_type": kind, "lines": [{"line_number": 1, "text": content[:40]}]}


def table(n):
    rows = "| a | b |\n|---|---|\n"
    return (rows + "| 1 | 2 |\n" * 40)[: n - 1] + "|"


SHAPES = {
    "cross_page": ("research_paper", [(1, [section("Introduction", 2, "Introduction"), section("Introduction", 3, prose(313))]), (2, [section("Introduction", 3, prose(305, "In")), section("Methodology", 2, "Methodology"), section("Methodology", 3, prose(241, "We"))])], (2, 3, 1)),
    "layout_noise": ("research_paper_with_images", [(1, [section("Results", 2, prose(172)), section("Caption", 3, prose(90, "Figure")), section("[image]", 3, "bbox:1,2,3,4 picture on a page", "image"), section("Discussion", 3, prose(157))])], (3, 4, 3)),
    "frontmatter": ("research_paper_with_images", [(1, [section("A Title", 1, prose(130) + " someone@university.example"), section("Abstract", 2, prose(188)), section("Introduction", 2, prose(188, "We"))])], (2, 2, 2)),
    "references": ("research_paper", [(2, [section("Conclusion", 2, prose(181))]), (3, [section("[body]", 3, "References\n" + prose(125))])], (1, 1, 1)),
    "table": ("general", [(1, [section("Quarterly results", 2, "Quarterly results"), section("Quarterly results", 3, prose(188)), section("[Table]", 3, table(191), "table"), section("Quarterly results", 3, prose(200))])], (2, 3, 2)),
}


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [Row(title=k, document_name=f"{k}.pdf", document_key=f"fixture:{k}", doc_type=t, pages=[{"page_number": n, "sections": s} for n, s in pages], expectations=None) for k, (t, pages, _) in SHAPES.items()]
    return with_defaults(spark.createDataFrame(rows, STRUCTURE))


def test_golden_counts(shapes):
    got = {r.document_key: (r.parents, r.children, r.duplicates) for r in chunking.evaluated(chunking.chunked(shapes)).collect()}
    assert got == {f"fixture:{k}": want for k, (_, _, want) in SHAPES.items()}


def test_properties(shapes):
    rows = chunking.chunked(shapes).collect()
    parents = {r.parent_id for r in rows if r.chunk_type == "parent"}
    for r in rows:
        if r.chunk_type == "child":
            assert r.parent_id is None or r.parent_id in parents or "[Table" in r.content
            assert r.enriched_content.startswith("From '") and r.enriched_content.endswith(r.content)
        else:
            assert "bbox:" not in r.content
    assert len({r.id for r in rows}) == len(rows)
    assert sorted(r.id for r in rows) == sorted(r.id for r in chunking.chunked(shapes).collect())


def test_contract_with_images_is_general(spark, shapes):
    one = shapes.where("title = 'table'").withColumn("doc_type", F.lit("contract_with_images"))
    assert not any(r.content.startswith("[Clause") for r in chunking.chunked(one).collect())
    clause = chunking.chunked(one.withColumn("doc_type", F.lit("contract"))).collect()
    assert any(r.content.startswith("[Clause: Quarterly results] ") for r in clause)


def test_splitter():
    text = prose(3000)
    parts = split_text(text)
    assert all(0 < len(p) <= 512 for p in parts)
    assert all(p in text for p in parts)
    assert split_text("x" * 2000) == ["x" * 2000]
    assert split_text("") == []
    assert split_text("a b", 512) == ["a b"]


def test_page_chunks(spark):
    pages = spark.createDataFrame([Row(doc_id=1, label="L", page_number=2, text=prose(900)), Row(doc_id=2, label="L", page_number=1, text="short")])
    rows = chunking.page_chunks(pages).collect()
    assert {r.doc_id for r in rows} == {1} and rows[0].parent.startswith("[L - Page 2] ")
