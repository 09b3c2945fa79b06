"""Parser chain, sheets read flat, scans, metadata, REST, size guard, registry; model hooks; stages with retries; late rows."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.functions.registered import register
from vellum.operators import chunking, sheets, structure
from vellum.operators import retrieval as R
from vellum.operators.sql_access import Catalog, Refused
from vellum.sources import files, sinks
from vellum.streaming import events

from .test_chunking import SHAPES, prose, shapes  # noqa: F401


def test_size_guard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_BYTES", 3)
    (tmp_path / "a.csv").write_text("a,b,c")
    (tmp_path / "b.csv").write_text("a")
    assert {r.path.rsplit("/", 1)[1]: (r.kind, r.reason) for r in files.uploads(spark, str(tmp_path)).collect()} == {"a.csv": ("rejected", "over 100 MB"), "b.csv": ("sheet", None)}


def test_csv_preview(spark):
    df = spark.createDataFrame([(i, None if i else "x") for i in range(120)], "k int, v string").coalesce(1)
    lines = files.csv_preview(df).split("\n")
    assert lines[:3] == ["| k | v |", "| --- | --- |", "| 0 | x |"] and len(lines) == 102 and lines[3] == "| 1 |  |"


def test_flat_sheets(spark):
    cell = lambda r, c, v: ("book", "s", "visible", r, c, v, "s", False, None)
    cells = spark.createDataFrame([cell(2, 1, "Name Of"), cell(2, 2, "%"), cell(4, 1, "x"), cell(4, 2, "1"), cell(7, 1, "y"), cell(7, 3, "z"), cell(8, 1, " ")], files.CELLS)
    got = sorted((r.row_index, r.c, r.name, r.v) for r in files.flat_sheets(cells).collect())
    assert got == [(0, 1, "name_of", "x"), (0, 2, "col_2", "1"), (1, 1, "name_of", "y"), (1, 3, "col_3", "z")]


def test_parser_chain_and_rejects(spark):
    def strict(path, data):
        if not data.startswith(b"#"):
            raise ValueError("no heading")
        return [{"title": "t", "level": 1, "content": data.decode()}]

    def loose(path, data):
        return [{"content": data.decode("utf-8")}]

    rows = spark.createDataFrame([("a", b"# x"), ("b", b"plain"), ("c", b"\xff")], "path string, content binary")
    got = {r.path: (r.parser, r.level, r.content, r.error) for r in files.parsed(rows, {"strict": strict, "loose": loose}).collect()}
    assert got["a"] == ("strict", 1, "# x", None) and got["b"] == ("loose", 3, "plain", None)
    assert got["c"][0] is None and got["c"][3].startswith("strict: no heading; loose: ")


def test_scans_of_the_first_version(spark):
    versions = spark.createDataFrame([(1, 0, "v1"), (1, 1, "v2"), (2, 5, "v3")], "doc_id int, position int, version_id string")
    scans = spark.createDataFrame([("v1", 0, "a", "b"), ("v1", 1, "", "c"), ("v2", 0, "old", None), ("v3", 0, None, None)], "version_id string, position int, content string, text string")
    assert sorted(tuple(r) for r in files.scanned_pages(versions, scans).collect()) == [(1, 1, "a"), (1, 2, "c"), (2, 1, "")]


def test_metadata(spark):
    label = lambda *rows: spark.createDataFrame(list(rows), "doc_id int, label string")
    got = files.with_metadata(spark.range(2).select(F.col("id").cast("int").alias("doc_id")), label((0, "Contract")), label((0, "b"), (0, "a"), (0, "a")), label((1, "Cab")))
    assert sorted(tuple(r) for r in got.collect()) == [(0, "Contract", ["a", "b"], []), (1, "", [], ["Cab"])]


def test_rest_documents(spark):
    ids = spark.range(1, 4)
    got = files.rest_documents(spark, ids, lambda: "key", lambda i, k: {"label": f"{k}{i}", "page_count": i}, lambda i, k: bytes([i]))
    assert sorted((r.id, r.label, r.doc_type, r.page_count, bytes(r.content)) for r in got.collect()) == [(i, f"key{i}", "", i, bytes([i])) for i in (1, 2, 3)]


def test_registry_outlives_the_driver(spark, tmp_path):
    one, two = spark.createDataFrame([Row(a=1)]), spark.createDataFrame([Row(a=2), Row(a=3)])
    c = Catalog(spark)
    c.register("d1", {"T": one})
    c.register("d2", {"T": two, "U": one})
    c.save(str(tmp_path), "d1", "one.xlsx")
    c.save(str(tmp_path), "d2", "two.xlsx")
    c.register("d1", {"T": two})
    c.save(str(tmp_path), "d1", "one.xlsx")
    for d in ("d1", "d2"):
        c.remove(d)
    again = Catalog(spark)
    listed = again.load(str(tmp_path)).collect()
    assert [(r.document_key, r.document_name, r.total_rows) for r in listed] == [("d1", "one.xlsx", 2), ("d2", "two.xlsx", 3)]
    assert listed[0].created_at > listed[1].created_at
    assert again.tables("d2") and again.run(f"SELECT sum(a) AS s FROM {sorted(again.tables('d1'))[0]}", "d1").collect()[0].s == 5
    for d in ("d1", "d2"):
        again.remove(d)


def test_table_names_that_clash(spark):
    c = Catalog(spark)
    df = spark.createDataFrame([Row(a=1)])
    assert c.register("x1", {"A b": df, "a_b": df, "A-B": df}) == ["a_b", "a_b_1", "a_b_2"]
    assert c.register("x2", {"a b": df}) == ["a_b_3"]
    c.remove("x1"), c.remove("x2")


def test_write_back_rules(spark):
    df = spark.createDataFrame([("Default", "invoice", ["a", " ", "a", "b", "c", "d", "e", "f"]), ("Contract", "invoice", []), ("Default", None, None)], "now string, found string, tags array<string>")
    got = [tuple(r) for r in df.select(sinks.type_change(df.now, df.found), sinks.accepted_tags(df.tags)).collect()]
    assert got == [("invoice", ["a", "b", "c", "d", "e"]), (None, []), (None, None)]


def test_asked_types_keep_to_the_domain(spark):
    df = spark.createDataFrame([("Technical Manual.", "general"), ("poem", "general_with_images"), (None, "contract"), ("invoice", "general_with_images")], "said string, keyword string")
    got = [r.t for r in df.select(chunking.asked_type(F.col("said"), F.col("keyword"), lambda s: s).alias("t")).collect()]
    assert got == ["technical_manual", "general_with_images", "contract", "invoice_with_images"]
    assert df.select(chunking.asked_type(F.col("said"), F.col("keyword"), None).alias("t")).collect()[0].t == "general"


def test_enrichment_modes(shapes):  # noqa: F811
    one = shapes.where("title = 'references'")
    off = chunking.chunked(one, "off").collect()
    assert all(r.enriched_content == r.content for r in off)
    full = chunking.chunked(one, "full_llm", lambda s: s.map(lambda t: None if t is None else f"about {len(t)}")).collect()
    assert {r.enriched_content for r in full if r.chunk_type == "child"} == {f"about {len(r.content)}\n\n{r.content}" for r in off if r.chunk_type == "child"}
    assert all(r.enriched_content == r.content for r in full if r.chunk_type == "parent")
    silent = chunking.chunked(one, "full_llm", lambda s: s.map(lambda t: None)).collect()
    assert sorted(r.enriched_content for r in silent) == sorted(r.enriched_content for r in chunking.chunked(one).collect())
    summed = chunking.enriched(chunking.chunked(one, "off"), "llm", lambda s: s.map(lambda t: "A summary."), "content").collect()
    assert all("A summary." in r.enriched_content and "This is a" not in r.enriched_content for r in summed if r.chunk_type == "child")
    with pytest.raises(ValueError):
        chunking.chunked(one, "other")


def test_expectations(spark, shapes):  # noqa: F811
    chunks = chunking.chunked(shapes)
    rows = [(f"fixture:{k}", dict(max_parents=p, max_children=c, max_duplicate_children=d, must_include_sections=["conclusion"] if k == "references" else [], forbidden_section_patterns=["^zzz"], max_forbidden_hits=0, min_parent_chars=50)) for k, (_, _, (p, c, d)) in SHAPES.items()]
    kind = files.STRUCTURE.split("expectations ")[1]
    expected = spark.createDataFrame([Row(document_key=k, expectations=tuple(e.get(n) for n in ("max_parents", "max_children", "max_duplicate_children", "max_short_parents", "max_forbidden_hits", "must_include_sections", "forbidden_section_patterns", "min_parent_chars"))) for k, e in rows], f"document_key string, expectations {kind}")
    got = {r.document_key: r for r in chunking.evaluated(chunks, expected).collect()}
    assert {r.verdict for r in got.values()} == {"PASS"} and all(r.missing == [] and r.forbidden_hits == 0 for r in got.values())
    worse = expected.withColumn("expectations", F.col("expectations").withField("max_children", F.lit(0)).withField("must_include_sections", F.array(F.lit("Nowhere"))).withField("forbidden_section_patterns", F.array(F.lit("QUALITY of"), F.lit("chunks"))))
    bad = {r.document_key: r for r in chunking.evaluated(chunks, worse).collect()}
    one = bad["fixture:references"]
    assert one.verdict == "FAIL" and one.failures == ["child count 1 > 0", "forbidden section hits 2 > 0", "missing sections: Nowhere"]


def test_scanned_sections(spark):
    s = lambda title, level, kind="text": Row(title=title, level=level, content=title, section_type=kind, lines=[])
    schema = "sections array<struct<title:string,level:int,content:string,section_type:string,lines:array<struct<line_number:int,text:string>>>>, ocr string"
    df = spark.createDataFrame([([s("H", 1), s("b", 3), s("p", 3, "image")], "one\r\n\r\n two \n\n\n"), ([s("b", 3)], "scan"), ([s("b", 3)], " ")], schema)
    got = [[(x.title, x.level, x.section_type, x.content) for x in r.x] for r in df.select(structure.ocr_sections(df.sections, df.ocr).alias("x")).collect()]
    assert got == [[("H", 1, "text", "H"), ("p", 3, "image", "p"), ("H", 3, "text", "one\n\ntwo")], [("[ocr]", 3, "text", "scan")], [("b", 3, "text", "b")]]


def test_stages_and_retries(spark, tmp_path):
    def chunk(payload):
        if "bad" in payload:
            raise RuntimeError("x" * 3000)
        return payload + "!"

    stages = {"parsing": str.strip, "chunking": chunk, "storing": lambda p: p}
    tasks = spark.createDataFrame([("a", 0, " ok "), ("b", 0, "bad"), ("c", 3, "bad")], "key string, attempt int, payload string")
    ended = events.staged(tasks, stages)
    got = {r.key: (r.status, r.stage, r.progress, len(r.error or ""), r.wait) for r in ended.collect()}
    assert got == {"a": ("completed", "storing", 100, 0, None), "b": ("failed", "chunking", 0, 2000, 60), "c": ("failed", "chunking", 0, 2000, None)}
    assert [tuple(r) for r in events.retries(ended, tasks).collect()] == [("b", 1, "bad")]
    tasks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tasks.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a batch that is run again replaces its own rows
        q = stream.writeStream.foreachBatch(events.stage_sink(str(tmp_path / "out"), stages)).option("checkpointLocation", str(tmp_path / f"cp{_}")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_progress_of_stages(spark):
    df = spark.createDataFrame([("PROGRESS", "parsing", False), ("PROGRESS", "embedding", True), ("PROGRESS", "storing", True), ("SUCCESS", None, None), ("STARTED", None, None), ("PENDING", None, None), ("PROGRESS", "other", False)], "s string, stage string, more boolean")
    assert [r.p for r in df.select(events.progress(df.s, df.stage, df.more).alias("p")).collect()] == [10, 80, 85, 100, 5, 0, 0]


def test_sessions_and_late_rows(spark, tmp_path):
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, user_id int, event_type string, value double"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([(t(0, 0), 1, "v", 1.0), (t(0, 20), 1, "v", 1.0), (t(2, 0), 1, "v", 1.0)])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    queries = [f(stream).writeStream.format("memory").queryName(n).outputMode("append").option("checkpointLocation", str(tmp_path / n)).start() for n, f in (("sess", events.sessions), ("tumb", events.tumbling))]
    try:
        for q in queries:
            q.processAllAvailable()
        write([(t(0, 5), 1, "v", 100.0)])  # two hours late: its session and its window are closed
        for q in queries:
            q.processAllAvailable()
        write([(t(6, 0), 2, "v", 1.0)])
        for q in queries:
            q.processAllAvailable()
        write([(t(9, 0), 2, "v", 1.0)])
        for q in queries:
            q.processAllAvailable()
    finally:
        for q in queries:
            q.stop()
    assert sorted((r.user_id, r.session_start.hour, r.n) for r in spark.table("sess").collect()) == [(1, 0, 2), (1, 2, 1), (2, 6, 1)]
    assert sorted((r.window_start.hour, r.n, r.total) for r in spark.table("tumb").collect()) == [(0, 2, 2.0), (2, 1, 1.0), (6, 1, 1.0)]


def test_lease_frees_stuck_work(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    schema = "key string, ts timestamp, event_id long, outcome string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([("a", t(0), 1, "processing"), ("b", t(0), 2, "completed")])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    q = events.deduplicated(stream, lease="1 hour").writeStream.format("memory").queryName("leased").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        write([("c", t(5), 3, "completed")])
        q.processAllAvailable()
        write([("a", t(6), 4, "completed"), ("b", t(6), 5, "completed")])
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.event_id: r.started for r in spark.table("leased").collect()} == {1: True, 2: True, 3: True, 4: True, 5: False}
    assert prose(20)


def test_models_read_sheets(spark):
    pages = spark.createDataFrame([(1, "a" * 9000, True), (2, "b", True), (3, "c", False)], "k int, content string, needs_refinement boolean")
    said = lambda s: s.map(lambda t: None if t is None else f"---SECTION---\nTYPE: Table\nTITLE: T\nCONTENT: {len(t)}\n---SECTION---\nbroken" if t[0] == "a" else "nothing")
    got = sorted((r.k, r.pos, r.section_type, r.title, r.content) for r in sheets.asked_sections(pages, said).collect())
    assert got == [(1, 0, "table", "T", "8000"), (2, 0, "text", "", "b"), (3, 0, "text", "", "c")]
    assert {len(r.content) for r in sheets.asked_sections(pages.drop("needs_refinement"), None).collect()} == {9000, 1}


def test_providers_answer_in_turn(spark):
    prompts = spark.createDataFrame([("a",), ("b",), ("c",)], "prompt string")
    seen = lambda name, known: lambda s: s.map(lambda t: None if t is None else known.get(t, " "))
    got = {r.prompt: r.answer for r in R.answered(prompts, [seen("one", {"a": "A1"}), seen("two", {"a": "A2", "b": " B2 "})]).collect()}
    assert got == {"a": "A1", "b": "B2", "c": None}


def test_functions_in_sql(spark):
    assert register(spark, dim=4) == ["stem_en", "split_recursive", "embed"]
    r = spark.sql("SELECT stem_en('Running') AS a, stem_en('the') AS b, size(split_recursive(repeat('word ', 300))) AS c, size(embed('x y')) AS d, stem_en(NULL) AS e").collect()[0]
    assert (r.a, r.b, r.c > 2, r.d, r.e) == ("run", "", True, 4, None)
    with pytest.raises(Refused):
        Catalog(spark).run("SELECT stem_en('Running') AS a")
    assert Catalog(spark, ["stem_en"]).run("SELECT stem_en('Running') AS a").collect()[0].a == "run"


def test_markdown_of_sheets(spark):
    md = "# H\none\n\ntwo\n| a |\n| b |\n#### no heading"
    pages = spark.createDataFrame([("d", 1, md)], "document_key string, page_number int, markdown string")
    got = [(r.section_type, r.content) for r in structure.line_sections(pages, sheets=True).orderBy("block").collect()]
    assert got == [("heading", "H"), ("text", "one"), ("text", "two"), ("table", "| a |\n| b |"), ("text", "#### no heading")]
    assert [r.content for r in structure.line_sections(pages).orderBy("block").collect()] == ["H", "one\ntwo", "| a |\n| b |", "no heading"]
