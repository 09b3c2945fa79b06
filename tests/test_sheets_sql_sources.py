import io
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import sheets
from vellum.operators.sql_access import Catalog, Refused, as_text, ask, route, without_fences
from vellum.sources import files, sinks


def cells(spark, grid, sheet="S", state="visible"):
    rows = [Row(document_key="d", sheet=sheet, sheet_state=state, r=r, c=c, v=str(v), v_type="n" if isinstance(v, (int, float)) else "s", bold=False) for r, line in enumerate(grid) for c, v in enumerate(line) if v is not None]
    return spark.createDataFrame(rows, "document_key string, sheet string, sheet_state string, r int, c int, v string, v_type string, bold boolean")


FLOATING = [["Note one", None], ["Note two", None], [None, "Note three"], [], [None, None, "Employees"], [None, None, "Employee ID", "Full Name", "Department", "Revenue ($)", "Region"]]
FLOATING += [[None, None, i, f"N{i}", "D", None if i == 3 else i * 10.5, "R"] for i in range(1, 6)] + [[]] * 3 + [["Footer"]]


def test_floating_table(spark):
    c = cells(spark, FLOATING)
    kinds = {(r.r1, r.c1, r.r2, r.c2): r.region_type for r in sheets.classified(c, sheets.islands(c)).collect()}
    assert kinds == {(0, 0, 2, 1): "text", (4, 2, 10, 6): "table", (14, 0, 14, 0): "heading"}
    boxes = sheets.classified(c, sheets.islands(c)).where("region_type = 'table'")
    grid = sheets.table_grid(sheets.region_cells(c, boxes)).collect()
    assert {r.name for r in grid} == {"employee_id", "full_name", "department", "revenue", "region"}
    assert {r.row_index for r in grid} == {0, 1, 2, 3, 4}
    numbers = {r.name: r.is_number for r in sheets.numeric_columns(sheets.table_grid(sheets.region_cells(c, boxes))).collect()}
    assert numbers["revenue"] and numbers["employee_id"] and not numbers["full_name"]


def test_names_and_formulas(spark):
    assert sheets.clean_names(["A b", "a_b", "", None, "A b"]) == ["a_b", "a_b_1", "col_2", "none", "a_b_2"]
    df = spark.createDataFrame([Row(formula="C5: =SUM(A1:B2)"), Row(formula="x")]).withColumn("c1", F.lit(1)).withColumn("r1", F.lit(2))
    r = sheets.formulas(df).collect()
    assert [(x.c, x.row_index, x.expression) for x in r] == [(1, 1, "=SUM(A1:B2)")]
    pairs = [(0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")]
    out = spark.createDataFrame([Row(i=i, s=s) for i, s in pairs]).select(T.column_letters(F.col("i")).alias("a"), T.column_index(F.col("s")).alias("b"), "i", "s").collect()
    assert all(x.a == x.s and x.b == x.i for x in out)


def test_section_blocks(spark):
    text = "---SECTION---\nTYPE: Table\nTITLE: T\nCONTENT:\n| a |\n---SECTION---\nbad\n---SECTION---\nTYPE: text\nTITLE: U\nCONTENT: hello"
    out = sheets.section_blocks(spark.createDataFrame([Row(id=1, t=text)]), "t").collect()
    assert [(r.section_type, r.title, r.content) for r in out] == [("table", "T", "| a |"), ("text", "U", "hello")]


def book(hidden=True):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Public" sheetId="1" r:id="r1"/><sheet name="Internal" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><r><t>To</t></r><r><t>tal</t></r></si></sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {ns}><fonts><font/><font><b/></font></fonts><cellXfs><xf fontId='0'/><xf fontId='1'/></cellXfs></styleSheet>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s" s="1"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="B2"><f>SUM(1,2)</f><v>3</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>9</v></c></row></sheetData></worksheet>')
    return data.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book())
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "t.csv").write_text("A b,a_b,\n1,x,2\n,y,3\n")
    (tmp_path / "x.exe").write_bytes(b"1")
    kinds = {r.path.rsplit("/", 1)[1]: (r.kind, r.reason) for r in files.uploads(spark, str(tmp_path)).collect()}
    assert kinds == {"a.xlsx": ("sheet", None), "bad.xlsx": ("sheet", None), "t.csv": ("sheet", None), "x.exe": ("rejected", "file type")}
    got = files.workbooks(spark, str(tmp_path))
    ok = {(r.sheet, r.r, r.c): (r.v, r.v_type, r.bold, r.formula) for r in got.where("sheet_state = 'visible'").collect()}
    assert ok == {("Public", 0, 0): ("Name", "s", True, None), ("Public", 0, 1): ("Total", "s", False, None), ("Public", 1, 1): ("3", "n", False, "=SUM(1,2)"), ("Public", 1, 2): ("in", "s", False, None)}
    assert got.where("sheet_state = 'error'").count() == 1 and got.where("sheet_state = 'hidden'").count() == 1
    assert files.raw_cells(got).collect()[0].content == "A1: Name\nB1: Total\nB2: 3\nC2: in"
    csv = files.csv_table(spark, str(tmp_path / "t.csv"))
    assert csv.columns == ["a_b", "a_b_1", "_c2"] or csv.columns[:2] == ["a_b", "a_b_1"]
    rest = files.rest_pages(spark, lambda p: [{"id": p, "label": "x", "doc_type": "Default", "page_count": 1}], 3)
    assert sorted(r.id for r in rest.collect()) == [1, 2, 3]


def test_replace_by_document_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "chunks")
    old = spark.createDataFrame([Row(document_key=f"d{i % 20}", content=f"c{i}") for i in range(100)])
    sinks.replace_by_document(old, path)
    new = spark.createDataFrame([Row(document_key="d3", content="new")])
    for _ in range(2):
        sinks.replace_by_document(new, path)
        rows = spark.read.parquet(path)
        assert rows.count() == 96 and [r.content for r in rows.where("document_key = 'd3'").collect()] == ["new"]


@pytest.fixture
def catalog(spark):
    c = Catalog(spark)
    c.register("doc", {"Sales 2024": spark.createDataFrame([Row(a=1, b="x"), Row(a=2, b="y")]), "order": spark.createDataFrame([Row(k=1)])})
    return c


def test_catalog_and_gate(catalog, tmp_path):
    assert catalog.tables() == {"sales_2024", "t_order"}
    assert catalog.run("SELECT sum(a) AS s FROM sales_2024;").collect()[0].s == 3
    assert catalog.run("WITH x AS (SELECT a FROM sales_2024) SELECT max(a) AS m FROM x WHERE a IN (SELECT k FROM t_order)").collect()[0].m == 1
    assert catalog.run("SELECT replace(b, 'x', 'drop table') AS r FROM sales_2024").count() == 2
    for bad in ("DROP VIEW sales_2024", "INSERT INTO sales_2024 SELECT 1, 'x'", "SELECT 1; SELECT 2", "CREATE TABLE z AS SELECT 1", f"SELECT * FROM parquet.`{tmp_path}`", "SELECT * FROM other", "SELECT a FROM sales_2024 WHERE a IN (SELECT x FROM other)", "SET x = 1", "not sql"):
        with pytest.raises(Refused):
            catalog.run(bad)


def test_gate_keeps_to_scopes_and_functions(spark, catalog, tmp_path):
    spark.createDataFrame([Row(hidden="secret")]).createOrReplaceTempView("secret")
    refused = [
        "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "WITH a AS (WITH secret AS (SELECT * FROM secret) SELECT * FROM secret) SELECT * FROM a",
        "WITH b AS (SELECT * FROM c), c AS (SELECT 1 AS x) SELECT * FROM b",
        "SELECT (WITH secret AS (SELECT 1 AS x) SELECT x FROM secret) AS y, s.hidden FROM secret s",
        "SELECT * FROM (WITH secret AS (SELECT 1 AS x) SELECT * FROM secret) t JOIN secret ON true",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM sales_2024",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM sales_2024",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') FROM sales_2024",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')",
        "SELECT a FROM sales_2024 ORDER BY reflect('java.lang.System', 'exit', 1)",
        "SELECT transform(array(1), x -> java_method('java.lang.System', 'exit', x))",
        "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT input_file_name() FROM sales_2024", "SELECT raise_error('x')", "SELECT current_user()",
        "SELECT * FROM IDENTIFIER('secret')", "SELECT * FROM sql_keywords()", f"SELECT * FROM csv.`{tmp_path}`", f"SELECT * FROM text.`{tmp_path}`", "SELECT * FROM default.secret", "TABLE secret",
        "SELECT a FROM sales_2024 WHERE EXISTS (SELECT 1 FROM secret)", "SELECT a FROM sales_2024, LATERAL (SELECT * FROM secret)", "DESCRIBE sales_2024", "SHOW TABLES", "EXPLAIN SELECT 1",
    ]
    for bad in refused:
        with pytest.raises(Refused):
            catalog.run(bad)
    good = {
        "WITH sales_2024 AS (SELECT a + 1 AS a FROM sales_2024) SELECT max(a) AS x FROM sales_2024": 3,
        "WITH a AS (SELECT 2 AS x), b AS (SELECT x * 2 AS x FROM a) SELECT x FROM b": 4,
        "WITH RECURSIVE n AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM n WHERE x < 5) SELECT max(x) AS x FROM n": 5,
        "SELECT sum(id) AS x FROM range(4)": 6,
        "SELECT sum(y) AS x FROM sales_2024 LATERAL VIEW explode(array(a, a)) t AS y": 6,
        "SELECT length(concat_ws('-', b, upper(b))) AS x FROM sales_2024 LIMIT 1": 3,
    }
    for sql, want in good.items():
        assert catalog.run(sql).collect()[0].x == want, sql


def test_ask_repairs(catalog):
    said = iter(["```sql\nSELECT nothing FROM sales_2024;\n```", "SELECT a FROM sales_2024 ORDER BY a"])
    errors = []

    def generate(question, error):
        errors.append(error)
        return next(said)

    sql, df = ask(catalog, "?", generate)
    assert sql.startswith("SELECT a") and [r.a for r in df.collect()] == [1, 2]
    assert errors[0] is None and "nothing" in errors[1]
    assert as_text(df, 1) == "a\n-\n1\n... more rows omitted"
    assert without_fences("SELECT 1;") == "SELECT 1"
    assert (route("sql", True), route("semantic", True), route("semantic", True, False), route("sql", False)) == ("sql", "search", "sql", "search")
