"""Queries on tables: the SELECT surface, profiles, sheets, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sheets
from ..operators.sql_access import Catalog, looks_safe
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def catalog(spark: SparkSession, sf_dir: str, names: list[str]) -> Catalog:
    c = Catalog(spark)
    c.register("tables", {n: table(spark, sf_dir, n) for n in names})
    return c


def surface(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """A SELECT that goes through the gate and the catalog."""

    def run(spark, sf_dir):
        return catalog(spark, sf_dir, tables.split()).run(sql)

    QUERIES[f"sql_surface_{name}"] = run
    ORACLES[f"sql_surface_{name}"] = oracle or sql


surface("filter_project", "lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'")
surface("group_having", "orders", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS least FROM orders GROUP BY o_orderpriority HAVING count(*) > 10")
surface("joins", "customer orders nation region", "SELECT r.r_name, n.n_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name")
surface("outer_joins", "customer orders", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000 GROUP BY c.c_custkey")
surface("full_join", "nation supplier", "SELECT n.n_name, s.s_suppkey FROM nation n FULL OUTER JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000")
surface("semi_anti", "customer orders", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
surface("subqueries", "part", "SELECT p_brand, p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand) AND p_size < 5")
surface("cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
surface("rollup", "orders", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
surface("windows", "orders", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS rk, lag(o_totalprice) OVER w AS prev, ntile(4) OVER w AS quarter, round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
surface("set_ops", "customer supplier nation", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier) UNION (SELECT n_regionkey FROM nation)")
surface("top_k", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
surface("pagination", "part", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 30 OFFSET 60")
surface("cte", "orders", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), ranked AS (SELECT o_custkey, total, dense_rank() OVER (ORDER BY total DESC) AS r FROM big) SELECT o_custkey, round(total, 2) AS total, r FROM ranked WHERE r <= 20")
surface("strings", "part", "SELECT p_partkey, upper(substr(p_name, 1, 5)) AS head, length(p_name) AS n, replace(p_type, ' ', '_') AS kind, p_name LIKE '%a%' AS has_a, concat(p_brand, '/', trim(p_type)) AS label, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand FROM part")
surface("dates", "orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS month_start, CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS later FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, (CAST(o_orderdate AS DATE) + INTERVAL 10 DAY)::TIMESTAMP AS later FROM orders")
surface("lateral", "nation customer", "SELECT n_name, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) t")
surface("percentiles", "orders", "SELECT o_orderstatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY CAST(o_totalprice AS DOUBLE)), 4) AS q1, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(o_totalprice AS DOUBLE)), 4) AS median FROM orders GROUP BY o_orderstatus")
QUERIES["sql_surface_dates"] = lambda spark, d: catalog(spark, d, ["orders"]).run("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS month_start, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS TIMESTAMP) AS later FROM orders")
surface("json", "events", "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.page') AS page FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS page FROM events")
surface("case_cast", "lineitem", "SELECT l_returnflag, CASE WHEN l_discount = 0 THEN 'full' WHEN l_discount < 0.05 THEN 'some' ELSE 'much' END AS cut, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean FROM lineitem GROUP BY 1, 2")
surface("range_join", "orders events", "SELECT e.event_type, count(*) AS n FROM events e JOIN orders o ON o.o_orderkey = e.event_id AND o.o_totalprice BETWEEN e.value AND e.value * 1000000 GROUP BY e.event_type")


@query("SELECT c_mktsegment, n_name, count(*)::BIGINT AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY ALL")
def relational_pipeline(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.where("c_acctbal > 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


_SAFE = r"""regexp_matches(s, '(?i)^\s*(SELECT|WITH)\b') AND NOT regexp_matches(s, '(?i)\b(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|REPLACE|MERGE|GRANT|REVOKE|EXEC|EXECUTE|ATTACH|DETACH)\b') AND NOT contains(s, ';')"""
_STATEMENT = "CASE conv_id % 6 WHEN 0 THEN 'select ' || turn || ';' WHEN 1 THEN 'WITH x AS (SELECT 1) SELECT * FROM x' WHEN 2 THEN 'DROP TABLE t' WHEN 3 THEN 'SELECT 1; SELECT 2' WHEN 4 THEN 'SELECT replace(a, b)' ELSE 'SELECT ' || text END"


@query(f"SELECT conv_id, turn, {_SAFE} AS safe FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace({_STATEMENT}, '^\\s+|\\s+$', '', 'g'), ';+$', ''), '^\\s+|\\s+$', '', 'g') AS s FROM conversations)")
def sql_gate(spark, sf_dir):
    i = F.col("conv_id") % 6
    s = F.when(i == 0, F.concat(F.lit("select "), F.col("turn").cast("string"), F.lit(";"))).when(i == 1, "WITH x AS (SELECT 1) SELECT * FROM x").when(i == 2, "DROP TABLE t").when(i == 3, "SELECT 1; SELECT 2").when(i == 4, "SELECT replace(a, b)").otherwise(F.concat(F.lit("SELECT "), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", looks_safe(s).alias("safe"))


_PROFILED = "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _s_profile() -> str:
    name, cols = _PROFILED
    one = lambda i, c: f"SELECT {i}::INT AS place, '{c}' AS name, count({c})::BIGINT AS non_null, count(*)::BIGINT AS total, count(DISTINCT {c})::BIGINT AS distinct_values, array_to_string(list_sort(list_distinct(list({c}::VARCHAR)))[1:5], ',') AS samples, {'min(' + c + ')::DOUBLE' if c not in ('c_name', 'c_mktsegment') else 'NULL::DOUBLE'} AS least, {'max(' + c + ')::DOUBLE' if c not in ('c_name', 'c_mktsegment') else 'NULL::DOUBLE'} AS most FROM {name}"
    return " UNION ALL ".join(one(i, c) for i, c in enumerate(cols))


@query(_s_profile())
def table_profile(spark, sf_dir):
    p = sheets.profile(table(spark, sf_dir, "customer").select(*_PROFILED[1]))
    return p.select("place", "name", "non_null", "total", F.col("distinct").alias("distinct_values"), F.array_join("samples", ",").alias("samples"), "least", "most")


@query("SELECT 'region' AS table_name, 0 AS place, '  - r_regionkey (int, ' || count(*) || '/' || count(*) || ' non-null, ' || count(DISTINCT r_regionkey) || ' unique) — values: [' || string_agg(r_regionkey::VARCHAR, ', ' ORDER BY r_regionkey) || '] — range: [' || min(r_regionkey)::DOUBLE || ', ' || max(r_regionkey)::DOUBLE || ']' AS line FROM region UNION ALL SELECT 'region', 1, '  - r_name (string, ' || count(*) || '/' || count(*) || ' non-null, ' || count(DISTINCT r_name) || ' unique) — values: [' || string_agg(r_name, ', ' ORDER BY r_name) || ']' FROM region")
def schema_text(spark, sf_dir):
    return sheets.schema_text(sheets.profile(table(spark, sf_dir, "region")), "region")


@query("SELECT n_nationkey AS row_index, 'Sheet: nation | Row ' || (n_nationkey + 1) || ' | n_nationkey: ' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ' | n_name: ' || n_name ELSE '' END || ' | n_regionkey: ' || n_regionkey AS text FROM nation")
def semantic_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
    return sheets.semantic_rows(n, "nation", "n_nationkey")


def made_cells(spark, sf_dir) -> DataFrame:
    """Each region of the world is a sheet: a heading, a gap, a table of its nations, a gap, key-value lines."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = "(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1)"
    body = n.selectExpr("'book' AS document_key", "r_name AS sheet", f"{place} AS k", "n_nationkey", "n_name", "r_name")
    cell = lambda r, c, v, t, b="false": f"struct(cast({r} as int) AS r, cast({c} as int) AS c, cast({v} as string) AS v, '{t}' AS v_type, {b} AS bold)"
    cells = ", ".join([cell("k + 3", 0, "n_nationkey", "n"), cell("k + 3", 1, "n_name", "s"), cell("k + 3", 2, "r_name", "s"), cell("k + 20", 0, "concat(n_name, ':')", "s"), cell("k + 20", 1, "n_nationkey", "n")])
    once = body.where("k = 0").selectExpr("document_key", "sheet", f"explode(array({cell(0, 0, 'upper(r_name)', 's', 'true')}, {cell(2, 0, chr(39) + 'Key' + chr(39), 's')}, {cell(2, 1, chr(39) + 'Name' + chr(39), 's')}, {cell(2, 2, chr(39) + 'Region' + chr(39), 's')})) AS x")
    return body.selectExpr("document_key", "sheet", f"explode(array({cells})) AS x").unionAll(once).select("document_key", "sheet", "x.*")


_BOXES = "WITH n AS (SELECT r_name AS sheet, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) SELECT sheet, 0::INT AS r1, 0::INT AS c1, 0::INT AS r2, 0::INT AS c2, 'heading' AS region_type, 1.0::DOUBLE AS density FROM n UNION ALL SELECT sheet, 2, 0, (n + 2)::INT, 2, 'table', 1.0 FROM n UNION ALL SELECT sheet, 20, 0, (n + 19)::INT, 1, 'key_value', 1.0 FROM n"


@query(_BOXES)
def region_classify(spark, sf_dir):
    cells = made_cells(spark, sf_dir)
    return sheets.classified(cells, sheets.islands(cells)).select("sheet", "r1", "c1", "r2", "c2", "region_type", "density")


@query("SELECT r_name AS sheet, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1)::INT AS row_index, unnest(['key', 'name', 'region']) AS name, unnest([n_nationkey::VARCHAR, n_name, r_name]) AS v FROM nation JOIN region ON n_regionkey = r_regionkey")
def sheet_table(spark, sf_dir):
    cells = made_cells(spark, sf_dir)
    boxes = sheets.classified(cells, sheets.islands(cells)).where("region_type = 'table'")
    return sheets.table_grid(sheets.region_cells(cells, boxes)).select("sheet", "row_index", "name", "v")


@query("SELECT r_name AS sheet, string_agg(n_name || ': ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS content, r_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def sheet_key_values(spark, sf_dir):
    cells = made_cells(spark, sf_dir)
    kinds = sheets.classified(cells, sheets.islands(cells))
    inside = sheets.region_cells(cells, kinds.where("region_type = 'key_value'"))
    heads = sheets.text_contents(sheets.region_cells(cells, kinds.where("region_type = 'heading'")))
    named = sheets.titled(kinds.join(heads, ["document_key", "sheet", "island"], "left")).select("document_key", "sheet", "island", "title")
    return sheets.key_value_contents(inside).join(named, ["document_key", "sheet", "island"]).select("sheet", "content", "title")


@query("SELECT p_partkey, 'c_' || p_partkey AS from_number, lower(replace(p_type, ' ', '_')) AS kind, CASE WHEN p_partkey % 2 = 0 THEN 't_order' ELSE 'orders' END AS tab FROM part")
def sql_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.sql_identifier(F.col("p_partkey").cast("string")).alias("from_number"), T.sql_identifier(F.col("p_type")).alias("kind"), T.sql_table_name(F.when(F.col("p_partkey") % 2 == 0, "Order").otherwise("orders")).alias("tab"))


@query("SELECT s_suppkey, (s_suppkey % 700)::INT AS i, CASE WHEN s_suppkey % 700 < 26 THEN chr((s_suppkey % 700 + 65)::INT) ELSE chr((s_suppkey % 700 // 26 + 64)::INT) || chr((s_suppkey % 700 % 26 + 65)::INT) END AS letters FROM supplier")
def column_letters(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", T.column_letters(F.col("s_suppkey") % 700).alias("letters"))
    return s.select("s_suppkey", T.column_index(F.col("letters")).alias("i"), "letters")
