"""Read-only SQL over registered tables: gates, catalog, execution and the repair loop."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_words, strip
from ..sources.sinks import latest

# Verbs that change something.
UNSAFE = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "REPLACE", "MERGE", "GRANT", "REVOKE", "EXEC", "EXECUTE", "ATTACH", "DETACH")


def looks_safe(sql: Column) -> Column:
    """The text rule: SELECT or WITH first, no unsafe word anywhere, one statement."""
    s = strip(F.regexp_replace(strip(sql), ";+$", ""))
    return s.rlike(ascii_words(r"(?i)^\s*(SELECT|WITH)\b")) & ~s.rlike(ascii_words(r"(?i)\b(" + "|".join(UNSAFE) + r")\b")) & ~F.contains(s, F.lit(";"))


#: Logical nodes of queries; anything else is refused.
ALLOWED = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct Join Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith WithCTE "
    "UnresolvedHaving Window WithWindowDefinition UnresolvedInlineTable LocalRelation OneRowRelation Generate LateralJoin Pivot Unpivot UnresolvedWithinGroup Deduplicate UnresolvedOrdinal UnresolvedTableValuedFunction GroupingSets RepartitionByExpression UnresolvedHint UnresolvedTransformedPlan Range".split()
)


#: Groups of built-in functions that queries may call: they compute from their arguments alone. Not among them is what
#: calls Java, raises errors on purpose or tells about the session, the machine or its files.
FUNCTION_GROUPS = frozenset("agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs".split())
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


class Refused(ValueError):
    pass


class _Gate:
    """Walks a parsed plan. Names are resolved by scope: a WITH query's name holds for the queries behind it and for the main
    query, within itself only if it is recursive."""

    def __init__(self, spark: SparkSession, tables: set[str], functions: Iterable[str] = ()):
        self.gateway, self.tables = spark.sparkContext._gateway, {t.lower() for t in tables}
        self.functions = {f.lower() for f in functions}
        self.registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def plan(self, plan, bound: frozenset[str]) -> None:
        name = plan.getClass().getSimpleName()
        if name not in ALLOWED:
            raise Refused(f"not a query: {name}")
        if name == "UnresolvedRelation":
            table = plan.multipartIdentifier().mkString(".").lower()
            if table not in bound and table not in self.tables:
                raise Refused(f"unknown table: {table}")
        if name == "UnresolvedTableValuedFunction" and plan.name().mkString(".").lower() not in TABLE_FUNCTIONS:
            raise Refused(f"table function: {plan.name().mkString('.')}")
        if name == "UnresolvedWith":
            ctes, recursive = plan.cteRelations(), plan.allowRecursion()
            for i in range(ctes.size()):
                cte = ctes.apply(i)
                own = cte._1().lower()
                self.plan(cte._2(), bound | {own} if recursive else bound)
                bound = bound | {own}
        for kids, visit in ((plan.children(), self.plan), (plan.expressions(), self.expression)):
            for i in range(kids.size()):
                visit(kids.apply(i), bound)

    def expression(self, e, bound: frozenset[str]) -> None:
        name = e.getClass().getSimpleName()
        if "UnresolvedIdentifier" in name or name in ("CallMethodViaReflection", "TryReflect"):
            raise Refused(f"not allowed: {name}")
        if name in ("UnresolvedFunction", "UnresolvedGenerator"):
            self.function(e.nameParts().mkString(".") if name == "UnresolvedFunction" else e.name().unquotedString())
        if is_instance_of(self.gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            self.plan(e.plan(), bound)
        kids = e.children()
        for i in range(kids.size()):
            self.expression(kids.apply(i), bound)

    def function(self, name: str) -> None:
        if name.lower() in self.functions:
            return
        found = None if "." in name else self.registry.lookupFunction(self.identifier(name.lower()))
        if found is None or found.isEmpty() or found.get().getGroup() not in FUNCTION_GROUPS:
            raise Refused(f"function: {name}")


def check_plan(spark: SparkSession, sql: str, tables: set[str], functions: Iterable[str] = ()) -> None:
    """Refuses what isn't a query over these tables alone, judged by the parsed plan. functions: registered ones that may be called as well."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as e:  # what doesn't parse is refused, whatever the parser throws
        raise Refused(f"not SQL: {str(e)[:200]}") from e
    _Gate(spark, tables, functions).plan(plan, frozenset())


class Catalog:
    """Tables of documents under names that are valid in SQL; the latest registration of a document counts."""

    def __init__(self, spark: SparkSession, functions: Iterable[str] = ()):
        self.spark, self.entries, self.functions = spark, {}, frozenset(functions)

    def register(self, document_key: str, frames: dict[str, DataFrame]) -> list[str]:
        self.remove(document_key)
        names = []
        for name, df in frames.items():
            base = re.sub("_+", "_", re.sub("[^a-zA-Z0-9_]", "_", name.strip())).strip("_").lower()
            base = f"t_{base}" if not base or base[0].isdigit() or base in ("table", "index", "select", "order", "group", "where", "from") else base
            view, k = base, 0
            while view in names or any(view in e for d, e in self.entries.items() if d != document_key):
                k += 1
                view = f"{base}_{k}"
            df.drop("__section__").createOrReplaceTempView(view)
            names.append(view)
        self.entries = {document_key: names} | self.entries
        return names

    def remove(self, document_key: str) -> None:
        for view in self.entries.pop(document_key, []):
            self.spark.catalog.dropTempView(view)

    def tables(self, document_key: str | None = None) -> set[str]:
        return {t for d, e in self.entries.items() if document_key in (None, d) for t in e}

    def save(self, path: str, document_key: str, document_name: str) -> None:
        """Writes a document's tables and its entry in the registry; the latest entry of a document counts."""
        at = f"{path.rstrip('/')}/tables/{uuid.uuid4().hex}"
        names = self.entries[document_key]
        for name in names:
            self.spark.table(name).write.parquet(f"{at}/{name}")
        rows = sum(self.spark.read.parquet(f"{at}/{name}").count() for name in names)
        schema = json.dumps({name: dict(self.spark.table(name).dtypes) for name in names})
        entry = self.spark.createDataFrame([(document_key, document_name, at, schema, names, rows)], "document_key string, document_name string, db_path string, schema_json string, sheet_names array<string>, total_rows bigint")
        entry.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{path.rstrip('/')}/registry")

    def load(self, path: str) -> DataFrame:
        """Registers what was saved, and returns the registry, newest first. The entries, one small row a document, come to the driver."""
        every = latest(self.spark.read.parquet(f"{path.rstrip('/')}/registry"), ["document_key"], ["created_at"])
        for r in every.orderBy("created_at").toLocalIterator():
            self.register(r.document_key, {name: self.spark.read.parquet(f"{r.db_path}/{name}") for name in r.sheet_names})
        return every.orderBy(F.desc("created_at"), "document_key")

    def run(self, sql: str, document_key: str | None = None) -> DataFrame:
        check_plan(self.spark, sql, self.tables(document_key), self.functions)
        return self.spark.sql(sql.strip().rstrip(";"))


def without_fences(answer: str) -> str:
    """A model's SQL without its code fence and final semicolons."""
    m = re.search(r"```(?:\w+)?\s*\n?(.*?)```", answer, re.S)
    return (m[1] if m else answer).strip().rstrip(";").strip()


def ask(catalog: Catalog, question: str, generate: Callable[[str, str | None], str], attempts: int = 3, document_key: str | None = None) -> tuple[str, DataFrame]:
    """Generate, gate, run; on an error the generator gets it and tries again."""
    error: str | None = None
    for _ in range(attempts):
        sql = without_fences(generate(question, error))
        try:
            df = catalog.run(sql, document_key)
            df.schema  # analysis errors show here
            return sql, df
        except Exception as e:  # the generator is told, whatever went wrong
            error = str(e)[:500]
    raise Refused(error or "no attempt")


def as_text(df: DataFrame, most: int = 50) -> str:
    rows = df.limit(most + 1).collect()
    lines = [" | ".join(df.columns), "-+-".join("-" * len(c) for c in df.columns)]
    lines += [" | ".join("" if v is None else str(v) for v in r) for r in rows[:most]]
    return "\n".join(lines + (["... more rows omitted"] if len(rows) > most else []))


def route(question_class: str, has_tables: bool, store_up: bool = True) -> str:
    """`sql` if tables exist and the question computes, or if there is no other store; else `search`."""
    return "sql" if has_tables and (question_class == "sql" or not store_up) else "search"
