"""Queries on texts: normalising, keys, sentences, packing, structure, classifiers, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds
from ..operators.splitter import recursive_split
from ..operators.structure import line_sections
from ..sources.tables import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def s_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def s_norm(x: str) -> str:
    return s_strip(rf"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10)||chr(10), 'g')")


def s_sentences(x: str) -> str:
    cut = rf"""regexp_replace(regexp_replace({s_strip(f"coalesce({x}, '')")}, '([.!?])\s+([A-Z"''(])', '\1'||chr(1)||'\2', 'g'), '\n(\S)', chr(10)||chr(1)||'\1', 'g')"""
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {s_strip('s')}), lambda s: s <> '')"


def s_packed(parts: str, joiner: str = "' '", limit: int = 512, least: int = 90) -> str:
    """The fold with a string for its state: finished chunks and the open one, separated by chr(2)."""
    step = f"CASE WHEN length(list_last(string_split(a, chr(2)))) + length({joiner}) + length(x) > {limit} THEN a || chr(2) || x ELSE a || {joiner} || x END"
    return f"list_filter(CASE WHEN len({parts}) = 0 THEN [] ELSE string_split(list_reduce({parts}, lambda a, x: {step}), chr(2)) END, lambda c: length(c) >= {least})"


def s_unnested(arrays: str, name: str) -> str:
    """Rows (doc_id, pos, name) from a subquery with doc_id and an array v."""
    return f"SELECT doc_id, p::BIGINT AS pos, v[p] AS {name} FROM (SELECT doc_id, v, unnest(range(1, len(v) + 1)) AS p FROM ({arrays}))"


def exploded(df: DataFrame, array: Column, name: str) -> DataFrame:
    return df.select("doc_id", F.posexplode(array).alias("p", name)).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), name)


def docs(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, {s_norm('text')} AS body, length({s_norm('text')})::BIGINT AS n FROM documents")
def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("body")).withColumn("n", F.length("body").cast("long"))


_slug = r"coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document')"


@query(f"SELECT doc_id, {_slug.format('text')} AS slug, CASE WHEN doc_id % 3 = 0 THEN 'mayan:' || doc_id ELSE 'upload:' || {_slug.format('source')} END AS document_key FROM documents")
def slug_keys(spark, sf_dir):
    d = docs(spark, sf_dir)
    external = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))
    return d.select("doc_id", T.slug(F.col("text")).alias("slug"), T.document_key(F.col("source"), external).alias("document_key"))


@query(s_unnested(f"SELECT doc_id, {s_sentences('text')} AS v FROM documents", "sentence"))
def sentence_split(spark, sf_dir):
    return exploded(docs(spark, sf_dir), T.sentences(F.col("text")), "sentence")


def chunk_rows(spark, sf_dir) -> DataFrame:
    """doc_id, pos, chunk: sentences packed into children."""
    d = docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return exploded(d, folds.packed(F.col("s"), " "), "chunk")


S_CHUNKS = s_unnested(f"SELECT doc_id, {s_packed('s')} AS v FROM (SELECT doc_id, {s_sentences('text')} AS s FROM documents)", "chunk")
QUERIES["sentence_accumulate"], ORACLES["sentence_accumulate"] = chunk_rows, S_CHUNKS


@query(s_unnested(f"""SELECT doc_id, {s_packed('s', 'chr(10)')} AS v FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace('- ' || replace(text, chr(10), chr(10) || '- '), '\\n(\\s*[-•*]\\s)', chr(1) || chr(10) || '\\1', 'g'), chr(1)), lambda s: {s_strip('s')}), lambda s: s <> '') AS s FROM documents)""", "chunk"))
def list_pack(spark, sf_dir):
    items = F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))
    return exploded(docs(spark, sf_dir).select("doc_id", items.alias("items")), folds.packed_list(F.col("items")), "chunk")


@query()
def recursive_splits(spark, sf_dir):
    return exploded(docs(spark, sf_dir).select("doc_id", "text"), recursive_split(F.col("text")), "chunk")


def _as_sections(text: Column, title: Column) -> Column:
    line = lambda x, i: F.struct(title.alias("title"), F.lit(3).alias("level"), x.alias("content"), F.lit("text").alias("section_type"), F.array(F.struct((i + 1).cast("int").alias("line_number"), x.alias("text"))).alias("lines"))
    return F.transform(F.split(text, "\n", -1), line)


@query(
    s_unnested(
        f"""SELECT doc_id, CASE WHEN len(s) = 0 THEN [] ELSE string_split(list_reduce(s, lambda a, x:
        CASE WHEN least(length(list_last(string_split(a, chr(2)))), length(x)) > 220 AND length(list_last(string_split(a, chr(2)))) > 120 THEN a || chr(2) || x
             WHEN starts_with(x, list_last(string_split(a, chr(2)))) THEN substr(a, 1, length(a) - length(list_last(string_split(a, chr(2))))) || x
             WHEN ends_with(list_last(string_split(a, chr(2))), x) THEN a ELSE a || chr(10) || x END), chr(2)) END AS v
        FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {s_norm('l')}), lambda l: l <> '') AS s FROM documents)""",
        "content",
    )
)
def section_prepare(spark, sf_dir):
    made = folds.prepared_sections(_as_sections(F.col("text"), F.lit("[body]")))
    return exploded(docs(spark, sf_dir).select("doc_id", "text"), F.transform(made, lambda s: s["content"]), "content")


@query(
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents), p AS (SELECT doc_id, v, unnest(range(1, (len(v) + 1) // 2 + 1)) AS k FROM l),
    t AS (SELECT doc_id, k, {s_strip('v[2*k-1]')} AS a, CASE WHEN 2*k <= len(v) THEN {s_strip('v[2*k]')} END AS b, v[2*k-1] AS raw FROM p)
    SELECT doc_id, (2*k-1)::BIGINT AS page_number, CASE WHEN b IS NULL THEN raw WHEN a = '' THEN b WHEN b = '' THEN a WHEN starts_with(b, a) THEN b WHEN ends_with(a, b) THEN a ELSE a || chr(10) || b END AS content FROM t"""
)
def cross_page_merge(spark, sf_dir):
    """Each line is a page with one section of the same title: pages merge in pairs, as the emptied page ends the chain."""
    made = _as_sections(F.col("text"), F.lit("Chapter"))
    pages = F.transform(made, lambda s, i: F.struct((i + 1).cast("int").alias("page_number"), F.array(s).alias("sections")))
    d = docs(spark, sf_dir).select("doc_id", F.explode(folds.merged_across_pages(pages)).alias("p"))
    return d.select("doc_id", F.col("p.page_number").cast("long").alias("page_number"), F.explode("p.sections").alias("s")).select("doc_id", "page_number", "s.content")


_md = "CASE WHEN length(line) < 40 THEN '## ' || line WHEN contains(line, ' | ') THEN '| ' || line || ' |' ELSE line END"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
    m AS (SELECT doc_id, n, regexp_replace({_md}, '\\s+$', '') AS line FROM l),
    k AS (SELECT doc_id, n, line, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN 'heading' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table' WHEN regexp_matches(line, '^\\s*$') THEN 'blank' ELSE 'text' END AS kind FROM m),
    h AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS head FROM k),
    c AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM h),
    f AS (SELECT *, last_value(CASE WHEN kind IN ('table', 'text') THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id, head ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c),
    b AS (SELECT *, sum(CASE WHEN kind = 'heading' OR (kind IN ('table', 'text') AND (prev IS DISTINCT FROM kind OR (kind = 'table' AND before = 'blank'))) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM f WHERE kind <> 'blank'),
    t AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^#+\\s+', ''), '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '_(.+?)_', '\\1', 'g'), '\\*(.+?)\\*', '\\1', 'g')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS title FROM b)
    SELECT doc_id, min(n)::BIGINT AS first_line, count(*)::BIGINT AS n_lines, max(kind) AS kind, coalesce(CASE WHEN max(kind) = 'table' THEN '[Table on page 1]' ELSE max(title) END, '[body]') AS title FROM t GROUP BY doc_id, block"""
)
def markdown_sections(spark, sf_dir):
    line = lambda x: F.when(F.length(x) < 40, F.concat(F.lit("## "), x)).when(F.contains(x, F.lit(" | ")), F.concat(F.lit("| "), x, F.lit(" |"))).otherwise(x)
    pages = docs(spark, sf_dir).select(F.col("doc_id").alias("document_key"), F.lit(1).alias("page_number"), F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("markdown"))
    s = line_sections(pages)
    return s.select(F.col("document_key").alias("doc_id"), F.col("first_line").cast("long").alias("first_line"), F.col("n_lines").cast("long").alias("n_lines"), F.when(F.col("section_type") == "list", "text").otherwise(F.col("section_type")).alias("kind"), "title")


_item = r"'^\s*(?:\d+[.):]\s|[-•*]\s|[a-z][.)]\s|\([a-z]\)\s)'"


@query(f"""SELECT doc_id, n_items::BIGINT AS n_items, (n_items >= 2 AND n_items / n_lines > 0.4) AS is_list FROM (SELECT doc_id, len(list_filter(v, lambda x: regexp_matches(x, {_item}))) AS n_items, len(v) AS n_lines FROM (SELECT doc_id, string_split({s_strip("replace(text, '. ', chr(10) || '- ')")}, chr(10)) AS v FROM documents))""")
def list_detect(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit(". "), F.lit("\n- ")).alias("t"))
    n = F.size(F.filter(F.split(T.strip(F.col("t")), "\n", -1), lambda x: x.rlike(T.LIST_ITEM)))
    return d.select("doc_id", n.cast("long").alias("n_items"), T.is_list(F.col("t")).alias("is_list"))


_kw = " + ".join(f"contains(h, '{w}')::INT" for w in T.ACADEMIC)


@query(
    f"""WITH d AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' whereas it stands' WHEN 1 THEN ' Clause 7' ELSE '' END AS t, CASE WHEN doc_id % 4 = 0 THEN 'abstract introduction of methodology and conclusion' ELSE 'notes' END AS h, doc_id % 7 = 0 AS i FROM documents)
    SELECT doc_id, CASE WHEN {_kw} >= 3 THEN 'research_paper' WHEN regexp_matches(t, '(?i)\\b(whereas|hereinafter|witnesseth)\\b|\\b(article\\s+\\d+|clause\\s+\\d+)\\b') THEN 'contract' ELSE 'general' END || CASE WHEN i THEN '_with_images' ELSE '' END AS doc_type FROM d"""
)
def doc_type_detect(spark, sf_dir):
    d = docs(spark, sf_dir)
    said = F.when(F.col("doc_id") % 5 == 0, " whereas it stands").when(F.col("doc_id") % 5 == 1, " Clause 7").otherwise("")
    heads = F.when(F.col("doc_id") % 4 == 0, "abstract introduction of methodology and conclusion").otherwise("notes")
    return d.select("doc_id", T.doc_type(heads, F.concat("text", said), F.col("doc_id") % 7 == 0).alias("doc_type"))


@query("""SELECT doc_id, CASE WHEN lab IN ('Contract', 'Invoice') THEN lower(lab) || CASE WHEN doc_id % 2 = 0 THEN '_with_images' ELSE '' END ELSE kind END AS doc_type, 'AI: ' || CASE WHEN lab IN ('Contract', 'Invoice') THEN lab ELSE 'General' END AS tag
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Contract' WHEN 1 THEN 'Invoice' ELSE 'Default' END AS lab, CASE WHEN doc_id % 2 = 0 THEN 'general_with_images' ELSE 'general' END AS kind FROM documents)""")
def title_override(spark, sf_dir):
    label = F.when(F.col("doc_id") % 3 == 0, "Contract").when(F.col("doc_id") % 3 == 1, "Invoice").otherwise("Default")
    kind = F.when(F.col("doc_id") % 2 == 0, "general_with_images").otherwise("general")
    d = docs(spark, sf_dir).select("doc_id", T.overridden_type(label, kind).alias("doc_type"))
    return d.withColumn("tag", T.type_tag(F.col("doc_type")))


def _s_ratio(t: str) -> str:
    return f"CASE WHEN {t} = '' THEN 0.0::DOUBLE ELSE length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) / greatest(length(regexp_replace({t}, '[\\s\\p{{Cc}}\\p{{Z}}]', '', 'g')), 1) END"


@query(
    f"""WITH j AS (SELECT d.doc_id, {s_strip("CASE WHEN d.doc_id % 3 = 0 THEN d.source ELSE d.text END")} AS a, {s_strip("coalesce(p.html, '')")} AS b FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id),
    r AS (SELECT *, {_s_ratio('a')} AS ra, {_s_ratio('b')} AS rb FROM j)
    SELECT doc_id, b <> '' AND ((length(a) < 80 AND length(b) >= 80) OR (ra < 0.45 AND rb > ra + 0.1) OR (length(a) > 0 AND length(b) > length(a) * 1.5 AND rb >= ra)) AS use_ocr, round(ra, 6) AS native_ratio FROM r"""
)
def ocr_choice(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("text")).alias("native"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("ocr"))
    return d.join(p, "doc_id", "left").select("doc_id", T.prefers_ocr(F.col("native"), F.col("ocr")).alias("use_ocr"), F.round(T.letter_ratio(F.col("native")), 6).alias("native_ratio"))


@query(
    r"""WITH m AS (SELECT page_id, regexp_extract_all(html, '(?s)<(?:h[1-6]|p)[^>]*>[^<]*') AS v FROM pages), u AS (SELECT page_id, unnest(v) AS m, unnest(range(1, len(v) + 1)) AS pos FROM m)
    SELECT page_id, pos::BIGINT AS pos, CASE WHEN regexp_matches(m, '^<h') THEN least(regexp_extract(m, '^<h([1-6])', 1)::INT, 3) ELSE 3 END::BIGINT AS level, trim(regexp_replace(regexp_replace(m, '^<[^>]*>', ''), '\s+', ' ', 'g')) AS content FROM u"""
)
def html_sections(spark, sf_dir):
    from ..operators.structure import html_blocks

    return html_blocks(table(spark, sf_dir, "pages")).select("page_id", "pos", "level", "content")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'From spreadsheet ''' || source || ''', sheet ''' || lang || ''' (sheet 2). This is a spreadsheet titled ''' || source || '''.'
    WHEN doc_id % 4 = 0 THEN 'From ''' || source || ''', section ''' || lang || ''', page 2. This is a general titled ''' || source || '''.'
    WHEN doc_id % 4 = 1 THEN 'From ''' || source || ''' (research paper), page 2. This is a research paper titled ''' || source || '''.'
    ELSE 'From ''' || source || ''' (contract), section ''' || lang || '''. This is a contract titled ''' || source || '''.' END AS prefix FROM documents"""
)
def context_prefix(spark, sf_dir):
    i = F.col("doc_id") % 4
    kind = F.when(i == 3, "spreadsheet").when(i == 0, "general").when(i == 1, "research_paper").otherwise("contract")
    section, page = F.when(i == 1, "[body]").otherwise(F.col("lang")), F.when(i == 2, 0).otherwise(2)
    return docs(spark, sf_dir).select("doc_id", T.context_prefix(F.col("source"), kind, section, page).alias("prefix"))


def _questions(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    q = lambda start: F.concat(F.lit(start), "text")
    i = (F.col("conv_id") + F.col("turn")) % 6
    said = F.when(i == 0, q("What is the total of ")).when(i == 1, q("Explain the concept of ")).when(i == 2, q("Show me all information about ")).when(i == 3, q("How many rows where x > 5 in ")).when(i == 4, q("Please explain the average ")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", said.alias("q"))


_Q = """SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'What is the total of ' || text WHEN 1 THEN 'Explain the concept of ' || text WHEN 2 THEN 'Show me all information about ' || text
    WHEN 3 THEN 'How many rows where x > 5 in ' || text WHEN 4 THEN 'Please explain the average ' || text ELSE text END AS q FROM conversations"""


def _s_topic() -> str:
    out = f"lower({s_strip('q')})"
    for p in T.INTENTS:
        out = f"regexp_replace({out}, '{p}', '')"
    return f"coalesce(nullif({s_strip(out)}, ''), lower({s_strip('q')}))"


@query(f"SELECT conv_id, turn, {_s_topic()} AS topic FROM ({_Q})")
def topic_extract(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", T.topic(F.col("q")).alias("topic"))


def _s_count(p: str) -> str:
    return f"len(regexp_extract_all(q, '(?i){p}'))"


@query(
    f"""WITH c AS (SELECT conv_id, turn, {s_strip('q')} AS q FROM ({_Q})), n AS (SELECT *, {_s_count(T.SQL_WORDS)} + CASE WHEN regexp_matches(q, '[<>=!]{{1,2}}\\s*\\d') THEN 2 ELSE 0 END AS a, {_s_count(T.MEANING_WORDS)} AS b FROM c)
    SELECT conv_id, turn, CASE WHEN a + CASE WHEN regexp_matches(q, '\\b\\d+(?:\\.\\d+)?\\b') AND a > 0 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(q, '(?i){T.FRAME}') AND regexp_matches(q, '(?i){T.STRONG_SQL}') THEN 1 ELSE 0 END > b THEN 'sql' ELSE 'semantic' END AS kind FROM n"""
)
def query_classify(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", T.query_class(F.col("q")).alias("kind"))


@query(
    f"""WITH c AS ({S_CHUNKS}), d AS (SELECT doc_id, {s_norm('text')} AS t FROM documents)
    SELECT c.doc_id, c.pos, CASE WHEN instr(t, substr(chunk, 1, 80)) = 0 THEN substr(t, 1, 600) ELSE
      CASE WHEN b > 0 THEN '...' ELSE '' END || substr(t, b + 1, e - b) || CASE WHEN e < length(t) THEN '...' ELSE '' END END AS context
    FROM (SELECT c.*, d.t, least(length(t), greatest(0, instr(t, substr(chunk, 1, 80)) - 1 - 300) + 600) AS e, CASE WHEN least(length(t), greatest(0, instr(t, substr(chunk, 1, 80)) - 1 - 300) + 600) - greatest(0, instr(t, substr(chunk, 1, 80)) - 1 - 300) < 600
      THEN greatest(0, least(length(t), greatest(0, instr(t, substr(chunk, 1, 80)) - 1 - 300) + 600) - 600) ELSE greatest(0, instr(t, substr(chunk, 1, 80)) - 1 - 300) END AS b FROM c JOIN d USING (doc_id)) c"""
)
def context_window(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("parent"))
    c = chunk_rows(spark, sf_dir)
    return c.join(d, "doc_id").select("doc_id", "pos", T.context_window(F.col("parent"), F.concat(F.lit("[Section: x] "), F.col("chunk")), 600).alias("context"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
    SELECT doc_id, n::BIGINT AS line_number, line, coalesce(lag(line, 2) OVER w, '') || '~' || coalesce(lag(line, 1) OVER w, '') AS before, coalesce(lead(line, 1) OVER w, '') || '~' || coalesce(lead(line, 2) OVER w, '') AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)"""
)
def context_lines(spark, sf_dir):
    """Two lines of context on either side, taken from the document's own array: no shuffle."""
    d = docs(spark, sf_dir).select("doc_id", F.split("text", "\n", -1).alias("l")).select("doc_id", "l", F.posexplode("l").alias("p", "line"))
    at = lambda k: F.coalesce(F.get("l", F.col("p") + k), F.lit(""))
    return d.select("doc_id", (F.col("p") + 1).cast("long").alias("line_number"), "line", F.concat(at(-2), F.lit("~"), at(-1)).alias("before"), F.concat(at(1), F.lit("~"), at(2)).alias("after"))


@query(
    """WITH RECURSIVE n AS (SELECT lang, source, doc_id, dense_rank() OVER (PARTITION BY lang ORDER BY source)::BIGINT AS k, sum(length(left(text, 500)) + 5) OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents),
    walk AS (SELECT DISTINCT lang, 0::BIGINT AS k, 0::HUGEINT AS used FROM n
      UNION ALL SELECT w.lang, w.k + 1, w.used + coalesce((SELECT max(r) FROM n WHERE n.lang = w.lang AND n.k = w.k + 1 AND w.used + r <= 12000), 0) FROM walk w WHERE w.k < 20)
    SELECT w.lang, n.source, w.k, (w.used - b.used)::BIGINT AS taken FROM walk w JOIN walk b ON b.lang = w.lang AND b.k = w.k - 1 JOIN (SELECT DISTINCT lang, source, k FROM n) n ON n.lang = w.lang AND n.k = w.k"""
)
def context_budget(spark, sf_dir):
    """The characters that each source takes of its language's budget, source by source."""
    from ..operators.retrieval import budget_by_group

    d = docs(spark, sf_dir).select("lang", "source", "doc_id", F.concat(F.substring("text", 1, 500), F.lit("#####")).alias("part"))
    taken = budget_by_group(d, "lang", "source", "doc_id", "part", 12_000)
    return taken.select("lang", "source", "k", F.length("taken").cast("long").alias("taken"))
