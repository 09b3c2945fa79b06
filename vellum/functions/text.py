"""Text expressions: normalising, keys, sentences, quality scores, classifiers and prefixes. All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CHILD_MAX, CHILD_MIN = 512, 90
# Fixed value: where sentences part.
SENTENCE = r"""(?<=[.!?])\s+(?=[A-Z"'\(])|(?<=\n)(?=\S)"""


def ascii_words(pattern: str) -> str:
    r"""The pattern with \b as in SQL's and RE2's: an edge of a word of ASCII letters, digits and underscores. Java counts other letters as well.
    What stands before a group or a digit is a word's beginning, anything else its end."""
    return re.sub(r"\\b(?=\(|\\d)", r"(?<![0-9A-Za-z_])", pattern).replace(r"\b", r"(?![0-9A-Za-z_])")


def strip(c: Column) -> Column:
    """Without outer white space; a pattern would look at every inner space as well."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def collapse(c: Column) -> Column:
    """Single spaces for all white space; single spaces themselves are left alone."""
    return strip(F.regexp_replace(c, r"[\t\n\x0B\f\r]\s*| \s+", " "))


def normalize(c: Column) -> Column:
    """Line ends to \\n, runs of blanks to one, at most one empty line in a row, no outer space."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(c, r"\t[ \t]*| [ \t]+", " "), r"\n{3,}", "\n\n"))


def slug(c: Column, sep: str = "-", default: str = "document") -> Column:
    """Lower case letters and digits, everything else one separator."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", default).otherwise(s)


def document_key(name: Column, external_id: Column) -> Column:
    # The prefixes of keys.
    return F.when(external_id.isNotNull(), F.concat(F.lit("mayan:"), external_id.cast("string"))).otherwise(F.concat(F.lit("upload:"), slug(name)))


def chunk_id(key: Column, ordinal: Column, text: Column) -> Column:
    """A content-derived id, so that a rerun gives the same ids."""
    return F.sha2(F.concat_ws("\x01", key, ordinal.cast("string"), text), 256)


def image_key(path: Column, page: Column, dpi: Column) -> Column:
    """The name under which a page's picture is cached."""
    return F.concat(F.substring(F.md5(path), 1, 12), F.lit("_p"), page.cast("string"), F.lit("_d"), dpi.cast("string"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(F.coalesce(c, F.lit(""))), SENTENCE), strip), lambda s: s != "")


def words(c: Column) -> Column:
    """Lower-case words, as split on white space."""
    return F.filter(F.split(collapse(F.lower(F.coalesce(c, F.lit("")))), " "), lambda w: w != "")


def merge_text(left: Column, right: Column) -> Column:
    a, b = strip(F.coalesce(left, F.lit(""))), strip(F.coalesce(right, F.lit("")))
    return F.when(a == "", b).when(b == "", a).when(F.startswith(b, a), b).when(F.endswith(a, b), a).otherwise(F.concat(a, F.lit("\n"), b))


def letter_ratio(c: Column) -> Column:
    """Letters among visible characters; 0 for blank text."""
    t = strip(F.coalesce(c, F.lit("")))
    shown = F.length(F.regexp_replace(t, r"[\s\p{Cc}\p{Z}]", ""))
    return F.when(t == "", F.lit(0.0)).otherwise(F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(shown, F.lit(1)))


def prefers_ocr(native: Column, ocr: Column) -> Column:
    """Whether a page's scanned text beats its own: where the own text is short, or poor, or much shorter."""
    a, b = strip(F.coalesce(native, F.lit(""))), strip(F.coalesce(ocr, F.lit("")))
    la, lb, ra, rb = F.length(a), F.length(b), letter_ratio(a), letter_ratio(b)
    return (b != "") & (((la < 80) & (lb >= 80)) | ((ra < 0.45) & (rb > ra + 0.1)) | ((la > 0) & (lb > la * 1.5) & (rb >= ra)))


# Words that tell document types.
ACADEMIC = ("abstract", "introduction", "related work", "methodology", "conclusion", "references")
LEGAL = r"(?i)\b(whereas|hereinafter|witnesseth)\b|\b(article\s+\d+|clause\s+\d+)\b"


def doc_type(headings: Column, text: Column, has_images: Column) -> Column:
    """headings: all titles in lower case, joined; text: all text."""
    hits = sum((F.when(F.contains(headings, F.lit(w)), 1).otherwise(0) for w in ACADEMIC), F.lit(0))
    base = F.when(hits >= 3, "research_paper").when(F.coalesce(text, F.lit("")).rlike(ascii_words(LEGAL)), "contract").otherwise("general")
    return F.concat(base, F.when(has_images, "_with_images").otherwise(""))


# Labels of the document store and their types.
TYPE_LABELS = {
    "Research Paper": "research_paper",
    "Contract": "contract",
    "Invoice": "invoice",
    "Resume": "resume",
    "Technical Manual": "technical_manual",
    "Financial Report": "financial_report",
    "Medical Document": "medical_document",
    "Presentation": "presentation",
    "Spreadsheet": "spreadsheet",
}


def overridden_type(label: Column, detected: Column) -> Column:
    """The user's type if its label is known, with the image suffix kept."""
    known = reduce(lambda acc, kv: acc.when(label == kv[0], kv[1]), list(TYPE_LABELS.items())[1:], F.when(label == "Research Paper", "research_paper"))
    return F.when(known.isNotNull(), F.concat(known, F.when(F.endswith(detected, F.lit("_with_images")), "_with_images").otherwise(""))).otherwise(detected)


def type_tag(kind: Column) -> Column:
    return F.concat(F.lit("AI: "), F.initcap(F.replace(F.replace(kind, F.lit("_with_images"), F.lit("")), F.lit("_"), F.lit(" "))))


# Question frames, stripped in this order.
INTENTS = (
    r"^(?:explain|describe|define|summarize|elaborate)\s+(?:the\s+|a\s+|an\s+)?(?:concept\s+of\s+|meaning\s+of\s+|term\s+)?",
    r"^(?:what\s+is|what\s+are|what\s+does|what\s+do)\s+(?:the\s+|a\s+|an\s+)?",
    r"^(?:tell\s+me\s+about|give\s+me\s+info\s+on|give\s+me\s+information\s+about)\s+(?:the\s+)?",
    r"^(?:how\s+does|how\s+do|how\s+is|how\s+are)\s+(?:the\s+)?",
    r"^(?:why\s+is|why\s+are|why\s+does|why\s+do)\s+(?:the\s+)?",
    r"^(?:can\s+you\s+explain|please\s+explain|could\s+you\s+explain)\s+(?:the\s+|a\s+)?",
    r"^(?:show\s+me|find)\s+(?:the\s+|all\s+)?(?:information\s+about\s+|details\s+about\s+|info\s+on\s+)?",
)


def topic(query: Column) -> Column:
    whole = F.lower(strip(query))
    left = strip(reduce(lambda c, p: F.regexp_replace(c, p, ""), INTENTS, whole))
    return F.when(left == "", whole).otherwise(left)


# Vocabularies of the query classifier.
SQL_WORDS = (
    r"\b(sum|total|average|avg|mean|count|how many|how much|max|maximum|highest|largest|biggest|most|min|minimum|lowest|smallest|least|"
    r"greater|less|more than|fewer|between|filter|where|group|sort|order|rank|top|bottom|compare|difference|ratio|percent|percentage|growth|change|"
    r"above|below|exceed|over|under|calculate|compute|add up|subtract|multiply|divide|cost|costs|revenue|income|expense|expenses|profit|loss|"
    r"assets|liabilities|equity|cash|debt|margin|balance|operating|net|gross|include all|show me|list all|give me|what was|what were)\b"
)
MEANING_WORDS = (
    r"\b(what is|what are|explain|describe|tell me about|define|meaning|overview|summary|summarize|who|why|how does|how do|"
    r"find information|search for|look up|related to|about|regarding|concerning)\b"
)
FRAME = r"^(what is|what are|how much|how many)\b"
STRONG_SQL = r"\b(sum|total|average|avg|mean|count|max|maximum|min|minimum|highest|lowest|how many|how much|top|bottom|rank|filter|group)\b"


def query_class(query: Column) -> Column:
    """`sql` if signs of computation outnumber signs of meaning, else `semantic`."""
    q = strip(F.coalesce(query, F.lit("")))
    n = lambda p: F.regexp_count(q, F.lit("(?i)" + ascii_words(p)))
    has = lambda p: q.rlike(ascii_words(p))
    compared = F.when(q.rlike(r"[<>=!]{1,2}\s*\d"), 2).otherwise(0)
    first = n(SQL_WORDS) + compared
    signs = first + F.when(has(r"\b\d+(?:\.\d+)?\b") & (first > 0), 1).otherwise(0) + F.when(has("(?i)" + FRAME) & has("(?i)" + STRONG_SQL), 1).otherwise(0)
    return F.when(signs > n(MEANING_WORDS), "sql").otherwise("semantic")


def context_prefix(title: Column, kind: Column, section: Column, page: Column) -> Column:
    """A sentence that places a chunk in its document; sheets have a form of their own."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    said = F.when(empty(kind), "document").otherwise(F.replace(kind, F.lit("_"), F.lit(" ")))
    summary = F.concat(F.lit("This is a "), said, F.lit(" titled '"), title, F.lit("'."))
    has_page = F.coalesce(page, F.lit(0)) != 0
    plain = F.concat(F.lit("From '"), title, F.lit("'"), F.when(empty(kind) | kind.isin("general", "general_with_images"), "").otherwise(F.concat(F.lit(" ("), said, F.lit(")"))))
    where = F.concat_ws(", ", F.when(~empty(section) & ~section.isin("[body]", "[image]", "[ocr]"), F.concat(F.lit("section '"), section, F.lit("'"))), F.when(has_page, F.concat(F.lit("page "), page.cast("string"))))
    sheet = F.concat(F.lit("From spreadsheet '"), title, F.lit("'"), F.when(~empty(section) & ~section.isin("[body]", "Columns"), F.concat(F.lit(", sheet '"), section, F.lit("'"))).otherwise(""), F.when(has_page, F.concat(F.lit(" (sheet "), page.cast("string"), F.lit(")"))).otherwise(""), F.lit(". "), summary)
    return F.when(F.coalesce(kind, F.lit("")) == "spreadsheet", sheet).when(where == "", F.concat(plain, F.lit(". "), summary)).otherwise(F.concat(plain, F.lit(", "), where, F.lit(". "), summary))


def context_window(parent: Column, child: Column, budget: int) -> Column:
    """At most `budget` characters of the parent around the child's place; its start if the child isn't found."""
    core = F.regexp_replace(F.regexp_replace(child, r"^(?s)\[Section:.*?\] ", ""), r"^(?s)\[Clause:.*?\] ", "")
    found = F.instr(parent, F.substring(core, 1, 80)) - 1
    n = F.length(parent)
    begin = F.greatest(F.lit(0), found - budget // 2)
    end = F.least(n, begin + budget)
    begin = F.when(end - begin < budget, F.greatest(F.lit(0), end - budget)).otherwise(begin)
    window = F.concat(F.when(begin > 0, "...").otherwise(""), F.substr(parent, begin + 1, end - begin), F.when(end < n, "...").otherwise(""))
    return F.when(found < 0, F.substring(parent, 1, budget)).otherwise(window)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def overlap(a: Column, b: Column) -> Column:
    """Of two texts with single spaces: 1 if equal or either is empty, the ratio of their lengths if one holds the other, else 0."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == "") | (a == b), F.lit(1.0)).when(F.contains(a, b) | F.contains(b, a), short / long).otherwise(F.lit(0.0))


def duplicate_ratio(parent: Column, child: Column) -> Column:
    return overlap(collapse(F.coalesce(parent, F.lit(""))), collapse(F.coalesce(child, F.lit(""))))


def duplicate_ratios(parent: Column, children: Column) -> Column:
    """The ratio of each child; the parent is prepared once."""
    return let(collapse(F.coalesce(parent, F.lit(""))), lambda a: F.transform(children, lambda c: overlap(a, collapse(F.coalesce(c, F.lit(""))))))


def is_duplicate_of(a: Column, b: Column) -> Column:
    """Of two texts with single spaces: whether a child says about all that its parent says."""
    return (a == "") | (b == "") | (a == b) | (F.contains(a, b) & (F.length(b) >= F.length(a) * 0.95))


# Markup and prefixes that don't count when texts are compared for coverage.
MARKUP = ((r"\*\*(.+?)\*\*", "$1"), (r"_(.+?)_", "$1"), (r"\*(.+?)\*", "$1"), (r"^#{1,6}\s+", ""), (r"`([^`]+)`", "$1"), (r"\|[-:| ]+\|", ""), (r"\|", " "), (r"\s+", " "))
PREFIXES = (r"^\[section:\s*[^\]]*\]\s*", r"^\[clause:\s*[^\]]*\]\s*", r"^\[table[^\]]*\]\s*", r"^\[figure[^\]]*\]\s*", r"^from\s+'[^']+'\s+\([^)]+\),\s+section\s+'[^']+',\s+page\s+\d+\.\s*", r"^this is a [^.]+\.\s*", r"\[[\d,\x{2217}\x{2020}]+\]")


def coverage_form(c: Column) -> Column:
    """Text as compared for coverage: no markup, no chunk prefixes, single spaces, lower case."""
    plain = F.lower(strip(reduce(lambda x, m: F.regexp_replace(x, *m), MARKUP, F.coalesce(c, F.lit("")))))
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), PREFIXES, plain)


def covered_lines(lines: Column, chunks: Column) -> Column:
    """How many of a page's lines are in one of its chunks, whole or, beyond 15 characters, by their first 40; very short ones count."""
    form = F.transform(lines, coverage_form)
    hit = lambda held: lambda t: (F.length(t) < 3) | F.exists(held, lambda c: F.contains(c, t) | ((F.length(t) > 15) & F.contains(c, F.substring(t, 1, 40))))
    return let(F.transform(chunks, coverage_form), lambda held: F.size(F.filter(form, hit(held))))


# Patterns of list items, subsections and front matter; titles that are skipped.
LIST_ITEM = r"^\s*(?:\d+[.):]\s|[-•*]\s|[a-z][.)]\s|\([a-z]\)\s)"
SUBSECTION = r"^(?:\d+\.\d+[\.\d]*\.?\s|[A-Z]\.\d+\.?\s|Appendix\s+[A-Z])"
FRONT_MATTER = r"(?i)@[\w.-]+\.\w{2,}|university\s+of\b|\binstitut\w*\b|\bdepartment\s+of\b|\bcollege\s+of\b"
SKIPPED_SECTIONS = ("references", "bibliography", "acknowledgments", "acknowledgements")


def is_list(content: Column) -> Column:
    """Two item lines at least, and more than two in five."""
    lines = F.split(strip(content), "\n", -1)
    n = F.size(F.filter(lines, lambda x: x.rlike(LIST_ITEM)))
    return (n >= 2) & (n / F.size(lines) > 0.4)


def is_subsection(c: Column) -> Column:
    t = strip(c)
    return (F.length(t) <= 80) & ~F.contains(t, F.lit("\n")) & t.rlike(SUBSECTION)


def is_heading_stub(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return (F.size(F.split(t, r"\s+")) <= 8) & ~F.contains(t, F.lit("\n"))


# Fixed values of the strict heading policy.
NUMBERED = r"^(?:\d+\.\s|\d+\.\d+[\.\d]*\.?\s|[A-Z]\.\s|[A-Z]\.\d+[\.\d]*\.?\s|Appendix\s+[A-Z])"
MAJOR = ("abstract", "introduction", "conclusion", "conclusions", "references", "bibliography", "acknowledgments", "acknowledgements", "related work", "methodology", "methods", "results", "discussion", "appendix", "supplementary material")
NOISE = r"^https?://|^[{<\[]|@[\w.-]+\.\w{2,}|^[\d\s.,]+$|^\d+[A-Z]"
SYMBOLS = r"[\x{300}-\x{36f}\x{2000}-\x{2bff}\x{1d400}-\x{1d7ff}]"


def element_level(category: Column, text: Column) -> Column:
    """Heading level of a layout element: 1 major, 2 minor, 3 body."""
    t = strip(text)
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    numbered = t.rlike(NUMBERED)
    rank = F.when(t.rlike(r"^\d+\.\s") & ~t.rlike(r"^\d+\.\d+"), 1).otherwise(2)
    item = F.when(numbered & (F.length(t) <= 50) & (letters >= 3) & (F.size(F.split(t, r"\s+")) <= 8), rank).otherwise(3)
    refused = ~category.isin("Title", "Header") | (F.length(t) <= 3) | (F.length(t) > 80) | t.rlike(NOISE) | t.rlike(SYMBOLS) | (letters < 3)
    return F.when(category == "ListItem", item).when(refused, 3).when(numbered, rank).when(F.lower(t).isin(*MAJOR), 1).otherwise(3)


def plain_markdown(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\*\*(.+?)\*\*", "$1"), r"_(.+?)_", "$1"), r"\*(.+?)\*", "$1"))


# Words that aren't marked.
UNMARKED = frozenset("what the are how does where when which who can for with from this that about tell find show".split())


def highlighted(text: Column, query: str) -> Column:
    """Words of the query, longer than two letters and none of the stop list, marked in the text."""
    found = sorted({w for w in query.lower().split() if len(w) > 2} - UNMARKED, key=lambda w: (-len(w), w))
    return F.regexp_replace(text, "(?i)(" + "|".join(map(re.escape, found)) + ")", "<mark>$1</mark>") if found else text


# Words that no phrase is looked up by.
UNSOUGHT = UNMARKED | frozenset("being used also more into been have has was were will would could should than they their these those some such only very just but and not all any each every its".split())


def highlight_terms(query: str, match: Column, phrases: int = 3) -> Column:
    """Phrases of four words of the matched text that hold a word of the query, three at most, none overlapping; else four of its words."""
    sought = [w for w in query.lower().split() if len(w) > 2 and w not in UNSOUGHT]
    plain = F.regexp_replace(match, r"\[(?:Section|Clause):.*?\]\s*", "")
    # A sought word has no space, so it lies in one word; only phrases around such words are looked at. All words are cleaned in one go.
    words = F.split(F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"[^a-zA-Z0-9\s-]", ""), " ", -1)
    holds = lambda p: reduce(lambda a, w: a | F.contains(p, F.lit(w)), sought, F.lit(False))
    fits = lambda p: (F.length(p) > 10) & (F.length(p) < 60) & holds(F.lower(p))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"))

    def found(words: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            taken = lambda p: F.when(fits(p), F.struct(F.concat(s["out"], F.array(p)).alias("out"), (i + 4).alias("next"))).otherwise(s)
            return F.when((i < s["next"]) | (F.size(s["out"]) >= phrases), s).otherwise(let(F.trim(F.array_join(F.slice(words, i + 1, F.lit(4)), " ")), taken))

        last = F.size(words) - 3
        near = lambda w, i: F.when((last >= 0) & (i <= last + 2) & holds(F.lower(w)), F.sequence(F.greatest(i - 3, F.lit(0)), F.least(i, last)))
        places = F.flatten(F.filter(F.transform(words, near), lambda x: x.isNotNull()))
        return F.aggregate(places, start, step, lambda s: s["out"])

    # Inside a lambda an expression is worked out at each step, so what all steps share is a variable.
    return let(let(words, found), lambda out: F.when(F.size(out) > 0, out).otherwise(F.array(*map(F.lit, sought[:4])).cast("array<string>")))


# Patterns of facts, with what their groups make.
FACTS = (
    ("Payment Terms", r"(?i)(?:net|payment)\s*(?:terms?:?\s*)?(\d+)\s*days?", "Net ", " days"),
    ("Interest/Fee", r"(?i)(\d+(?:\.\d+)?\s*%\s*(?:monthly|annual|per))\s*(?:interest|fee)", "", ""),
    ("Amount", r"(\$[\d,]+(?:\.\d{2})?)", "", ""),
    ("Effective Date", r"(?i)effective\s+(\w+\s+\d{1,2},?\s+\d{4})", "", ""),
)


def facts(text: Column) -> Column:
    """array<struct<label, value>>: what the patterns find, by pattern and then by place; no model is asked."""
    one = lambda label, pattern, before, after: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.struct(F.lit(label).alias("label"), F.concat(F.lit(before), v, F.lit(after)).alias("value")))
    return F.concat(*[one(*f) for f in FACTS])


def column_index(letters: Column) -> Column:
    """A is 0, AA is 26."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1


def column_letters(index: Column) -> Column:
    i = index.cast("int")
    one = lambda n: F.char(n % 26 + 65)
    return F.when(i < 26, one(i)).when(i < 702, F.concat(one(F.floor(i / 26).cast("int") - 1), one(i))).otherwise(F.concat(one(F.floor((i - 702) / 676).cast("int")), one(F.floor((i - 26) / 26).cast("int") % 26), one(i)))


def sql_identifier(c: Column, prefix: str = "c_", default: str = "col") -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(c), "[^a-zA-Z0-9_]", "_"), "_+", "_"), "^_+|_+$", ""))
    s = F.when(s == "", default).otherwise(s)
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit(prefix), s)).otherwise(s)


# Words that name no table.
RESERVED = ("table", "index", "select", "order", "group", "where", "from")


def sql_table_name(c: Column) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(c), "[^a-zA-Z0-9_]", "_"), "_+", "_"), "^_+|_+$", ""))
    s = F.when((s == "") | s.rlike("^[0-9]"), F.concat(F.lit("t_"), s)).otherwise(s)
    return F.when(s.isin(*RESERVED), F.concat(F.lit("t_"), s)).otherwise(s)
