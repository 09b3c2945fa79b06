"""Order-dependent folds over one document's array: packing, section preparation and merging across pages.

Each is one `aggregate` over a sorted array, so a document is folded where its row is and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import CHILD_MAX, CHILD_MIN, let, merge_text, normalize, strip


def packed(parts: Column, joiner: str, limit: int = CHILD_MAX, least: int = CHILD_MIN) -> Column:
    """Parts joined greedily up to `limit` characters; a longer single part stays whole, results below `least` go."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        both = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(joiner), x))
        full = (F.length(both) > limit) & (s["open"] != "")
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"), F.when(full, x).otherwise(both).alias("open"))

    finish = lambda s: F.filter(F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))), lambda c: F.length(c) >= least)
    return F.aggregate(parts, start, step, finish)


LIST_CUT = r"(?=\n\s*(?:\d+[.):]\s|[-•*]\s|[a-z][.)]\s))"


def packed_list(content: Column, limit: int = CHILD_MAX, least: int = CHILD_MIN) -> Column:
    items = F.filter(F.transform(F.split(content, LIST_CUT), strip), lambda x: x != "")
    return packed(items, "\n", limit, least)


def limited(chunks: Column, sentences_of, limit: int = CHILD_MAX, least: int = CHILD_MIN) -> Column:
    """Small chunks join their neighbours, a small last one its predecessor, large ones are cut by sentences."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        both = strip(F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(" "), x)))
        fits = F.length(both) <= limit
        flushed = F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.when(x == "", s).otherwise(F.struct(F.when(fits, s["done"]).otherwise(flushed).alias("done"), F.when(fits, both).otherwise(x).alias("open")))

    def finish(s: Column) -> Column:
        n = F.size(s["done"])
        tail = (F.length(s["open"]) < least) & (n > 0)
        joined = F.concat(F.slice(s["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(s["done"], F.lit(-1)), F.lit(" "), s["open"])))
        return F.when(s["open"] == "", s["done"]).when(tail, joined).otherwise(F.concat(s["done"], F.array(s["open"])))

    merged = F.aggregate(chunks, start, step, finish)
    cut = F.flatten(F.transform(merged, lambda c: F.when(F.length(c) <= limit, F.array(c)).otherwise(packed(sentences_of(c), " ", limit, least))))
    return F.filter(cut, lambda c: F.length(c) >= least)


SECTION = "struct<title:string,level:int,content:string,section_type:string,lines:array<struct<line_number:int,text:string>>>"


def _section(title: Column, level: Column, content: Column, kind: Column, lines: Column) -> Column:
    return F.struct(title.alias("title"), level.cast("int").alias("level"), content.alias("content"), kind.alias("section_type"), lines.alias("lines"))


def _replace_last(acc: Column, x: Column) -> Column:
    return F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))


def prepared_sections(sections: Column, merge_max: int = 220, stub_max: int = 120) -> Column:
    """Heading stubs and tiny neighbours of one topic merge; images and tables are barriers; blank sections go."""
    barrier = lambda s: s["section_type"].isin("image", "table")
    name = lambda s: strip(F.coalesce(s["title"], F.lit("")))
    none = lambda t: (t == "") | ((F.length(t) == 6) & t.rlike(r"(?i)^\[body\]$"))

    def step(acc: Column, x: Column) -> Column:
        # What several conditions read is worked out once.
        p = F.try_element_at(acc, F.lit(-1))
        read = F.struct(p.alias("p"), normalize(x["content"]).alias("content"), normalize(p["content"]).alias("before"), name(x).alias("own"), name(p).alias("title"))
        return let(read, lambda v: judged(acc, x, v["p"], v["content"], v["before"], v["own"], v["title"]))

    def judged(acc: Column, x: Column, p: Column, content: Column, before: Column, own: Column, title: Column) -> Column:
        same = title == own
        stub = same & (F.length(before) <= stub_max) & p["level"].isin(1, 2, 3)
        tiny = (F.length(before) <= merge_max) | (F.length(content) <= merge_max)
        topic = (same | none(own) | none(title)) & ~(x["level"].isin(1, 2) & ~same)
        merges = (F.size(acc) > 0) & ~barrier(p) & (stub | (tiny & topic))
        joined = _section(p["title"], F.least(p["level"], x["level"]), merge_text(p["content"], x["content"]), F.when(x["section_type"] == "list", F.lit("list")).otherwise(p["section_type"]), F.concat(p["lines"], x["lines"]))
        kept = F.concat(acc, F.array(_section(x["title"], x["level"], content, x["section_type"], x["lines"])))
        return F.when(barrier(x), F.concat(acc, F.array(x))).when(content == "", acc).when(F.coalesce(merges, F.lit(False)), _replace_last(acc, joined)).otherwise(kept)

    return F.aggregate(sections, F.array().cast(f"array<{SECTION}>"), step)


PAGE = f"struct<page_number:int,sections:array<{SECTION}>>"


def merged_across_pages(pages: Column) -> Column:
    """A page's first section joins the last of the page before if it goes on with it; what is merged away leaves its page.

    Whether two pages belong together shows in their own sections; only where a page has a single section does it matter whether that
    one has left. So the fold runs over flags, and each page is built once."""
    barrier = lambda s: s["section_type"].isin("image", "table")
    last = lambda p: F.try_element_at(p["sections"], F.lit(-1))
    first = lambda p: F.try_element_at(p["sections"], F.lit(1))

    def pair(p: Column, x: Column) -> Column:
        a, b = last(p), first(x)
        same = (b["title"] == a["title"]) & ~b["title"].isin("[body]", "")
        on = ~barrier(a) & ~barrier(b) & (b["level"] == 3) & (same | b["content"].rlike(r"^\p{Ll}"))
        return F.struct(F.coalesce(on, F.lit(False)).alias("on"), (F.size(p["sections"]) == 1).alias("single"))

    def step(flags: Column, x: Column) -> Column:
        left = F.try_element_at(flags, F.lit(-1)) & x["single"]  # the page before is empty now
        return F.concat(flags, F.array(x["on"] & ~left))

    def flagged(ps: Column) -> Column:
        pairs = F.zip_with(F.slice(ps, F.lit(1), F.size(ps) - 1), F.slice(ps, F.lit(2), F.size(ps) - 1), pair)
        return F.aggregate(pairs, F.array(F.lit(False)), step)

    def built(ps: Column, flags: Column) -> Callable[[Column, Column], Column]:
        def one(x: Column, i: Column) -> Column:
            a, b = last(x), first(F.get(ps, i + 1))
            joined = _section(a["title"], a["level"], merge_text(a["content"], b["content"]), a["section_type"], F.concat(a["lines"], b["lines"]))
            own = F.when(F.coalesce(F.get(flags, i + 1), F.lit(False)), _replace_last(x["sections"], joined)).otherwise(x["sections"])
            kept = F.when(F.get(flags, i), F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0)))).otherwise(own)
            return F.struct(x["page_number"].cast("int").alias("page_number"), kept.alias("sections"))

        return one

    return let(pages, lambda ps: F.when(F.size(ps) > 0, let(flagged(ps), lambda flags: F.transform(ps, built(ps, flags)))).otherwise(ps.cast(f"array<{PAGE}>")))


def greedy_lines(hits: Column, most: int = 3) -> Column:
    """From hits (struct with start and stop), best first: those whose line range overlaps none kept, `most` at most."""
    kind = hits

    def step(acc: Column, x: Column) -> Column:
        free = ~F.exists(acc, lambda k: (k["start"] <= x["stop"]) & (k["stop"] >= x["start"]))
        return F.when((F.size(acc) == 0) | (free & (F.size(acc) < most)), F.concat(acc, F.array(x))).otherwise(acc)

    return F.aggregate(kind, F.slice(kind, 1, 0), step)


def budgeted(groups: Column, budget: int) -> Column:
    """groups: array of arrays of strings. Each group's strings are taken until one would exceed what is left of the
    budget of all groups; then the next group goes on. Returns the taken strings of each group, joined."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("used"))

    def one(s: Column, group: Column) -> Column:
        inner = F.aggregate(
            group,
            F.struct(F.lit("").alias("text"), s["used"].alias("used"), F.lit(True).alias("going")),
            lambda a, x: F.when(a["going"] & (a["used"] + F.length(x) <= budget), F.struct(F.concat(a["text"], x).alias("text"), (a["used"] + F.length(x)).alias("used"), F.lit(True).alias("going"))).otherwise(F.struct(a["text"].alias("text"), a["used"].alias("used"), F.lit(False).alias("going"))),
        )
        return F.struct(F.concat(s["done"], F.array(inner["text"])).alias("done"), inner["used"].alias("used"))

    return F.aggregate(groups, start, one, lambda s: s["done"])
