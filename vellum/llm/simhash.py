"""Operator 5: SimHash near-duplicates by multi-index hashing.

A fingerprint's two 32-bit halves are looked up in a table of halves. Two fingerprints that differ in at most three
bits have a half that differs in at most one, so each fingerprint enumerates the radius-one ball (33 values) of
each half, fetches the matches and checks the complete distance. Equal fingerprints are one node from the start.
A half that many fingerprints share goes another, equally exact way: its table and its probes are laid out in a
grid of bounded blocks, and each block returns a spanning forest of its links instead of all pairs. In a half that very many
share, the other half (at most three bits apart) is looked up the same way by its two quarters, one of which
differs in at most one bit; half and quarter together leave 2^16 fingerprints at most, so the work has a linear bound.
All joins are merge joins by hint: Spark takes a table whose rows were multiplied, as by a ball's 33 values, for as small as its
file, and would broadcast it through the driver.

Texts that are alike by 0.8 or more may lie further apart than such balls reach. Where `alike` is set, links that the wide
fingerprints of sketches.py find and the sets of shingles confirm are added to those of the multi-index.

Null text counts as empty; documents without words have fingerprint zero and are linked like any other. Repeated
rows are linked to each other. A component's id is its least non-null document id (null if it has none). Very long texts are
hashed whole, in steps; an empty table gives no rows. Only id, fp and component come out (an id named like one of those as
`id`); the filter `one_of_each` keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketches
from .common import Scratch, own_name, quoted, slices
from .components import components

SEED = 42
RADIUS = 3
#: A half that more fingerprints share is compared in blocks; one that more than DEEP share is looked up once more, by quarters of
#: the other half, so that a group's comparisons stop growing with its square.
SHARED, DEEP = 24, 1 << 15
#: Rows of a block: its table side and its probe side.
TABLE_BLOCK, PROBE_BLOCK = 2048, 8192
#: Shingles that are hashed at once.
STEP = 1 << 16


def hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The hashes of the shingles, repeats included, a step at a time."""
    n = max(1, len(words) - width + 1)
    for k in range(0, n if words else 0, STEP):
        part = words[k : min(k + STEP, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")


def fingerprint(text: str, width: int, minima: sketches.Minima | None = None) -> int:
    """Words are runs of bytes that aren't ASCII white space, after lower-casing A-Z. The shingles are added to `minima`."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for h in hashes(words, width):
        if minima is not None:
            minima.add(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", alike: bool = False) -> DataFrame:
    """id, fp (the 64 bits as a signed long); with `alike` also wide and runs, the sketch, node, a name of the set of shingles, and hash, of the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                minima = [sketches.Minima() if alike else None for _ in range(part.num_rows)]
                fps = [fingerprint(t or "", width, m) for t, m in zip(part.column(1).to_pylist(), minima, strict=True)]
                columns = {"id": part.column(0), "fp": pa.array(fps, pa.int64())}
                if alike:
                    wide, runs = zip(*(m.sketch() for m in minima), strict=True)
                    columns |= {"wide": pa.array(wide, pa.list_(pa.int64())), "runs": pa.array(runs, pa.binary()), "node": pa.array([m.digest() for m in minima], pa.int64()), "hash": part.column(2)}
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, fp bigint" + (", wide array<bigint>, runs binary, node bigint, hash bigint" if alike else "")
    text = F.col(quoted(text_col)).cast("string")
    return docs.select(F.col(quoted(id_col)).alias("id"), text.alias("text"), *([F.xxhash64(text).alias("hash")] if alike else [])).mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """texts: (node, text) -> (node, set), the distinct hashes of the text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *hashes((t or "").encode().lower().split(), width)])).view("<i8") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"node": part.column(0), "set": pa.array(sets, pa.list_(pa.int64()))})

    return texts.mapInArrow(run, "node bigint, set array<bigint>")


def _forest(probes: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sets of fingerprints, as (node, root)."""
    nodes, at = np.unique(np.concatenate([probes, table]), return_inverse=True)
    p, t = at[: len(probes)], at[len(probes) :]
    root = np.arange(len(nodes))
    for k in range(0, len(probes), 512):
        i, j = np.nonzero(np.bitwise_count(probes[k : k + 512, None] ^ table[None, :]) <= radius)
        a, b = p[k + i], t[j]
        while True:  # the least root of both ends spreads until nothing changes
            low = np.minimum(root[a], root[b])
            same = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if np.array_equal(same, root):
                break
    while not np.array_equal(root, root[root]):
        root = root[root]
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[root[moved]]


def _grid(scratch: Scratch, name: str, table: DataFrame, probes: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links between table entries (keys, y, n: how many share the keys) and probes (keys, x, n), key by key in bounded blocks."""
    sizes = probes.groupBy(*keys).agg(F.count("*").alias("m"), F.max("n").alias("n"))
    blocks = scratch.write(sizes.select(*keys, F.ceil(F.col("n") / TABLE_BLOCK).cast("int").alias("nt"), F.ceil(F.col("m") / PROBE_BLOCK).cast("int").alias("np")), f"{name}-blocks")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = (
        probes.drop("n").join(blocks.hint("merge"), keys).select(*keys, all_of("nt").alias("t"), deal("x", "np").alias("p"), F.col("x").alias("fp"), F.lit(False).alias("entry"))
        .unionAll(table.drop("n").join(blocks.hint("merge"), keys).select(*keys, deal("y", "nt").alias("t"), all_of("np").alias("p"), F.col("y").alias("fp"), F.lit(True).alias("entry")))
    )

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, entry = pdf["fp"].to_numpy().view(np.uint64), pdf["entry"].to_numpy(dtype=bool)
        a, b = _forest(fps[~entry], fps[entry], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    # Dealt anew, or a key's blocks would all stay in the task that joined them.
    return rows.repartition(*keys, "t", "p").groupBy(*keys, "t", "p").applyInPandas(block, "a bigint, b bigint")


def _parted(rows: DataFrame, fp: str, reach: bool) -> DataFrame:
    """Rows of a half (s, v) by a quarter (u, w) of the other half; with `reach`, by all values within one bit of it."""
    other = F.when(F.col("s") == 0, F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
    quarters = F.array(*[F.struct(F.lit(u).alias("u"), w.alias("w")) for u, w in enumerate((F.shiftrightunsigned(other, 16), other.bitwiseAND(F.lit(0xFFFF))))])
    out = rows.drop("n").select("*", F.inline(quarters))
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(16)])
    return out.withColumn("mask", F.explode(masks)).withColumn("w", F.col("w").bitwiseXOR(F.col("mask"))).drop("mask") if reach else out


def _met(scratch: Scratch, name: str, table: DataFrame, probes: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links (a, b) between table entries (keys, y) and probes (keys, x) of one key that lie within the radius."""
    shared = scratch.write(table.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > SHARED), f"{name}-shared")
    marked = scratch.write(table.join(shared.hint("merge"), keys, "left"), f"{name}-marked")
    hot = F.col("n").isNotNull()
    near = (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)
    # The probes are shuffled once: they meet the entries of keys that few share, and one row for each key that many share.
    partners = marked.where(~hot).select(*keys, "y", "n").unionAll(shared.select(*keys, F.lit(None).cast("long").alias("y"), "n"))
    met = scratch.write(probes.join(partners.hint("merge"), keys).where(hot | near).select(*keys, "x", "y", "n"), f"{name}-met")
    cold = met.where(~hot).select(F.col("x").alias("a"), F.col("y").alias("b"))
    if shared.isEmpty():
        return cold
    hot_probes, hot_table = met.where(hot).drop("y"), marked.where(hot)
    if "u" in keys:  # at most 2^16 entries share half and quarter
        return cold.unionAll(_grid(scratch, name, hot_table, hot_probes, keys, radius))
    some = cold.unionAll(_grid(scratch, name, hot_table.where(F.col("n") <= DEEP), hot_probes.where(F.col("n") <= DEEP), keys, radius))
    deep = F.col("n") > DEEP
    if shared.where(deep).isEmpty():
        return some
    return some.unionAll(_met(scratch, f"{name}-deep", _parted(hot_table.where(deep), "y", False), _parted(hot_probes.where(deep), "x", True), [*keys, "u", "w"], radius))


def links(scratch: Scratch, distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct: (fp) without repeats -> links (a, b) that connect exactly what pairs within the radius connect."""
    ball = radius // 2
    if ball != 1:
        raise ValueError("two halves and balls of radius one serve distances of 2 and 3")
    halves = F.array(*[F.struct(F.lit(s).alias("s"), e.alias("v")) for s, e in enumerate((F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))))])
    own = distinct.select("fp", F.inline(halves))
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    probes = own.select("fp", "s", "v", F.explode(masks).alias("mask")).select("s", F.col("v").bitwiseXOR(F.col("mask")).alias("v"), F.col("fp").alias("x"))
    # A half that only one fingerprint has still is a partner for its ball; halves without any table entry drop out in the join.
    return _met(scratch, "halves", own.withColumnRenamed("fp", "y"), probes, ["s", "v"], radius)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", alike: bool = False) -> DataFrame:
    """id, fp, component: one row for each input row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, width, id_col, text_col, alike), "fingerprints")
    fps = rows.select("id", "fp")
    distinct = scratch.write(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = links(scratch, distinct.select("fp"), radius)
    if alike:
        # A set of shingles is a node of its own, linked to its fingerprint. Only sets that may have a partner are made again, from one text each.
        nodes = scratch.write(rows.groupBy("node").agg(F.first("wide").alias("wide"), F.first("runs").alias("runs"), F.min("hash").alias("hash")), "sketches")
        text = F.col(quoted(text_col)).cast("string")
        texts = docs.select(F.xxhash64(text).alias("hash"), text.alias("text")).groupBy("hash").agg(F.first("text").alias("text"))
        sets = lambda asked: shingle_sets(texts.join(nodes.select("node", "hash").join(asked.hint("merge"), "node").hint("merge"), "hash").select("node", "text"), width)
        found = found.unionAll(rows.select(F.col("fp").alias("a"), F.col("node").alias("b")).distinct()).unionAll(sketches.links(scratch, nodes, sets))
    comps = components(scratch, found)
    roots = distinct.join(comps.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = scratch.write(roots.groupBy("root").agg(F.min("least").alias("component")), "least")
    classes = scratch.write(roots.join(least.hint("merge"), "root").select("fp", "component"), "classes")
    return fps.join(classes.hint("merge"), "fp").select(F.col("id").alias(own_name(id_col, ("fp", "component"))), "fp", "component")


def one_of_each(docs: DataFrame, width: int = 5, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", alike: bool = True) -> DataFrame:
    """The input rows, all columns as they are, less those whose component has an earlier row.

    The earliest has the least id (null ids last); among rows that repeat an id, the least text hash; one of equal rows stays."""
    scratch = Scratch(docs.sparkSession, "keep")
    found = near_duplicates(docs.select(F.struct(F.col(quoted(id_col)).isNull().alias("n"), F.col(quoted(id_col)).alias("i"), F.xxhash64(F.col(quoted(text_col))).alias("h")).alias("place"), F.col(quoted(text_col)).alias("text")), width, radius, "place", "text", alike)
    places = scratch.write(found.select("place", "component"), "places")
    gone = scratch.write(places.where(F.col("place") != F.col("component")).select("place.*").distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(id_col)).alias("k"), F.xxhash64(F.col(quoted(text_col))).alias("th"))
    kept = rows.join(gone.hint("merge"), rows["k"].eqNullSafe(gone["i"]) & (rows["th"] == gone["h"]), "left_anti")
    # What is left of a component is the rows that share its first place: copies of one row under one id.
    twice = scratch.write(places.groupBy("place").count().where("count > 1").select("place.*"), "twice")
    if twice.isEmpty():
        return kept.select("row.*")
    again = kept.join(twice.hint("merge"), kept["k"].eqNullSafe(twice["i"]) & (kept["th"] == twice["h"]), "left_semi")
    single = kept.join(twice.hint("merge"), kept["k"].eqNullSafe(twice["i"]) & (kept["th"] == twice["h"]), "left_anti")
    one = again.groupBy("k", "th").agg(F.first("row").alias("row"))
    return single.select("row.*").unionAll(one.select("row.*"))
