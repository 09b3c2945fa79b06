"""Operator 9: benchmark decontamination.

An item of n words is compared with every window of n words that shares a five-word shingle with it (windows that
share none have similarity zero). Windows get SimHash fingerprints from running sums of their shingles' bits. A
multi-index over the items' fingerprints (seven blocks, balls of radius two in each) returns every item of that
size within 20 bits, and the weighted Jaccard similarity of the two shingle multisets decides: 0.8 or more.

Words are runs of letters, digits and underscores, lower case. Null or empty texts and items match nothing; nor
do items of fewer than five words, which have no shingle. Items with a null id count like others. A document shorter than
an item is one window; a very long one is a slice of its own and scanned whole. Of windows alike, the first counts.
Repeated rows each get their rows; an empty table, or no items, gives none (and keeps all). Items come in blocks of a
fixed number, each sent to the executors in turn. Only the two ids and own columns come out; a document's id column that
is named like one of those comes out as `id`, an item's as `item`. The filter keeps all columns as they are.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import own_name, quoted, slices

WIDTH = 5
SIMILAR = 0.8
RADIUS = 20
BLOCKS = 7
#: A block's table with no more entries than a ball has values is looked through instead; both find the same.
FEW = 46
#: Items that are sent to the executors at once.
ITEMS = 20_000
_words = re.compile(r"\w+").findall
MIX = np.uint64(0x9E3779B97F4A7C15)


def block_bounds() -> list[tuple[int, int]]:
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def ball(value: int, bits: int, radius: int) -> Iterator[int]:
    for k in range(radius + 1):
        for at in combinations(range(bits), k):
            yield value ^ sum(1 << b for b in at)


class Items:
    """Benchmark items with their shingle and fingerprint indexes."""

    def __init__(self, rows: list[tuple[object, str]]):
        self.vocab: dict[str, int] = {}
        self.ids, self.words, self.bags, self.sizes, self.prints = [], [], [], [], []
        holders: dict[int, list[int]] = defaultdict(list)
        self.bits: dict[int, np.ndarray] = {}
        for item, text in rows:
            words = _words((text or "").lower())
            if len(words) < WIDTH:
                continue
            k = len(self.ids)
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.uint64)
            shingles = self.rolled(ids)
            self.ids.append(item)
            self.sizes.append(len(words))
            self.bags.append(Counter(shingles.tolist()))
            self.prints.append(int(self.windows(shingles, len(shingles))[0]))
            for s in set(shingles.tolist()):
                holders[s].append(k)
        self.known = np.array(sorted(holders), dtype=np.uint64)
        self.holders = holders
        self.index: dict[int, list[dict[int, list[int]]]] = {}
        for k, (n, fp) in enumerate(zip(self.sizes, self.prints, strict=True)):
            tables = self.index.setdefault(n, [defaultdict(list) for _ in range(BLOCKS)])
            for table, (lo, hi) in zip(tables, block_bounds(), strict=True):
                table[fp >> lo & (1 << hi - lo) - 1].append(k)
        self.within = RADIUS // BLOCKS

    @staticmethod
    def rolled(ids: np.ndarray) -> np.ndarray:
        """A 64-bit name for each run of five word ids."""
        h = np.zeros(max(0, len(ids) - WIDTH + 1), dtype=np.uint64)
        for i in range(WIDTH):
            h = (h ^ ids[i : i + len(h)]) * MIX
            h ^= h >> np.uint64(29)
        return h

    @staticmethod
    def windows(shingles: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of all windows of so many shingles."""
        mixed = np.array([xxhash.xxh64_intdigest(int(s).to_bytes(8, "little")) for s in shingles], dtype="<u8")
        signs = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
        sums = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])
        ones = sums[size:] - sums[:-size]
        return np.packbits(2 * ones > size, axis=1, bitorder="little").view("<u8").ravel()

    def near(self, n: int, fp: int) -> list[tuple[int, int]]:
        """Items of n words within RADIUS of a fingerprint, with the distance."""
        seen: set[int] = set()
        for table, (lo, hi) in zip(self.index.get(n, ()), block_bounds(), strict=False):
            value = fp >> lo & (1 << hi - lo) - 1
            if len(table) <= FEW:
                for v, items in table.items():
                    if (v ^ value).bit_count() <= self.within:
                        seen.update(items)
            else:
                for v in ball(value, hi - lo, self.within):
                    seen.update(table.get(v, ()))
        return [(k, d) for k in seen if (d := (self.prints[k] ^ fp).bit_count()) <= RADIUS]

    def matches(self, text: str) -> list[tuple[object, int, int, float, int]]:
        """(item, first word, words, similarity, bits that differ) of each item's best window."""
        words = _words(text.lower())
        if len(words) < WIDTH or not len(self.known):
            return []
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), dtype=np.uint64, count=len(words))
        names = self.rolled(ids)
        zero = np.concatenate([[0], np.cumsum(ids == 0)])
        whole = np.nonzero(zero[WIDTH:] == zero[:-WIDTH])[0]
        if not len(whole):
            return []
        at = np.minimum(np.searchsorted(self.known, names[whole]), len(self.known) - 1)
        hits = whole[self.known[at] == names[whole]]
        if not len(hits):
            return []
        # Words outside the items' vocabulary need names of their own now that windows are compared as a whole.
        for p in np.nonzero(ids == 0)[0].tolist():
            ids[p] = xxhash.xxh64_intdigest(words[p]) | 1 << 63
        names = self.rolled(ids)
        near_hits: dict[int, list[int]] = defaultdict(list)
        for p in hits.tolist():
            for n in {self.sizes[k] for k in self.holders[int(names[p])]}:
                near_hits[n].append(p)
        best: dict[int, tuple[float, int, int, int]] = {}
        for n, places in near_hits.items():
            size = min(n - WIDTH + 1, len(names))
            last = len(names) - size
            spans: list[list[int]] = []
            for p in places:
                lo, hi = max(0, p - size + 1), min(last, p)
                if lo > hi:
                    lo = hi = min(max(0, p - size + 1), last)
                if spans and lo <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                for s, fp in enumerate(self.windows(names[lo : hi + size], size).tolist(), lo):
                    bag = None
                    for k, d in self.near(n, fp):
                        if bag is None:
                            bag = Counter(names[s : s + size].tolist())
                        own = self.bags[k]
                        both = sum(min(c, own[x]) for x, c in bag.items() if x in own)
                        similar = both / (size + own.total() - both)
                        if similar >= SIMILAR and (-similar, s) < (-best.get(k, (0.0, 0, 0, 0))[0], best.get(k, (0, 0, 0, 0))[1]):
                            best[k] = (similar, s, min(n, len(words)), d)
        return [(self.ids[k], s, n, similar, d) for k, (similar, s, n, d) in sorted(best.items())]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in lists of about ITEMS at most."""
    rows = items.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).where(F.col("text").isNotNull())
    parts = -(-rows.count() // ITEMS)
    for k in range(parts):
        yield sorted(map(tuple, rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).collect()), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc id, item id, first_word, n_words, similarity, distance: each pair's best window."""
    spark = docs.sparkSession
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    mine = ("first_word", "n_words", "similarity", "distance")
    named = own_name(id_col, mine)
    item = "item" if item_col.lower() in (named.lower(), *mine) else item_col
    schema = f"{quoted(named)} {kinds[0]}, {quoted(item)} {kinds[1]}, first_word bigint, n_words bigint, similarity double, distance int"
    out = None
    id_kind = to_arrow_type(items.schema[item_col].dataType)
    for rows in _blocks(items, item_col, item_text):
        sent = spark.sparkContext.broadcast(Items(rows))
        if not sent.value.ids:
            continue

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1):
                    found = [(i, m) for i, t in enumerate(part.column(1).to_pylist()) if t for m in sent.value.matches(t)]
                    if found:
                        cols = list(zip(*(m for _, m in found), strict=True))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([i for i, _ in found])), pa.array(cols[0], id_kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int32())], names=[named, item, "first_word", "n_words", "similarity", "distance"])

        part = docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, all columns as they are, that match no item."""
    at, schema = docs.columns.index(text_col), docs.schema
    for rows in _blocks(items, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(Items(rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, at):
                    yield part.filter(pa.array([not (t and sent.value.matches(t)) for t in part.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
