"""Operator 7: removal of repeated byte strings with a blockwise difference-cover suffix sort.

Every suffix, cut at 200 bytes, belongs to the bucket of its minimizer, the least 40-byte gram of its first 200
bytes; so equal strings meet in one bucket, and neighbouring suffixes travel together as one context of 200 to
some 360 bytes. Contexts whose bucket key is single can't repeat, and equal contexts repeat as a whole: both are
settled by counting. The other contexts, one of each kind, go to blocks of bounded size, each sorted on its own:
suffixes at positions of a difference cover modulo 7 are ranked to depth 194 by doubling, only ties going on from
step to step. For any two suffixes some shift below 7 takes both to the cover, so the six bytes outside the ranked
part and the ranks there decide whether they are equal to depth 200.

A bucket larger than a block is split, at any size the same way: its suffixes are parted by their distance from the
minimizer, 40 distances at a time, and bucketed anew by all the bytes that the suffixes of one part have in common (161 of
200). Equal suffixes still meet. What is larger than a block even then is parted by 5 distances and, at last, by
single ones, where a bucket's suffixes are equal.

Null text counts as empty. Equal texts are one text with a count: results depend on the text alone, so repeated rows
and rows that share an id need no further rule. Matches never cross documents. Texts below 200 bytes stay whole, very long
ones are read in steps. An empty table gives no rows. Own columns of `docs` play no part, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, quoted, slices

LENGTH, GRAM = 200, 40
#: Context bytes that one block should hold.
BLOCK_BYTES = 1 << 20
#: Distances from the minimizer that stay together when a bucket beyond BLOCK_BYTES is split, time after time.
PARTS = (40, 5, 1)
#: Starts of one text that are looked at together; below 2^16, as offsets share a word with hashes.
STEP = 60_000
V, COVER = 7, (1, 2, 4)

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[_U(1)], np.cumprod(np.full(n, base & (1 << 64) - 1, dtype=np.uint64))])


_N = 1 << 16
_UP, _DOWN = _powers(_BASE, _N), _powers(pow(_BASE, -1, 1 << 64), _N)
_BYTES = [np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1) for seed in (7, 8)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(31)) * _U(0xBF58476D1CE4E5B9)
    return (h ^ h >> _U(29)) * _U(0x94D049BB133111EB)


def _sums(data: np.ndarray, lane: int = 0) -> np.ndarray:
    """Prefix sums from which the hash of any part follows."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[lane][data] * _UP[: len(data)], out=out[1:])
    return out


def minimizer_runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of starts with one minimizer: first start, last start, minimizer's place, its hash, the context's hash."""
    found = []
    for base in range(0, len(data) - length + 1, STEP):
        part = data[base : base + STEP + length - 1]
        sums = _sums(part)
        n = len(part) - gram + 1
        h = _mix((sums[gram:] - sums[:-gram]) * _DOWN[:n])
        span = length - gram + 1
        keyed = np.concatenate([h & ~_U(0xFFFF) | np.arange(n, dtype=np.uint64), np.full(-n % span, ~_U(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(keyed, axis=1).ravel()
        back = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = len(part) - length + 1
        least = (np.minimum(back[:starts], ahead[span - 1 : span - 1 + starts]) & _U(0xFFFF)).astype(np.int64)
        first = np.nonzero(np.concatenate([[True], least[1:] != least[:-1]]))[0]
        last = np.concatenate([first[1:], [starts]]) - 1
        at = least[first]
        shape = (last - first).astype(np.uint64) * _U(1000) + (at - first).astype(np.uint64)
        context = _mix((sums[last + length] - sums[first]) * _DOWN[first] + _mix(shape))
        found.append((first + base, last + base, at + base, h[at], context))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64))


def _place(p: np.ndarray) -> np.ndarray:
    """Index of a cover position among the cover positions."""
    return 3 * (p // V) + np.array([0, 0, 1, 0, 2, 0, 0])[p % V]


def cover_ranks(data: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Ranks, by their first `depth` bytes, of the suffixes at cover positions. Equal ranks: equal to that depth."""
    p = (np.arange(0, len(words) - len(words) % V, V)[:, None] + np.array(COVER)).ravel()
    first = words[p]
    order = np.argsort(first, kind="stable")
    new = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    rank = np.empty(len(p), dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
    extra = (depth - 9) % V + 1
    if extra > 4:
        raise ValueError("this depth isn't provided for")

    def refine(second: np.ndarray) -> None:
        tied = np.nonzero((np.bincount(rank, minlength=len(rank)) > 1)[rank])[0]
        key = rank[tied] << 32 | second[tied]
        order = np.argsort(key, kind="stable")
        key = key[order]
        here = np.arange(len(key))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        group = np.concatenate([[True], key[1:] >> 32 != key[:-1] >> 32])[: len(key)]
        rank[tied[order]] = (key >> 32) + np.maximum.accumulate(np.where(fresh, here, 0)) - np.maximum.accumulate(np.where(group, here, 0))

    refine((words[np.minimum(p + 8, len(words) - 1)] >> _U(64 - 8 * extra)).astype(np.int64))
    have = 8 + extra
    while have < depth:
        shift = min(have - have % V, depth - have)
        second = np.zeros(len(p), dtype=np.int64)
        k = 3 * (shift // V)
        second[: len(p) - k] = rank[k:]
        refine(second)
        have += shift
    return rank


def repeated(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of these starts have the same first `length` bytes as another of them."""
    out = np.zeros(len(starts), dtype=bool)
    if len(starts) < 2:
        return out
    padded = np.concatenate([data, np.zeros(4 * V, dtype=np.uint8)])
    words = np.ndarray((len(data) + 2 * V,), dtype=">u8", buffer=padded.tobytes(), strides=(1,)).astype(np.uint64)
    rank = cover_ranks(padded, words, length - V + 1)
    for shift in range(V):
        mine = np.nonzero(np.isin((starts + shift) % V, COVER))[0]
        r = rank[_place(starts[mine] + shift)]
        tied = (np.bincount(r) > 1)[r] if len(r) else np.zeros(0, bool)
        mine, r = mine[tied], r[tied]
        if len(mine) < 2:
            continue
        left, right = shift, V - 1 - shift
        i = starts[mine]
        rest = np.zeros(len(i), dtype=np.uint64)
        if left:
            rest = words[i] >> _U(64 - 8 * left)
        if right:
            rest = rest << _U(8 * right) | words[i + length - right] >> _U(64 - 8 * right)
        order = np.lexsort((rest, r))
        same = (r[order][1:] == r[order][:-1]) & (rest[order][1:] == rest[order][:-1])
        out[mine[order[1:][same]]] = True
        out[mine[order[:-1][same]]] = True
    return out


def _intervals(starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of one owner, joined: owner, first, last."""
    if not len(starts):
        return owner, starts, starts
    cut = np.nonzero((np.diff(starts) != 1) | (np.diff(owner) != 0))[0]
    return owner[np.concatenate([[0], cut + 1])], starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]


def _bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t, dtype=np.uint8) for t in column.cast(pa.binary()).to_pylist()]


def _flat(rows: pa.Array) -> pa.Array:
    return rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows


RUN = "t1 bigint, t2 bigint, m bigint, lo bigint, hi bigint, a bigint, key bigint, ctx bigint"


def _find_runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                found = [minimizer_runs(d, length, gram) for d in _bytes(part.column(3))]
                row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
                if len(row):
                    heads = [part.column(k).take(pa.array(row)) for k in range(3)]
                    cols = [np.concatenate(x).view(np.int64) for x in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*heads, *map(pa.array, cols)], names=["t1", "t2", "m", "lo", "hi", "a", "key", "ctx"])

    return run


def _columns(runs: pa.ListScalar, *names: str) -> list[list[int]]:
    return [_flat(pc.struct_field(runs.values, n)).to_pylist() for n in names]


def _contexts(length: int):
    """Rows of contexts from texts (t1, t2, text, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                t1, t2 = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows: list[tuple] = []
                for k, (d, runs) in enumerate(zip(_bytes(part.column(2)), part.column(3), strict=True)):
                    rows += [(key, t1[k], t2[k], lo, d[lo : hi + length].tobytes()) for lo, hi, key in zip(*_columns(runs, "lo", "hi", "key"), strict=True)]
                for j in range(0, len(rows), 20_000):
                    cols = zip(*rows[j : j + 20_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["key", "t1", "t2", "lo", "bytes"])

    return run


def parted(d: np.ndarray, lo: int, hi: int, a: int, key: int, together: int, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(first start, last start, key, the context's hash) of a context's parts: starts by their distance from the minimizer at `a`."""
    out = []
    for j in range((a - hi) // together, (a - lo) // together + 1):
        first, last = max(lo, a - (j + 1) * together + 1), min(hi, a - j * together)
        common = d[a - j * together : a - (j + 1) * together + 1 + length].tobytes()
        own = xxhash.xxh64_intdigest(common, seed=j), xxhash.xxh64_intdigest(d[first : last + length].tobytes(), seed=(last - first) * 1000 + a - first)
        out.append((first, last, *(np.array([own[0] ^ (key & (1 << 64) - 1), own[1]], dtype=np.uint64).view(np.int64).tolist())))
    return out


def _parts(length: int, together: int):
    """Runs of the parts of contexts, from texts (t1, t2, text, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                t1, t2 = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows: list[tuple] = []
                for k, (d, runs) in enumerate(zip(_bytes(part.column(2)), part.column(3), strict=True)):
                    for lo, hi, a, key in zip(*_columns(runs, "lo", "hi", "a", "key"), strict=True):
                        rows += [(t1[k], t2[k], 1, first, last, a, own, ctx) for first, last, own, ctx in parted(d, lo, hi, a, key, together, length)]
                for j in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[j : j + 20_000], strict=True)], names=["t1", "t2", "m", "lo", "hi", "a", "key", "ctx"])

    return run


def _sort_block(length: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        parts = _bytes(_flat(block["bytes"]))
        sizes = np.array([len(p) for p in parts])
        offsets = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        data = np.concatenate(parts)
        counts = sizes - length + 1
        owner = np.repeat(np.arange(len(parts)), counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        hit = np.nonzero(repeated(data, offsets[owner] + inner, length))[0]
        who, first, last = _intervals(inner[hit], owner[hit])
        lo = _flat(block["lo"]).to_numpy()[who]
        return pa.table({"t1": _flat(block["t1"]).take(pa.array(who)), "t2": _flat(block["t2"]).take(pa.array(who)), "s": lo + first, "e": lo + last})

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                out: list[tuple] = []
                for d, spans in zip(_bytes(part.column(2)), part.column(3), strict=True):
                    covered: list[list[int]] = []
                    if spans.is_valid:
                        s, e = (_flat(pc.struct_field(spans.values, n)).to_numpy() for n in ("s", "e"))
                        order = np.argsort(s, kind="stable")
                        for a, b in zip(s[order].tolist(), (e[order] + length).tolist(), strict=True):
                            if covered and a <= covered[-1][1]:
                                covered[-1][1] = max(covered[-1][1], b)
                            else:
                                covered.append([a, b])
                    edges = [0, *(x for c in covered for x in c), len(d)]
                    kept = b"".join(d[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(d), len(d) - len(kept), [{"start": a, "end": b} for a, b in covered], kept))
                cols = list(zip(*out, strict=True))
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), span, pa.binary()), strict=True))], names=["t1", "t2", "n_bytes", "n_removed", "spans", "kept"])

    return run


def text_hashes(text_col: str) -> list:
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text, F.length(text)).alias("t2")]


def _settled(scratch: Scratch, runs: DataFrame, length: int, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What counting settles: spans that repeat as a whole; one of each kind of the contexts that have to be compared; keys of buckets beyond a block."""
    keys = scratch.write(runs.groupBy("key").agg(F.sum("m").alias("n"), (F.min("ctx") != F.max("ctx")).alias("multi")).where("n > 1").select("key", "multi"), f"{name}-keys")
    shared = scratch.write(runs.join(keys.hint("merge"), "key"), f"{name}-shared")
    scratch.drop(name)
    kinds = scratch.write(shared.where("multi").groupBy("key", "ctx").agg(F.sum("m").alias("n"), F.min(F.struct("t1", "t2", "lo", "hi", "a")).alias("one")), f"{name}-kinds")
    # Kinds with over a thousandth of all contexts are a thousand at most: their contexts are found without an exchange.
    often = max(1000, (kinds.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot = F.broadcast(kinds.where(F.col("n") > often).select("key", "ctx"))
    rare = kinds.where((F.col("n") > 1) & (F.col("n") <= often)).select("key", "ctx")
    multi = shared.where("multi")
    again = multi.join(hot, ["key", "ctx"], "left_semi").unionAll(multi.join(hot, ["key", "ctx"], "left_anti").join(rare.hint("merge"), ["key", "ctx"]))
    whole = shared.where("not multi").select("t1", "t2", F.col("lo").alias("s"), F.col("hi").alias("e")).unionAll(again.select("t1", "t2", F.col("lo").alias("s"), F.col("hi").alias("e")))
    crowded = scratch.write(kinds.groupBy("key").agg(F.sum(F.col("one.hi") - F.col("one.lo") + length).alias("size")).where(F.col("size") > BLOCK_BYTES).select("key"), f"{name}-crowded")
    return whole, kinds, crowded


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """t1, t2 (text_hashes of the text), n_bytes, n_removed, spans (maximal removed runs), kept (bytes): one row for
    each different text. Rows of `docs` join it by text_hashes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    name, n = f"vellum_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = docs.select(*text_hashes(text_col), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text")).groupBy("t1", "t2").agg(F.count("*").alias("m"), F.first("text").alias("text"))
    # Bucketed by the text's hash: later joins move what was found to the texts, never the texts.
    distinct.write.option("path", f"{scratch.base}/texts").option("compression", "zstd").bucketBy(n, "t1", "t2").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: its files are of the shared folder, and `texts` is resolved

    runs = scratch.write(texts.where(F.octet_length("text") >= length).select("t1", "t2", "m", "text").mapInArrow(_find_runs(length, gram), RUN), "runs")
    runs_of = lambda df: df.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi", "a", "key")).alias("runs"))
    with_text = lambda df: texts.select("t1", "t2", "text").join(runs_of(df), ["t1", "t2"]).select("t1", "t2", "text", "runs")
    spans, compared = None, None
    for together in (*PARTS, None):
        whole, kinds, crowded = _settled(scratch, runs, length, "runs" if together == PARTS[0] else f"before-{together}")
        spans = whole if spans is None else spans.unionAll(whole)
        last = together is None or crowded.isEmpty()
        plain = (kinds if last else kinds.join(crowded, "key", "left_anti")).select("key", "one.*")
        compared = plain if compared is None else compared.unionAll(plain)
        if last:
            break
        hot = kinds.join(crowded, "key", "left_semi").select("key", "one.*")
        runs = scratch.write(with_text(hot).mapInArrow(_parts(length, together), RUN), f"parts-{together}")
    size = compared.agg(F.sum(F.col("hi") - F.col("lo") + length)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    contexts = with_text(compared).mapInArrow(_contexts(length), "key bigint, t1 bigint, t2 bigint, lo bigint, bytes binary")
    found = contexts.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").applyInArrow(_sort_block(length), "t1 bigint, t2 bigint, s bigint, e bigint")
    spans = spans.unionAll(found)
    spans = scratch.write(spans, "spans")
    for together in (*PARTS, None):
        for name in ("keys", "shared", "kinds", "crowded"):
            scratch.drop(f"{'runs' if together == PARTS[0] else f'before-{together}'}-{name}")
        scratch.drop(f"parts-{together}")
    by_text = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return texts.select("t1", "t2", "text").join(by_text, ["t1", "t2"], "left").select("t1", "t2", "text", "spans").mapInArrow(_cut(length), "t1 bigint, t2 bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
