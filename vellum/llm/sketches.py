"""Links between texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of such texts lie some ten bits apart, too far for small balls in selective segments. This wide
fingerprint has bits that agree more often: bit i is one bit of the least shingle under the i-th hash, so it differs
in half of (1 - similarity) of the cases, 51 of 512 at 0.8. Its tables are keyed by runs of whole minima: a run of six
agrees with probability 0.8^6, so a pair at 0.8 shares one of 24 runs in 999 of 1,000 cases. The complete distance of
those who share a run, whose standard error at 0.8 is 0.027 in similarity, only leaves out what lies five such errors
off; the sets of shingles decide about the rest. Without the sets, the distance decides.

A run that many share is compared in a grid of bounded blocks; each returns a spanning forest instead of its pairs.
A pair that is connected already is not verified again.
Runs with the same members are compared once. All joins are merge joins by hint, as Spark takes sketches and their exploded
runs for far smaller than they are and would broadcast them through the driver. A text without words has all minima at their greatest value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BITS, RUNS, RUN = 512, 24, 6
SIMILARITY = 0.8
#: Bits that may differ: half of 1 - SIMILARITY.
FAR = round(BITS * (1 - SIMILARITY) / 2)
#: Bits that may differ where the sets decide: five standard deviations more, which a pair at SIMILARITY passes in all but some 2 of a million cases.
NEAR = round(FAR + 5 * (BITS * (1 - SIMILARITY) / 2 * (1 + SIMILARITY) / 2) ** 0.5)
WORDS = BITS // 64
#: A run that more sketches share is compared in blocks of so many.
SHARED, BLOCK = 24, 2048
#: Shingles that are hashed at once.
STEP = 1 << 12


@cache
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the hash functions, from their numbers."""
    h = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42) for i in range(BITS)], dtype=np.uint64)
    return (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1), h.astype(np.uint32)


class Minima:
    """The least value of each hash over the shingles that were added."""

    def __init__(self) -> None:
        self.least = np.full(BITS, 0xFFFFFFFF, dtype=np.uint32)
        self.seen: list[np.ndarray] = []

    def add(self, h: np.ndarray) -> None:
        """h: shingle hashes (64 bits); repeats change nothing."""
        times, plus = _hashes()
        self.seen.append(h)
        h = (h ^ (h >> np.uint64(32))).astype(np.uint32)
        for k in range(0, len(h), STEP):
            part = h[k : k + STEP]
            np.minimum(self.least, (times[:, None] * part[None, :] + plus[:, None]).min(axis=1), out=self.least)

    def sketch(self) -> tuple[list[int], bytes]:
        """The wide fingerprint as longs, and a byte of each minimum that the runs use."""
        mixed = self.least * np.uint32(0x9E3779B1)
        bits = np.packbits((mixed >> np.uint32(31)).astype(np.uint8), bitorder="little")
        return bits.view("<i8").tolist(), (mixed[: RUNS * RUN] >> np.uint32(23)).astype(np.uint8).tobytes()


    def digest(self) -> int:
        """Names the set of shingles."""
        h = np.unique(np.concatenate(self.seen)) if self.seen else np.zeros(0, dtype="<u8")
        return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42)).astype(np.int64))


def alike(common: int | np.ndarray | Column, left: int | Column, right: int | np.ndarray | Column) -> bool | np.ndarray | Column:
    """Whether sets of these sizes with so many common members have a Jaccard similarity of SIMILARITY, in whole numbers."""
    return common * 100 >= (left + right - common) * round(100 * SIMILARITY)


def _verified(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of one block pair's links, which the sets decide."""
    left, right = pdf[pdf["side"] == pdf["p"]], pdf[pdf["side"] == pdf["q"]]
    a, b = (np.array(x["wide"].tolist(), dtype=np.int64).view(np.uint64).reshape(-1, WORDS) for x in (left, right))
    nodes, first, at = np.unique(np.concatenate([left["node"], right["node"]]), return_index=True, return_inverse=True)
    i_at, j_at = at[: len(a)], at[len(a) :]
    sets = [*left["set"], *right["set"]]
    size = np.array([len(sets[k]) for k in first])
    _, member = np.unique(np.concatenate([sets[k] for k in first]), return_inverse=True)
    sets = np.split(member.astype(np.int32), np.cumsum(size)[:-1])
    own, root = np.zeros(len(member) + 1, dtype=bool), np.arange(len(nodes))
    for k in range(len(a)):
        x = i_at[k]
        far = np.bitwise_count(a[k] ^ b).sum(axis=1, dtype=np.uint16)
        y = j_at[(far <= NEAR) & (root[j_at] != root[x])]
        if not len(y):
            continue
        own[sets[x]] = True
        common = np.concatenate([[0], np.cumsum(own[np.concatenate([sets[j] for j in y])])])[np.concatenate([[0], np.cumsum(size[y])])]
        own[sets[x]] = False
        met = np.concatenate([[root[x]], root[y[alike(np.diff(common), size[x], size[y])]]])
        root[np.isin(root, met)] = met.min()
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]]})


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of one block pair's links."""
    left, right = pdf[pdf["side"] == pdf["p"]], pdf[pdf["side"] == pdf["q"]]
    a, b = (np.array(x["wide"].tolist(), dtype=np.int64).view(np.uint64).reshape(-1, WORDS) for x in (left, right))
    nodes, at = np.unique(np.concatenate([left["node"], right["node"]]), return_inverse=True)
    i_at, j_at = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    for k in range(0, len(a), 64):
        far = np.zeros((len(a[k : k + 64]), len(b)), dtype=np.uint16)
        for w in range(WORDS):
            far += np.bitwise_count(a[k : k + 64, w, None] ^ b[None, :, w])
        i, j = np.nonzero(far <= FAR)
        x, y = i_at[k + i], j_at[j]
        while True:  # the least root of both ends spreads until nothing changes
            before, low = root.copy(), np.minimum(root[x], root[y])
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
            if np.array_equal(before, root):
                break
    while not np.array_equal(root, root[root]):
        root = root[root]
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]]})


def links(scratch: Scratch, sketches: DataFrame, sets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """sketches: (node, wide array of longs, runs binary), one row a node -> (a, b), connecting what the sets, else the distance, connect.

    sets: (node), no repeats -> (node, set), the distinct shingles as an array of longs."""
    runs = F.array(*[F.xxhash64(F.lit(i), F.substring(F.col("runs"), 1 + RUN * i, RUN)) for i in range(RUNS)])
    own = sketches.select("node", F.explode(runs).alias("v"))
    digest = [F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.lit(1 << 32))).alias("y")]
    shared = own.groupBy("v").agg(F.count("*").alias("n"), *digest).where(F.col("n") > 1).groupBy("n", "x", "y").agg(F.min("v").alias("v"))
    shared = scratch.write(shared.select("v", "n"), "runs")
    members = scratch.write(own.join(shared.hint("merge"), "v"), "members")
    wide = sketches.select("node", "wide")
    some = members.where(F.col("n") <= SHARED)
    pairs = some.select("v", F.col("node").alias("a")).join(some.select("v", F.col("node").alias("b")).hint("merge"), "v").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    both = pairs.join(wide.select(F.col("node").alias("a"), F.col("wide").alias("l")).hint("merge"), "a").join(wide.select(F.col("node").alias("b"), F.col("wide").alias("r")).hint("merge"), "b")
    far = sum((F.bit_count(F.col("l")[i].bitwiseXOR(F.col("r")[i])) for i in range(1, WORDS)), F.bit_count(F.col("l")[0].bitwiseXOR(F.col("r")[0])))
    cold = both.where(far <= (NEAR if sets else FAR)).select("a", "b")
    many = members.where(F.col("n") > SHARED)
    if sets:
        near = scratch.write(cold, "near")
        asked = near.select(F.col("a").alias("node")).unionAll(near.select("b")).unionAll(many.select("node")).distinct()
        held = scratch.write(sets(asked), "sets")
        both = near.join(held.select(F.col("node").alias("a"), F.col("set").alias("l")).hint("merge"), "a").join(held.select(F.col("node").alias("b"), F.col("set").alias("r")).hint("merge"), "b")
        cold = both.where(alike(F.size(F.array_intersect("l", "r")), F.size("l"), F.size("r"))).select("a", "b")
        wide = wide.join(held.hint("merge"), "node")
    if many.isEmpty():
        return cold
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = many.join(wide.hint("merge"), "node").withColumn("side", F.pmod(F.xxhash64("node"), parts).cast("int"))
    grid = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    held_columns = [c for c in wide.columns if c != "node"]
    hot = grid.select("v", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "node", *held_columns).groupBy("v", "p", "q").applyInPandas(_verified if sets else _blocks, "a bigint, b bigint")
    return cold.unionAll(hot)
