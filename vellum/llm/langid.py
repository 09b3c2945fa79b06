"""Operator 8: language identification by multilingual mixture inference.

Each language has a distribution over letter trigrams (UTF-8 bytes of the lower-cased words with single spaces
between, hashed to 16 bits). A document's language shares are the mixture weights that expectation-maximisation
finds for its trigram counts. Sets of languages, nested by share, are compared by log-likelihood less a penalty
for each language; the best set's shares are the result. Each document's fit ends when none of its shares moves by 0.002,
or after 25 rounds at most; sets of two or more are tried only where the fit with all languages beats the best single one by a penalty.

Null text, and text without letters, is `und` with score 0 and no shares; so is everything if no labelled row
could be learned from. Null ids are never learned from. Texts are used whole, very long ones in steps; repeated rows are
judged row by row, an empty table gives no rows. Only id and own columns come out (an id named like one of them as `id`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name, quoted, slices

BITS = 16
#: The documented bound of the labelled sample that the model is fitted on: rows, chosen by a hash of the id.
MAX_ROWS = 20_000
#: Added to each trigram count.
SMOOTH = 0.05
ROUNDS, CLOSE = 25, 2e-3
#: Log-likelihood that each further language must gain, times the log of the number of trigrams.
PENALTY = 4.0
#: Trigrams' worth of even shares that the score is drawn towards, so that little text means a lower score.
PRIOR = 8.0
UNKNOWN = "und"
#: Bytes of one text that are counted at once.
STEP = 4 << 20

_words = regex.compile(r"\p{L}+").findall


def normal(text: str | None) -> bytes:
    """The text's words, lower case, with single spaces around; empty if it has no letters."""
    words = _words(text.lower()) if text else []
    return (" " + " ".join(words) + " ").encode() if words else b""


def trigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.uint32)
    packed = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return (packed * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts, by text: index, trigram, count."""
    parts = []
    for k, t in enumerate(texts):
        if len(t) <= STEP:
            parts.append((trigrams(t) | np.uint64(k << BITS), None))
        else:
            total = np.zeros(1 << BITS, dtype=np.int64)
            for i in range(0, len(t) - 2, STEP):
                total += np.bincount(trigrams(t[i : i + STEP + 2]), minlength=1 << BITS)
            at = np.nonzero(total)[0].astype(np.uint64)
            parts.append((at | np.uint64(k << BITS), total[at.astype(np.int64)]))
    small = [x for x, n in parts if n is None]
    keys, counts = np.unique(np.concatenate(small), return_counts=True) if small else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if big := [(x, n) for x, n in parts if n is not None]:
        keys, counts = np.concatenate([keys, *(x for x, _ in big)]), np.concatenate([counts, *(n for _, n in big)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), counts.astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    #: trigram x language probabilities
    p: np.ndarray

    def _fit(self, doc: np.ndarray, gram: np.ndarray, n: np.ndarray, size: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixture weights of `size` documents among their allowed languages, and the log-likelihood."""
        starts = np.searchsorted(doc, np.arange(size))
        total = np.add.reduceat(n, starts)
        w = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
        p, counts = self.p[gram], n[:, None]
        going = np.ones(size, dtype=bool)  # each document ends for itself, so that what lies in its batch changes nothing
        for _ in range(ROUNDS):
            r = p * w[doc]
            r *= counts / r.sum(axis=1, keepdims=True)
            new = np.add.reduceat(r, starts, axis=0) / total[:, None]
            moved = np.abs(new - w).max(axis=1)
            w[going] = new[going]
            going &= moved >= CLOSE
            if not going.any():
                break
        s = (p * w[doc]).sum(axis=1)
        return w, np.add.reduceat(n * np.log(s), starts)

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """text x language; zeros for texts without trigrams."""
        out = np.zeros((len(texts), len(self.languages)))
        known = [k for k, t in enumerate(texts) if len(t) > 2]
        if not known or not self.languages:
            return out
        doc, gram, n = counted([texts[k] for k in known])
        size, langs = len(known), len(self.languages)
        starts = np.searchsorted(doc, np.arange(size))
        cost = PENALTY * np.log(np.add.reduceat(n, starts) + 1)
        single = np.add.reduceat(np.log(self.p)[gram] * n[:, None], starts, axis=0)
        best = single.max(axis=1) - cost
        w = np.eye(langs, dtype=np.float32)[single.argmax(axis=1)]
        if langs > 1:
            full, ll = self._fit(doc, gram, n, size, np.ones((size, langs), dtype=np.float32))
            mixed = np.nonzero(ll - 2 * cost > best)[0]  # no set of two or more can win elsewhere
            if len(mixed):
                rank = np.argsort(np.argsort(-full[mixed], axis=1, kind="stable"), axis=1)
                take = np.isin(doc, mixed)
                d2, g2, n2 = np.searchsorted(mixed, doc[take]), gram[take], n[take]
                for k in range(2, langs + 1):
                    wk, lk = self._fit(d2, g2, n2, len(mixed), (rank < k).astype(np.float32))
                    better = lk - k * cost[mixed] > best[mixed]
                    best[mixed[better]] = (lk - k * cost[mixed])[better]
                    w[mixed[better]] = wk[better]
        out[known] = w
        return out


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> LanguageModel:
    """From rows where `usable` holds and text and language are known: all of them, or a hash-chosen sample of about max_rows."""
    rows = docs.where(usable & F.col(quoted(lang_col)).isNotNull() & F.col(quoted(text_col)).isNotNull() & F.col(quoted(id_col)).isNotNull())
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.col(quoted(id_col)).cast("string")), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = normal(text)
                if len(data) > 2:
                    c = total.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                    for i in range(0, len(data) - 2, STEP):
                        codes, k = np.unique(trigrams(data[i : i + STEP + 2]), return_counts=True)
                        c[codes] += k
        for lang, c in total.items():
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], names=["lang", "gram", "n"])

    counts = rows.select(F.col(quoted(lang_col)).cast("string").alias("lang"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(count, "lang string, gram bigint, n bigint")
    got = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most languages x 65,536 rows
    langs = sorted(got["lang"].unique())
    table = np.full((1 << BITS, len(langs)), SMOOTH)
    table[got["gram"].to_numpy(dtype=np.int64), got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)] += got["n"].to_numpy(dtype=np.float64)
    return LanguageModel(langs, (table / table.sum(axis=0)).astype(np.float32))


def _decide(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[str, float]]]]:
    data = [normal(t) for t in texts]
    w = model.shares(data)
    lang, score, shares = [], [], []
    for row, t in zip(w, data, strict=True):
        if not row.any():
            lang.append(UNKNOWN)
            score.append(0.0)
            shares.append([])
            continue
        k, n = int(row.argmax()), len(t) - 2
        lang.append(model.languages[k])
        score.append(float(min(1.0, max(0.0, (n * row[k] + PRIOR / len(row)) / (n + PRIOR)))))
        shares.append([(model.languages[i], float(row[i])) for i in np.argsort(-row, kind="stable") if row[i] > 0])
    return lang, score, shares


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, shares (languages of the chosen set with their proportions)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB a language
    kind, named = docs.schema[id_col].dataType.simpleString(), own_name(id_col, ("lang_pred", "score", "shares"))
    share = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                lang, score, shares = _decide(sent.value, part.column(1).to_pylist())
                rows = [[{"lang": a, "share": b} for a, b in x] for x in shares]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rows, share)], names=[named, "lang_pred", "score", "shares"])

    return docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, f"{quoted(named)} {kind}, lang_pred string, score double, shares array<struct<lang:string,share:double>>")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose language could be told."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                lang, _, _ = _decide(sent.value, part.column(at).to_pylist())
                yield part.filter(pa.array([x != UNKNOWN for x in lang], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
