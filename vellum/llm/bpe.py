"""Operator 1: exact byte-level BPE encoding by backtracking, and decoding by an offset table.

A text is cut by the vocabulary's pre-token pattern. Each distinct piece is encoded once per worker: an
Aho-Corasick automaton over all token strings gives the longest token at each byte, and a token is accepted only
if it is compatible with the one before it, that is if no merge would cross their border. Otherwise the next
shorter token is tried, and a position from which nothing works is marked and left for good; so each position
is tried a bounded number of times. Decoding gathers bytes from one blob through token offsets.

Null text counts as empty (no tokens). Repeated rows and null ids are encoded row by row, an empty table gives no rows. A very
long text is a slice of its own, encoded whole, and decoded in steps. The result has the id and the operator's own
columns only, so extra input columns can't clash; an id column named like one of them comes out as `id`.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_name, quoted, slices

#: Fixed value: the public pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Python's \s has the four separators U+001C to U+001F, which are no white space in Unicode.
PATTERN_UNICODE = PATTERN.replace(r"[^\s\p", r"[^\p{White_Space}\p").replace(r"\s+(?!\S)|\s+", r"\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

#: Distinct pieces whose ids a worker remembers.
REMEMBERED = 500_000
#: Pieces or ids that are handled at once within one long text.
STEP = 1 << 20
NEVER = 1 << 62


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> its ids as little-endian bytes; encodes what is missing."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = np.asarray(self.bpe.encode_piece(piece.encode()), dtype="<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids
        return ids


class ByteBPE:
    """A byte-level BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model, symbols = spec["model"], byte_symbols()
        vocab: dict[str, int] = model["vocab"]
        if spec.get("normalizer") or model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens: list[bytes] = [b""] * size
        special = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens that strip or need whole words aren't supported")
            special[t["content"]] = t["id"]
            self.tokens[t["id"]] = t["content"].encode()
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for name, i in vocab.items():
            if name not in special:
                self.tokens[i] = bytes(symbols[c] for c in name)
        last = -1
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[a + b]
            if i <= last:
                raise ValueError("ids must follow the order of merges")
            last = i
            self.parts[i] = (vocab[a], vocab[b])
            self.merged[vocab[a], vocab[b]] = i
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self.specials = special
        self._special_re = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self._split = regex.compile(PATTERN_UNICODE).findall
        self._iter = regex.compile(PATTERN_UNICODE).finditer
        self._automaton = ahocorasick.Automaton()
        ordinary = [i for i, t in enumerate(self.tokens) if t and i not in set(special.values()) and self._stable(i)]
        by_bytes = {self.tokens[i]: i for i in ordinary}
        for t, i in by_bytes.items():
            self._automaton.add_word(t.decode("latin-1"), (len(t), i))
        self._automaton.make_automaton()
        self.shorter = {i: next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), None) for t, i in by_bytes.items()}
        self.pieces = _Pieces(self)
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token that at some time stand at its border, with the merge that ends each."""
        memo = self._left if side == 0 else self._right
        if token not in memo:
            out, part, ends = [], token, NEVER
            while True:
                out.append((part, ends))
                if part not in self.parts:
                    break
                part, ends = self.parts[part][side], part
            memo[token] = out
        return memo[token]

    def _crossing(self, a: int, b: int) -> int:
        """The first merge that joins a part of `a` with a part of `b` while both stand, or NEVER.

        Equal merges go from left to right: on the left side a merge of the same rank comes first, on the right it comes later."""
        first = NEVER
        for y, y_ends in self._spine(b, 0):
            for x, x_ends in self._spine(a, 1):
                m = self.merged.get((x, y))
                if m is not None and m < x_ends and m <= y_ends and m < first:
                    first = m
        return first

    def _stable(self, token: int) -> bool:
        return token not in self.parts or self._crossing(*self.parts[token]) == token

    def compatible(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[a, b] = self._crossing(a, b) == NEVER
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        reach = [0] * n
        for end, (length, i) in self._automaton.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > reach[start]:
                reach[start], longest[start] = length, i
        out: list[int] = []
        good = bytearray(b"\1" * (n + 1))
        pos, token = 0, longest[0] if n else None
        while token is not None:
            end = pos + len(self.tokens[token])
            if good[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else None
                continue
            token = self.shorter[token]
            while token is None:  # nothing fits here: never come back to this position
                good[pos] = 0
                pos -= len(self.tokens[last := out.pop()])
                token = self.shorter[last]
        return out

    def _ordinary(self, text: str) -> bytes:
        get = self.pieces.__getitem__
        if len(text) <= STEP:
            return b"".join(map(get, self._split(text)))
        found, out = self._iter(text), []
        while part := list(islice(found, STEP)):
            out.append(b"".join([get(m.group()) for m in part]))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Strings of special tokens become their ids."""
        if self._special_re is None or not self._special_re.search(text):
            return self._ordinary(text)
        out, at = [], 0
        for m in self._special_re.finditer(text):
            out += [self._ordinary(text[at : m.start()]), self.specials[m.group()].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._ordinary(text[at:])])

    def decode_bytes(self, ids: bytes) -> bytes:
        every, out = np.frombuffer(ids, dtype="<u4"), []
        for k in range(0, len(every), STEP):
            part = every[k : k + STEP]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1], dtype=np.int64) + np.repeat(self.offsets[part] - (ends - lengths), lengths)
            out.append(self.blob[at].tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_loaded: dict[str, ByteBPE] = {}


def load(source: bytes) -> ByteBPE:
    """One vocabulary per worker process."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(source)
    return _loaded[key]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded. `tokenizer`: a file on the driver,
    sent to the executors (a vocabulary's size is fixed)."""
    with open(tokenizer, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    named = own_name(id_col, ("ids", "n_tokens", "decoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(source.value)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(bpe.decode, ids)), pa.string())],
                    names=[named, "ids", "n_tokens", "decoded"],
                )

    return docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, f"{quoted(named)} {kind}, ids binary, n_tokens bigint, decoded string")
