"""Recursive character splitting as an Arrow-batched UDF (the only fold here that needs a work list)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ")


def _pieces(text: str, sep: str) -> list[str]:
    """Cut before each separator, which stays at the start of its piece."""
    first, *rest = text.split(sep)
    return [p for p in (first, *(sep + r for r in rest)) if p]


def _joined(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in pieces:
        if held and total + len(p) > size:
            if text := "".join(held).strip():
                out.append(text)
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if text := "".join(held).strip():
        out.append(text)
    return out


def split_text(text: str, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters where the separators allow it, with overlaps of whole pieces."""
    k = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    rest = separators[k + 1 :]
    out: list[str] = []
    small: list[str] = []
    for p in _pieces(text, separators[k]):
        if len(p) < size:
            small.append(p)
            continue
        out += _joined(small, size, overlap)
        small = []
        out += split_text(p, size, overlap, rest) if rest else [p]
    return out + _joined(small, size, overlap)


#: Texts that are split before their pieces become Arrow's.
STEP = 128


def pieces(texts: pa.Array, size: int, overlap: int) -> pa.Array:
    """The chunks of each text. Only some texts and their chunks are Python's at once; the others stay Arrow's."""
    split = lambda part: pa.array([split_text(t, size, overlap) if t else [] for t in part.to_pylist()], pa.list_(pa.string()))
    return pa.concat_arrays([split(texts.slice(at, STEP)) for at in range(0, max(len(texts), 1), STEP)])


def recursive_split(text: Column, size: int = 512, overlap: int = 50) -> Column:
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pieces(texts, size, overlap)

    return run(text)
