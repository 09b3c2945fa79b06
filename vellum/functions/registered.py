"""Functions under SQL names, for sessions whose users write SQL. Batches go to Python by Arrow."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import hashed_vector
from ..operators.splitter import split_text
from .stemming import lexeme


def register(spark: SparkSession, embed: Callable[[str], list[float]] | None = None, dim: int = 64) -> list[str]:
    """Registers stem_en(word), split_recursive(text) and embed(text), and returns their names. `embed` takes the place of the hashing embedder."""
    vector = embed or (lambda t: hashed_vector(t, dim))

    @F.pandas_udf("string")
    def stem_en(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else lexeme(w.lower()))

    @F.pandas_udf("array<string>")
    def split_recursive(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t) if t else [])

    @F.pandas_udf("array<float>")
    def embedded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: vector(t or ""))

    made = {"stem_en": stem_en, "split_recursive": split_recursive, "embed": embedded}
    for name, f in made.items():
        spark.udf.register(name, f)
    return list(made)
