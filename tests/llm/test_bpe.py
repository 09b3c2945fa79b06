import random

import numpy as np
import pytest
from pyspark.sql import Row

from vellum.llm import bpe
from vellum.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    with open(path, "rb") as f:
        return bpe.ByteBPE(f.read()), Tokenizer.from_file(path)


def ids(b, text):
    return np.frombuffer(b.encode(text), "<u4").tolist()


def test_random_texts_match_the_library(pair):
    ours, theirs = pair
    rng = random.Random(1)
    letters = "aabcde  \n\t\x1c\x85　'éß1.23<|endoftext|>stll日本🙂-ABthe ing"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.1:
            text += "<|endoftext|>" + text
        assert ids(ours, text) == theirs.encode(text, add_special_tokens=False).ids
        assert ours.decode(ours.encode(text)) == theirs.decode(theirs.encode(text, add_special_tokens=False).ids, skip_special_tokens=False) == text


def test_long_pieces_are_exact(pair):
    ours, theirs = pair
    for text in ("a" * 20000, "ab" * 9000, "é" * 5000, " " * 3000, "http" * 2000):
        assert ids(ours, text) == theirs.encode(text, add_special_tokens=False).ids


def test_code_points(pair):
    ours, theirs = pair
    for c in [*range(0x3000), *range(0x3000, 0x110000, 997)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1 {chr(c)}{chr(c)}b"
            assert ids(ours, text) == theirs.encode(text, add_special_tokens=False).ids, hex(c)


def test_operator_with_nulls_repeats_and_clashing_columns(spark):
    rows = [Row(doc_id=1, text="a b", ids="x", decoded=1), Row(doc_id=1, text="a b", ids="x", decoded=1), Row(doc_id=None, text=None, ids=None, decoded=None), Row(doc_id=3, text="", ids="", decoded=0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded int")
    out = bpe.encode_decode(docs, tokenizer_path()).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.decoded) for r in out) == [(-1, 0, ""), (1, 2, "a b"), (1, 2, "a b"), (3, 0, "")]
    assert bpe.encode_decode(docs.limit(0), tokenizer_path()).count() == 0
