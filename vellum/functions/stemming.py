"""English lexemes for full text search: stop words and the published Porter2 stemmer."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual English stop list.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
# Words that the algorithm lists as exceptions.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME = frozenset("sky news howe atlas cosmos bias andes".split())
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_vowel = re.compile("[aeiouy]").search
_region = re.compile("[aeiouy][^aeiouy]")
_double = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$").search
_short_end = re.compile("([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$").search


def _after(word: str, start: int) -> int:
    """Where the region behind the next non-vowel that follows a vowel begins."""
    m = _region.search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, suffixes) -> str | None:
    return max((x for x in suffixes if word.endswith(x)), key=len, default=None)


def _plural(w: str) -> str:
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return w[:-2]
    if end in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if end == "s" and _vowel(w[:-2]) else w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end is None:
        return w
    base = w[: -len(end)]
    if end in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else w
    if not _vowel(base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _double(base):
        return base[:-1]
    return base + "e" if _short_end(base) and r1 >= len(base) else base


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3 or word in SAME:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.lstrip("'")
    w = re.sub("(^|(?<=[aeiouy]))y", "Y", w)
    plain = w.lower() if w.startswith("Y") else w
    head = next((x for x in ("gener", "commun", "arsen") if plain.startswith(x)), None)
    r1 = len(head) if head else _after(w, 0)
    r2 = _after(w, r1)
    w = re.sub("('s'|'s|')$", "", w)
    w = _plural(w)
    if w in KEPT:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    end = _longest(w, STEP_2)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: -len(end)] + STEP_2[end]
    end = _longest(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = _longest(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(1 << 16)
def lexeme(word: str) -> str:
    """The stem without outer punctuation; empty for stop words."""
    w = re.sub(r"^\W+|\W+$", "", word)
    return "" if w in STOP_WORDS else stem(w)


def lexemes(rows: pa.Array) -> pa.Array:
    """The lexemes of arrays of words. The words stay Arrow's, and each different one is stemmed once."""
    flat = pc.dictionary_encode(rows.flatten())
    stems = pa.array([None if w is None else lexeme(w) for w in flat.dictionary.to_pylist()], pa.string())
    ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), stems.take(flat.indices), mask=rows.is_null())


def stem_words(words: Column) -> Column:
    """The lexemes of lower-case words, each at its place."""

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        return lexemes(rows)

    return run(words)
