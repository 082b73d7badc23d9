"""Porter's stems of English words (M. F. Porter, "An algorithm for suffix stripping", 1980)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings of the published steps 2 to 4 and what replaces them.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """A letter's kind: c for a consonant, v for a vowel; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and k and out[-1] == "c" else "c"
    return out


def measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends as in hop, not in how, box or play."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    ending = _longest(word, ("ed", "ing"))
    if ending is None or "v" not in _shape(word[: -len(ending)]):
        return word
    word = word[: -len(ending)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _double(word) and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if measure(word) == 1 and _short(word) else word


def _replaced(word: str, endings: dict[str, str]) -> str:
    ending = _longest(word, endings)
    return word[: -len(ending)] + endings[ending] if ending and measure(word[: -len(ending)]) else word


def _dropped(word: str) -> str:
    ending = _longest(word, STEP_4)
    if ending is None or measure(word[: -len(ending)]) < 2:
        return word
    return word if ending == "ion" and word[-4:-3] not in ("s", "t") else word[: -len(ending)]


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """A lower-case word's stem; words of one or two letters stay."""
    if len(word) < 3:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _dropped(_replaced(_replaced(word, STEP_2), STEP_3))
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if measure(word) > 1 and _double(word) and word[-1] == "l" else word


def stems(tokens: Column, least: int = 4) -> Column:
    """Tokens of ``least`` letters at least by their stems."""

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [stem(t) if len(t) >= least else t for t in r] for r in rows], dtype=object)

    return F.pandas_udf(run, "array<string>")(tokens)
