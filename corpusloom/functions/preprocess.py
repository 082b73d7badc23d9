"""Cleaning of whole texts, evidence normal form, Markdown of a paper, changed numbers.

A null text gives null, except where a default is stated.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import text as X

# A fenced block, what ends a line of Python's strip, a number that stands alone.
FENCE = r"(?s)```.*?```"
NUMBER = r"(?<![\w.])\d+(?:\.\d+)?(?![\w.]*\d)"
PUNCTUATION, FOLDED = "‘’“”–—−\xa0", "''\"\"--- "
SECTION_PATH = ":::"
#: Stands for a fenced block while the prose around it is cleaned.
HOLD = "\U0010fffd"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{X.SPACE}+|{X.SPACE}+\z", "")


def evidence_normal(c: Column) -> Column:
    """Compatibility form, plain punctuation, single spaces, case folded."""
    return _casefold(strip(F.regexp_replace(F.translate(_nfkc(c), PUNCTUATION, FOLDED), rf"(?U){X.SPACE}+", " ")))


def page_artifacts(c: Column) -> Column:
    """Lines of 6 to 99 characters that stand five times or more; equal lines are neighbours once sorted."""
    lines = F.array_sort(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: (F.length(x) > 5) & (F.length(x) < 100) & ~x.contains(HOLD)))
    return F.array_distinct(F.filter(lines, lambda x, i: x == F.get(lines, i + 4)))


def markdown(title: Column, abstract: Column, sections: Column) -> Column:
    """A paper as Markdown; sections: array<struct<section, paragraphs>>, names are paths of ``:::``.

    Null parts are left out; a paper without any part gives one line end.
    """
    some = lambda x, new: F.when(x != "", F.array(*new))
    none = F.array().cast("array<string>")

    def section(s: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.coalesce(s["section"], F.lit("")), SECTION_PATH), strip), lambda x: x != "")
        level = F.least(F.size(parts) + 1, F.lit(6))
        head = F.when(F.size(parts) > 0, F.array(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.element_at(parts, -1)))).otherwise(none)
        return F.concat(head, F.transform(F.coalesce(F.array_compact(s["paragraphs"]), none), strip))

    head = F.coalesce(some(title, [F.concat(F.lit("# "), strip(title))]), none)
    about = F.coalesce(some(abstract, [F.lit("## Abstract"), strip(abstract)]), none)
    body = F.coalesce(F.flatten(F.transform(sections, section)), none)
    return F.concat(strip(F.array_join(F.concat(head, about, body), "\n\n")), F.lit("\n"))


def perturb_number(c: Column, seed: int = 0) -> Column:
    """The text with one of its numbers changed to another near it, not negative; null without a number.

    Numbers of over 24 digits get a further one before them.  Number, direction and distance hang on a hash of text and seed, so reruns agree.
    """
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    draw = lambda name, n: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(name)), F.lit(n))
    share, sign = draw("far", 10_000) / 10_000, F.when(draw("up", 2) == 1, 1).otherwise(-1)

    def other(x: Column) -> Column:
        places = F.length(F.substring_index(x, ".", -1))
        near = x.cast("double") + sign * (1 + 8 * share)
        near = F.when(near < 0, x.cast("double") + 7).otherwise(near)
        # A fixed number of decimals, cut from a decimal as wide as any.
        fixed = F.round(near.cast("decimal(38,12)"), 12).cast("string")
        small = F.concat(F.substring_index(fixed, ".", 1), F.lit("."), F.substring(F.substring_index(fixed, ".", -1), F.lit(1), F.least(places, F.lit(12))))
        whole = x.cast("decimal(38,0)")
        moved = whole + sign * F.greatest(F.lit(1), F.floor(whole.cast("double") * (0.2 + 0.4 * share))).cast("decimal(38,0)")
        return F.when(F.length(x) > 24, None).when(x.contains("."), small).otherwise(F.when(moved < 0, whole + 7).otherwise(moved).cast("decimal(38,0)").cast("string"))

    at = F.pmod(F.xxhash64(c, F.lit(seed)), F.size(found)).cast("int")
    new = F.transform(found, lambda x, i: F.when(i == at, F.coalesce(other(x), F.concat(F.lit("1"), x))).otherwise(x))
    gaps = F.split(c, NUMBER, -1)
    return F.when(F.size(found) > 0, F.array_join(F.zip_with(gaps, new, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), ""))
