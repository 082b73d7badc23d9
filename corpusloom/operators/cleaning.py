"""Cleaning of whole texts, step by step, so that no step is computed twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.preprocess import FENCE, HOLD, nfc, page_artifacts, strip


def preprocess(df: DataFrame, text: Column, into: str = "cleaned", artifacts: bool = True, most_newlines: int = 2) -> DataFrame:
    """The table with a struct column of the cleaned text and what was done.

    Fenced blocks are held out and put back unchanged; a fence that is not closed is prose.
    A null, empty or blank text gives an empty text, zeros and the error ``Empty input``.
    """
    # A held-out character that the text has itself is kept as a block of its own.
    pattern = f"{FENCE}|{HOLD}"
    step = "_{}_" + into
    at = lambda name: F.col(step.format(name))
    steps = {
        "raw": F.coalesce(text, F.lit("")),
        "blocks": F.regexp_extract_all(step.format("raw"), F.lit(pattern), F.lit(0)),
        "held": F.regexp_replace(step.format("raw"), pattern, HOLD),
        "plain": nfc(X.clean_unicode(at("held"))),
        "spaced": X.clean_whitespace(at("plain")),
        "short": X.collapse_newlines(at("spaced"), most_newlines),
        "lines": F.split(at("short"), "\n"),
        "repeated": page_artifacts(at("short")) if artifacts else F.array().cast("array<string>"),
        "left": F.filter(at("lines"), lambda x: ~F.array_contains(at("repeated"), strip(x))),
        "whole": F.zip_with(F.split(F.array_join(at("left"), "\n"), HOLD, -1), at("blocks"), lambda gap, b: F.concat(gap, F.coalesce(b, F.lit("")))),
        "done": strip(F.array_join(at("whole"), "")),
    }
    out = df
    for name, c in steps.items():
        out = out.withColumn(step.format(name), c)
    blank = strip(at("raw")) == ""
    count = lambda x: F.when(blank, F.lit(0)).otherwise(x)
    result = F.struct(
        F.when(blank, F.lit("")).otherwise(at("done")).alias("text"),
        count(F.size(at("blocks")) - F.regexp_count(at("raw"), F.lit(HOLD))).alias("code_blocks"),
        count(F.regexp_count(at("held"), F.lit(f"[{X.CURLY}{X.ELLIPSIS}{X.NO_SPACE}]"))).alias("unicode_changes"),
        count(F.length(at("plain")) - F.length(at("spaced"))).alias("spaces_removed"),
        count(F.length(at("spaced")) - F.length(at("short"))).alias("newlines_removed"),
        count(F.size(at("lines")) - F.size(at("left"))).alias("lines_removed"),
        F.round(F.when(blank, F.lit(0.0)).otherwise(100.0 * (1 - F.length(at("done")) / F.length(at("raw")))), 1).alias("reduction_percent"),
        F.when(blank, F.lit("Empty input")).alias("error"),
    )
    return out.withColumn(into, result).drop(*[step.format(name) for name in steps])
