"""Column functions on answers: sentences, claims, citations, cleaning and overlap measures.

A null text gives null, or an empty array where a list is returned by ``claims``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.stems import stems

# Patterns and words that decide what a claim, a citation or a key word is.
ABBREVIATIONS = r"(?i)\b(et al|e\.g|i\.e|cf|vs|Fig|Figs|Eq|Eqs|Sec|Tab|approx|resp|etc)\."
BOUNDARY = r"(?<=[.!?])\s+(?=[\"'(\[A-Z0-9*-])"
MARKER = r"\s*(\[\d+(?:\s*[,-]\s*\d+)*\]|\[Source \d+\]|\((?:[A-Z][^()]*?,\s*(?:\d{4}|n\.d\.)[^()]*)\))"
MARKDOWN = r"^\s*(#+\s*|[-*]\s+|\d+[.)]\s+|>\s*)"
BOLD_LINE = r"^\*\*[^*]+\*\*:?\s*$"
BOLD_LABEL = r"^\*\*[^*]{1,60}?:\*\*\s*|^\*\*[^*]{1,60}?\*\*:\s*"
SOURCES = r"(?i)^(\*\*)?(sources|references|citations)(\*\*)?:?\s*$"
CLAIM_STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "their", "they", "this", "to", "was", "were", "which", "with", "we", "our", "not"]
QUERY_STOP = ["what", "how", "did", "does", "is", "are", "was", "were", "the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "but", "with", "from", "by", "about", "which", "that", "this", "it", "do", "can", "you", "we", "they", "its", "their", "has", "have", "had"]
KEY_STOP = ["a", "an", "the", "of", "for", "and", "in", "on", "to", "with"]
# What is tidied up where citations went, in this order.
TIDY_UP = [(r"\(\s*\)", ""), (r"[ \t]{2,}", " "), (r"\s+([.,;:])", "$1"), (r"([.,;:])(?:\s*\1)+", "$1")]
PARENTHETICAL = r"\(\s*[A-Z][^()]{0,120}?\b(?:\d{4}|n\.d\.)[^()]{0,60}?\)"
NARRATIVE = r"(?:\b(?:According to|As reported (?:by|in)|As shown (?:by|in)|As described (?:by|in)|Per|Following)\s+)?\b([A-Z][A-Za-z\-']+)(?:\s+(?:et\s+al\.?|and\s+[A-Z][A-Za-z\-']+))?\s*\(\s*(\d{4}|n\.d\.)[^()]{0,60}?\),?\s*"
CITED = [r"\(([A-Z][a-z]+)\s+et\s+al\.\s*,\s*\d{4}", r"\(([A-Z][a-z]+)\s*&\s*[A-Z][a-z]+\s*,\s*\d{4}", r"\(([A-Z][a-z]+)\s*,\s*\d{4}"]
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
HELD = "\ue000"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def replace_each(c: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """Each match of ``pattern`` becomes ``new(match)``: the gaps and the matches are zipped."""
    return F.array_join(F.zip_with(F.split(c, pattern, -1), F.transform(_all(c, pattern), new), lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")


def split_sentences(c: Column) -> Column:
    """Sentences of each line; full stops of known abbreviations do not end one."""
    lines = F.transform(F.split(F.regexp_replace(c, ABBREVIATIONS, "$1" + HELD), LINE_ENDS), _strip)
    parts = F.flatten(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.split(x, BOUNDARY)))
    return F.filter(F.transform(parts, lambda x: _strip(F.replace(x, F.lit(HELD), F.lit(".")))), lambda x: x != "")


def claims(c: Column, least_words: int = 4) -> Column:
    """The checkable sentences of an answer, up to its list of sources."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), LINE_ENDS), _strip)
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(SOURCES)), True).cast("int")
    told = F.filter(F.when(stop > 0, F.slice(lines, F.lit(1), stop - 1)).otherwise(lines), lambda x: ~x.startswith("#"))
    bodies = F.filter(F.transform(told, lambda x: F.regexp_replace(x, MARKDOWN, "")), lambda x: ~x.rlike(BOLD_LINE))
    parts = F.flatten(F.transform(bodies, lambda x: split_sentences(F.regexp_replace(x, BOLD_LABEL, ""))))
    bare = F.transform(parts, lambda x: _strip(F.replace(F.regexp_replace(F.regexp_replace(x, MARKDOWN, ""), MARKER, ""), F.lit("**"), F.lit(""))))
    return F.filter(bare, lambda x: ~x.endswith(":") & (F.size(_words(x)) >= least_words))


def content_words(c: Column) -> Column:
    """The distinct words that carry meaning."""
    return F.array_except(_all(F.lower(c), r"[a-z0-9][a-z0-9.\-]*"), _strings(CLAIM_STOP))


def clean_answer(c: Column) -> Column:
    """A model's raw reply without reasoning, quotes and prefix; its first line only."""
    text = _strip(F.regexp_replace(_strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?</think>", "")), r"^\"+|\"+$", ""))
    first = F.regexp_replace(_strip(F.get(F.split(text, LINE_ENDS), F.lit(0))), r"(?i)^(final\s+)?answer\s*:\s*", "")
    return F.when(first.rlike(r"(?i)^unanswerable\b"), F.lit("Unanswerable")).otherwise(first)


def _last(name: Column) -> Column:
    return F.element_at(F.split(_strip(name), r"\s+"), -1)


def _some(c: Column) -> Column:
    return F.when(c.isNotNull() & (c.cast("string") != "") & (c.cast("string") != "0"), c.cast("string"))


def short_authors(authors: Column) -> Column:
    """Surnames of one or two authors, the first of more; null for none."""
    n, at = F.size(authors), lambda k: _last(F.get(authors, F.lit(k)))
    return F.when(n == 1, at(0)).when(n == 2, F.concat_ws(" and ", at(0), at(1))).when(n > 2, F.concat(at(0), F.lit(" et al.")))


def inline_citation(authors: Column, year: Column, section: Column, page: Column) -> Column:
    """(authors, year, section, page); what is missing is left out, a missing year reads n.d."""
    part = F.when(section != "unknown", F.initcap(_some(section)))
    return F.concat(F.lit("("), F.concat_ws(", ", short_authors(authors), F.coalesce(_some(year), F.lit("n.d.")), part, F.concat(F.lit("p."), _some(page))), F.lit(")"))


def reference_entry(number: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column) -> Column:
    """A numbered line of the reference list; at most three authors are named."""
    name = lambda a: F.when(F.size(_words(a)) >= 2, F.concat(_last(a), F.lit(", "), F.substring(_strip(a), 1, 1), F.lit("."))).otherwise(a)
    named = F.array_join(F.transform(F.slice(authors, 1, 3), name), ", ")
    who = F.when(F.size(authors) > 3, F.concat(named, F.lit(", et al."))).when(F.size(authors) > 0, named)
    return F.concat_ws(" ", F.concat(F.lit("["), number.cast("string"), F.lit("]")), who, F.concat(F.lit("("), F.coalesce(_some(year), F.lit("n.d.")), F.lit(").")), F.concat(title, F.lit(".")), F.concat(_some(venue), F.lit(".")), F.concat(F.lit("DOI: "), _some(doi)))


def bibtex_key(authors: Column, year: Column, title: Column) -> Column:
    """Surname, year or nd, first word of the title that is not a stop word."""
    words = F.filter(_words(F.regexp_replace(F.lower(title), r"(?U)[^\w\s]", "")), lambda w: ~w.isin(KEY_STOP))
    return F.concat(F.coalesce(F.lower(_last(F.get(authors, F.lit(0)))), F.lit("unknown")), F.coalesce(_some(year), F.lit("nd")), F.coalesce(F.get(words, F.lit(0)), F.lit("paper")))


def bibtex_entry(authors: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    """A BibTeX entry, of a conference where a venue is known."""
    field = lambda name, value: F.concat(F.lit(f"  {name}={{"), value, F.lit("},"))
    who = F.when(F.size(authors) > 0, F.array_join(authors, " and "))
    head = F.concat(F.when(_some(venue).isNotNull(), F.lit("@inproceedings{")).otherwise(F.lit("@article{")), bibtex_key(authors, year, title), F.lit(","))
    return F.concat_ws("\n", head, field("title", title), field("author", who), field("year", _some(year)), field("booktitle", _some(venue)), field("doi", _some(doi)), F.lit("}"))


def supported_pairs(sources: Column) -> Column:
    """``surname|year`` of every author of sources: array<struct<authors, year>>."""
    dated = F.filter(sources, lambda s: _some(s["year"]).isNotNull() & s["authors"].isNotNull())
    return F.flatten(F.transform(dated, lambda s: F.transform(s["authors"], lambda a: F.concat(F.lower(_last(a)), F.lit("|"), s["year"].cast("string")))))


def strip_citations(c: Column, sources: Column) -> Column:
    """Struct of the answer without citations that no source supports, and how many went."""
    pairs = supported_pairs(sources)
    pair = lambda m, name, year: F.concat(F.lower(F.regexp_extract(m, name, 1)), F.lit("|"), F.regexp_extract(m, year, 1))
    inside = lambda m: F.array_contains(pairs, pair(m, r"\(\s*([A-Z][A-Za-z\-']+)", r"\b(\d{4})\b"))
    outside = lambda m: F.array_contains(pairs, F.concat(F.lower(F.regexp_extract(m, NARRATIVE, 1)), F.lit("|"), F.regexp_extract(m, NARRATIVE, 2)))
    first = replace_each(c, PARENTHETICAL, lambda m: F.when(inside(m), m))
    second = replace_each(first, NARRATIVE, lambda m: F.when(outside(m), m))
    gone = F.size(F.filter(_all(c, PARENTHETICAL), lambda m: ~inside(m))) + F.size(F.filter(_all(first, NARRATIVE), lambda m: ~outside(m)))
    tidy = second
    for pattern, new in TIDY_UP:
        tidy = F.regexp_replace(tidy, pattern, new)
    tidy = _strip(replace_each(tidy, r"(?:^|[.!?]\s+)[a-z]", F.upper))
    return F.struct(F.when(gone > 0, tidy).otherwise(second).alias("answer"), gone.alias("removed"))


def has_citation(c: Column) -> Column:
    """Whether an answer cites in either form."""
    return F.coalesce(c.rlike(PARENTHETICAL) | c.rlike(NARRATIVE), F.lit(False))


def citation_scores(answer: Column, papers: Column) -> Column:
    """M8: precision, recall and F1 of cited surnames against the papers' joined text."""
    cited = F.array_distinct(F.concat(*[_all(answer, p, 1) for p in CITED]))
    body = F.lower(F.array_join(papers, " "))
    n, m, hit = F.size(cited), F.size(papers), F.size(F.filter(cited, lambda a: F.contains(body, F.lower(a))))
    both = (n == 0) & (m == 0)
    p = F.when(both, F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(hit / n)
    r = F.when(both, F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(F.least(hit, m) / m)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def completeness(answer: Column, query: Column) -> Column:
    """M9: the share of a question's words that the answer holds."""
    asked = F.array_except(_words(F.lower(query)), _strings(QUERY_STOP))
    return F.when(F.size(asked) == 0, F.lit(1.0)).otherwise(F.size(F.filter(asked, lambda w: F.contains(F.lower(answer), w))) / F.size(asked))


def paragraph_f1(found: Column, gold: Column) -> Column:
    """Overlap as sets, lengths as lists; two empty lists agree."""
    same = F.size(F.array_intersect(found, gold)).cast("double")
    return F.when((F.size(found) == 0) & (F.size(gold) == 0), F.lit(1.0)).when(same == 0, F.lit(0.0)).otherwise(2 * same / (F.size(found) + F.size(gold)))


def rouge_tokens(c: Column, stemmed: bool = False) -> Column:
    """Lower-case runs of a-z and 0-9, by their stems if wanted."""
    found = _all(F.lower(c), "[a-z0-9]+")
    return stems(found) if stemmed else found


def ngrams(tokens: Column, n: int) -> Column:
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return F.transform(F.slice(tokens, F.lit(1), count), lambda t, k: F.array_join(F.slice(tokens, k + 1, F.lit(n)), " "))


def _pairwise(measure: Callable[[list, list], int]):
    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or y is None else measure(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")

    return run


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence; a bit of one integer for each item of ``b``."""
    where: dict = {}
    for k, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << k
    full = row = (1 << len(b)) - 1
    for t in a:
        hit = row & where.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def common_run(a: list, b: list) -> int:
    """Length of the longest run of items that stands in both lists."""
    codes: dict = {}
    right = np.array([codes.setdefault(t, len(codes)) for t in b], np.int64)
    before, best = np.zeros(len(b) + 1, np.int64), 0
    for t in a:
        now = np.zeros_like(before)
        if (code := codes.get(t)) is not None:
            now[1:] = np.where(right == code, before[:-1] + 1, 0)
            best = max(best, int(now.max()))
        before = now
    return best


def rouge_l(answer: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of two token arrays; ROUGE-1 and -2 are ``evaluation.multiset_f1`` of tokens and ``ngrams``."""
    size = F.size(answer) + F.size(gold)
    return F.when(size > 0, 2 * _pairwise(common_subsequence)(answer, gold) / size).otherwise(F.lit(0.0))


def coverage(evidence: Column, chunk: Column) -> Column:
    """The longest shared run of tokens as a share of either side."""
    run = _pairwise(common_run)(evidence, chunk)
    share = lambda c: F.when(F.size(c) > 0, run / F.size(c)).otherwise(F.lit(0.0))
    return F.struct(share(evidence).alias("of_evidence"), share(chunk).alias("of_chunk"))
