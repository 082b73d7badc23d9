"""Context blocks of found sources, and prompts.

Sources are array<struct<paper_title, authors, year, venue, section_type, text>>; null fields are
left out.  No sources give an empty block.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and sentences that a generator is given.
UNKNOWN = "Unknown Document"
BETWEEN_SOURCES, RULE = "\n---\n", "\n\n" + "=" * 50
ASK = ["Based on the following source documents, answer the question.", "Cite your sources using the format: (Author et al., Year, Section)", "", "SOURCE DOCUMENTS:"]
ANSWER = "ANSWER (with citations):"
COMPARE = ["Compare the following research papers to answer this question:\n\nQUESTION: ", "\n\nPAPER EXCERPTS:\n", "\n\nProvide a structured comparison with citations:"]


def _given(c: Column, missing: str = "") -> Column:
    return F.when((c != "") & (c != missing), c)


def _after(label: str, c: Column) -> Column:
    return F.coalesce(F.concat(F.lit(label), c), F.lit(""))


def source_authors(authors: Column) -> Column:
    """One or two names, or the first surname of several; null for none."""
    first, n = F.get(authors, F.lit(0)), F.size(authors)
    surname = F.coalesce(_given(F.element_at(F.split(F.trim(first), r"\s+"), -1)), F.lit("Unknown"))
    return _given(F.when(n == 1, first).when(n == 2, F.concat_ws(" and ", first, F.get(authors, F.lit(1)))).when(n > 2, F.concat(surname, F.lit(" et al."))))


def cite_as(authors: Column, year: Column, section: Column) -> Column:
    """The citation that stands for a source; null without author and year."""
    who, when = source_authors(authors), _given(year.cast("string"), "n.d.")
    parts = F.concat_ws(", ", who, F.coalesce(when, F.lit("n.d.")), _given(section, "unknown"))
    return F.when(who.isNotNull() | when.isNotNull(), F.concat(F.lit("("), parts, F.lit(")")))


def context(sources: Column) -> Column:
    """Each source with a header, its citation and its text."""

    def block(s: Column, i: Column) -> Column:
        title, year = _given(s["paper_title"], UNKNOWN), _given(s["year"].cast("string"), "n.d.")
        head = F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("]"), _after(" Paper: ", title), _after(" | Authors: ", source_authors(s["authors"])), _after(" | Year: ", year), _after(" | Venue: ", _given(s["venue"])), _after(" | Section: ", _given(s["section_type"], "unknown")))
        return F.concat(head, _after("\nCite this source as: ", cite_as(s["authors"], s["year"], s["section_type"])), F.lit("\n"), F.coalesce(s["text"], F.lit("")), F.lit("\n"))

    return F.array_join(F.transform(sources, block), BETWEEN_SOURCES)


def context_by_paper(sources: Column) -> Column:
    """X41 for comparisons: the sources of each paper together, papers in the order they are met."""
    title = lambda s: F.coalesce(s["paper_title"], F.lit(UNKNOWN))

    def paper(t: Column) -> Column:
        of = F.filter(sources, lambda s: title(s) == t)
        first = F.get(of, F.lit(0))
        head = F.concat(F.lit("=== PAPER: "), t, F.lit(" ==="), _after("\nAuthors: ", source_authors(first["authors"])), _after(" | Year: ", _given(first["year"].cast("string"), "n.d.")), _after(" | Venue: ", _given(first["venue"])))
        parts = F.transform(of, lambda s: F.concat(F.lit("["), F.coalesce(s["section_type"], F.lit("unknown")), F.lit("] "), F.coalesce(s["text"], F.lit(""))))
        return F.concat_ws("\n\n", head, F.array_join(parts, "\n\n"))

    papers = F.transform(F.array_distinct(F.transform(sources, title)), paper)
    # The rule stands once, before the first paper.
    return F.concat(F.lit(RULE), F.array_join(papers, "\n\n"))


def prompt(query: Column, block: Column, more: Column | None = None) -> Column:
    """Instructions, context, further context if any, question."""
    extra = F.lit(None).cast("string") if more is None else F.concat(F.lit("ADDITIONAL CONTEXT:\n"), _given(more), F.lit("\n"))
    return F.concat_ws("\n", *[F.lit(a) for a in ASK], F.coalesce(block, F.lit("")), F.lit(""), extra, F.concat(F.lit("QUESTION: "), F.coalesce(query, F.lit(""))), F.lit(""), F.lit(ANSWER))


def comparison_prompt(query: Column, block: Column) -> Column:
    """X42 for comparisons."""
    return F.concat(F.lit(COMPARE[0]), F.coalesce(query, F.lit("")), F.lit(COMPARE[1]), F.coalesce(block, F.lit("")), F.lit(COMPARE[2]))
