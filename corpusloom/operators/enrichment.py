"""Chunks with the facts of their paper; properties of a PDF that fill gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.papers import header_path_class

# What counts as an equation and as a citation in a chunk.
EQUATION = r"\$\$|\$[^$]+\$"
CITATION = r"\[\d+\]|\([A-Z][a-z]+ et al\.,? \d{4}\)"
FACTS = ["title", "authors", "venue", "year", "doi", "arxiv_id", "paper_type", "confidence"]


def is_research_paper(confidence: Column) -> Column:
    """more than an even chance."""
    return confidence > 0.5


def section_at(sections: Column, position: Column) -> Column:
    """The kind of the first section that holds a position; null when none does."""
    return F.get(F.filter(sections, lambda s: (s["start"] <= position) & (position < s["end"])), F.lit(0))["kind"]


def enrich_chunks(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Chunks (document_id, text, header, header_path, start_char) with facts of papers (document_id, abstract, sections, FACTS).

    The header path names the section, the position only where it does not.  Chunks of a document
    that does not look like a paper (confidence of 0.5 or less, or unknown) keep null facts, and
    one row a document is expected of ``papers``.
    """
    facts = papers.select("document_id", F.when(is_research_paper(F.col("confidence")), F.struct("abstract", "sections", *FACTS)).alias("_p"))
    both = chunks.join(facts, "document_id", "left")
    path = F.coalesce(F.when(F.col("header_path") != "", F.col("header_path")), F.col("header"), F.lit(""))
    named = header_path_class(path, F.coalesce("_p.title", F.lit("")))
    placed = section_at(F.col("_p.sections"), F.coalesce("start_char", F.lit(0)))
    known = F.col("_p").isNotNull()
    section = F.when(known, F.when(named != "other", named).otherwise(F.coalesce(placed, F.lit("other"))))
    out = [F.col(f"_p.{f}").alias({"title": "paper_title", "confidence": "paper_confidence"}.get(f, f)) for f in FACTS]
    text = F.coalesce("text", F.lit(""))
    return both.select(*chunks.columns, *out, section.alias("section_type"), F.when(known, text.rlike(EQUATION)).alias("has_equations"), F.when(known, text.rlike(CITATION)).alias("has_citations"), F.when(known, (section == "abstract") & (F.coalesce("_p.abstract", F.lit("")) != "")).alias("is_abstract"))


def merge_properties(papers: DataFrame, properties: DataFrame) -> DataFrame:
    """Title, authors and pages of (document_id, title, author, total_pages) where the text gave none.

    ``author`` is split at commas.  Reading the file itself is up to the caller.
    """
    p = properties.select("document_id", F.col("title").alias("_title"), F.transform(F.split("author", ","), lambda a: F.trim(a)).alias("_authors"), F.col("total_pages").alias("_pages"))
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), "_title")
    authors = F.coalesce(F.when(F.size("authors") > 0, F.col("authors")), "_authors")
    pages = F.coalesce(F.when(F.col("total_pages") > 0, F.col("total_pages")), "_pages") if "total_pages" in papers.columns else F.col("_pages")
    return papers.join(p, "document_id", "left").withColumns({"title": title, "authors": authors, "total_pages": pages}).drop("_title", "_authors", "_pages")
