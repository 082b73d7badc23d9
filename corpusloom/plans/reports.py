"""Registered queries: cleaning, prompts, papers as Markdown, enriched chunks, report checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import preprocess as C
from corpusloom.functions import papers as P
from corpusloom.functions import prompts
from corpusloom.operators import report
from corpusloom.operators.chunking import chunk_documents
from corpusloom.operators.cleaning import preprocess
from corpusloom.operators.enrichment import enrich_chunks
from corpusloom.plans.papers import _papers

# A fenced block before each document's text.
FENCED = "```\n  a   b\n```\nstart “of”  "


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def preprocess_documents(spark, sf):
    cleaned = preprocess(_docs(spark, sf).select("doc_id", "text"), F.concat(F.lit(FENCED), "text"), "p")
    return cleaned.select("doc_id", F.md5(F.col("p.text").cast("binary")).alias("cleaned"), "p.code_blocks", "p.newlines_removed", "p.lines_removed")


def evidence_normal(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(C.evidence_normal(F.col("text")).cast("binary")).alias("normal"))


def _sources(spark, sf):
    authors = F.slice(F.array(F.lit("Ada B. Lovelace"), F.lit("Alan Turing"), F.lit("Emmy Noether")), F.lit(1), (F.col("doc_id") % 4).cast("int"))
    of = F.struct(
        F.concat(F.lit("Paper "), (F.col("doc_id") % 2).cast("string")).alias("paper_title"),
        authors.alias("authors"),
        F.when(F.col("doc_id") % 3 != 0, 2000 + F.col("doc_id") % 3).alias("year"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("ICML")).alias("venue"),
        F.when(F.col("doc_id") % 5 != 0, F.lit("results")).alias("section_type"),
        F.md5(F.col("text").cast("binary")).alias("text"),
    )
    return _docs(spark, sf).select(F.floor(F.col("doc_id") / 4).alias("query_id"), F.col("doc_id"), of.alias("s")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "s"))), lambda x: x["s"]).alias("sources"))


def prompt_blocks(spark, sf):
    q = F.concat(F.lit("Question "), F.col("query_id").cast("string"), F.lit("?"))
    return _sources(spark, sf).select("query_id", F.md5(prompts.prompt(q, prompts.context(F.col("sources"))).cast("binary")).alias("prompt"))


def comparison_prompts(spark, sf):
    q = F.concat(F.lit("Question "), F.col("query_id").cast("string"), F.lit("?"))
    return _sources(spark, sf).select("query_id", F.md5(prompts.comparison_prompt(q, prompts.context_by_paper(F.col("sources"))).cast("binary")).alias("prompt"))


def paper_markdown(spark, sf):
    """The lines of a document as paragraphs of one section."""
    sections = F.array(F.struct(F.lit("Methods ::: Data").alias("section"), F.split("text", "\n").alias("paragraphs")))
    return _docs(spark, sf).select("doc_id", F.md5(C.markdown(F.concat(F.lit("Item "), "doc_id"), F.col("source"), sections).cast("binary")).alias("markdown"))


def perturbed_numbers(spark, sf):
    text = F.concat(F.lit("Model "), "doc_id", F.lit(" scores 0.75 on "), "n_chars", F.lit(" items"))
    return _docs(spark, sf).select("doc_id", text.alias("claim"), C.perturb_number(text).alias("changed"))


def enriched_chunks(spark, sf):
    c = F.col("text")
    papers = P.with_structure(_papers(spark, sf))
    facts = papers.select(
        F.col("doc_id").cast("string").alias("document_id"), P.abstract(c).alias("abstract"), "s.sections", "s.title", "s.authors",
        F.lit("ICML").alias("venue"), F.lit(2020).alias("year"), P.doi(c).alias("doi"), P.arxiv_id(c).alias("arxiv_id"), F.lit("journal").alias("paper_type"),
        P.confidence(P.abstract(c).isNotNull(), F.size("s.sections"), P.reference_count(c), F.col("s.title").isNotNull(), F.size("s.authors"), P.citation_count(c), F.lit(True)).alias("confidence"),
    )
    chunks = chunk_documents(_papers(spark, sf).select(F.col("doc_id").alias("document_id"), "text"))
    return enrich_chunks(chunks, facts).select("chunk_id", "paper_title", "year", "section_type", "has_equations", "has_citations", "is_abstract")


def report_grades(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", report.grade((F.col("vec_id") % 100) / 100).alias("grade"))


def sample_warnings(spark, sf):
    some = lambda on, n: F.when(F.col("doc_id") % n != 0, F.array(F.lit(1))).alias(on)
    samples = _docs(spark, sf).select(some("retrieved_ids", 3), some("relevant_ids", 5), F.lit(None).cast("string").alias("generated_answer"))
    return report.sample_warnings(samples).select("measure", "scorable", "total")


def corpus_integrity(spark, sf):
    docs = _docs(spark, sf).select(F.col("doc_id").alias("document_id"))
    labelled = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("document_id"))
    return report.integrity(labelled, docs, docs, labelled)


QUERIES = {f.__name__: f for f in (preprocess_documents, evidence_normal, prompt_blocks, comparison_prompts, paper_markdown, perturbed_numbers, enriched_chunks, report_grades, sample_warnings, corpus_integrity)}

_WS = r"[\s\x0b\x1c-\x1f\x85\xa0\p{Z}]"
_strip = lambda x: rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_BARE = _strip("x")
_END = rf"regexp_replace(x, '{_WS}+$', '')"
_BODY = rf"regexp_replace({_END}, '^{_WS}+', '')"
_LINE = f"repeat(' ', least(4, length({_END}) - length({_BODY}))::INT) || regexp_replace({_BODY}, ' +', ' ', 'g')"
_SOURCES = """WITH s AS (SELECT doc_id // 4 AS query_id, doc_id, md5(text) AS text, 'Paper ' || doc_id % 2 AS title,
CASE doc_id % 4 WHEN 1 THEN 'Ada B. Lovelace' WHEN 2 THEN 'Ada B. Lovelace and Alan Turing' WHEN 3 THEN 'Lovelace et al.' END AS who, CASE WHEN doc_id % 3 <> 0 THEN (2000 + doc_id % 3)::VARCHAR END AS year,
CASE WHEN doc_id % 2 = 0 THEN 'ICML' END AS venue, CASE WHEN doc_id % 5 <> 0 THEN 'results' END AS section, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS n FROM documents)"""

ORACLES = {
    "preprocess_documents": rf"""WITH a AS (SELECT doc_id, nfc_normalize(translate(replace(replace('start “of”  ' || text, '…', '...'), chr(8203), ''), '“”‘’–—' || chr(160) || '•·', '""''''-- --')) AS t FROM documents),
b AS (SELECT doc_id, array_to_string(list_transform(string_split(replace(t, chr(9), ' '), chr(10)), lambda x: {_LINE}), chr(10)) AS t FROM a),
c AS (SELECT doc_id, length(t) AS n, string_split(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS lines FROM b),
r AS (SELECT doc_id, list(line) AS repeated FROM (SELECT doc_id, {_strip('line')} AS line FROM (SELECT doc_id, unnest(lines) AS line FROM c) GROUP BY ALL HAVING count(*) >= 5 AND length(line) BETWEEN 6 AND 99) GROUP BY doc_id),
d AS (SELECT c.doc_id, n, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(repeated, []), {_BARE})) AS kept FROM c LEFT JOIN r USING (doc_id))
SELECT doc_id, md5({_strip("'```' || chr(10) || '  a   b' || chr(10) || '```' || chr(10) || array_to_string(kept, chr(10))")}) AS cleaned, 1 AS code_blocks, n - length(array_to_string(lines, chr(10))) AS newlines_removed, len(lines) - len(kept) AS lines_removed FROM d""",
    "prompt_blocks": _SOURCES + """, b AS (SELECT query_id, n, '[Source ' || n || '] Paper: ' || title || coalesce(' | Authors: ' || who, '') || coalesce(' | Year: ' || year, '') || coalesce(' | Venue: ' || venue, '') || coalesce(' | Section: ' || section, '')
|| CASE WHEN who IS NULL AND year IS NULL THEN '' ELSE chr(10) || 'Cite this source as: (' || concat_ws(', ', who, coalesce(year, 'n.d.'), section) || ')' END || chr(10) || text || chr(10) AS block FROM s)
SELECT query_id, md5(concat_ws(chr(10), 'Based on the following source documents, answer the question.', 'Cite your sources using the format: (Author et al., Year, Section)', '', 'SOURCE DOCUMENTS:', string_agg(block, chr(10) || '---' || chr(10) ORDER BY n), '', 'QUESTION: Question ' || query_id || '?', '', 'ANSWER (with citations):')) AS prompt FROM b GROUP BY query_id""",
    "comparison_prompts": _SOURCES + """, p AS (SELECT query_id, title, min(n) AS n, '=== PAPER: ' || title || ' ===' || coalesce(chr(10) || 'Authors: ' || arg_min(who, n) FILTER (n <= 2), '') || coalesce(' | Year: ' || arg_min(year, n) FILTER (n <= 2), '') || coalesce(' | Venue: ' || min(venue), '') || chr(10) || chr(10) || string_agg('[' || coalesce(section, 'unknown') || '] ' || text, chr(10) || chr(10) ORDER BY n) AS block FROM s GROUP BY query_id, title)
SELECT query_id, md5('Compare the following research papers to answer this question:' || repeat(chr(10), 2) || 'QUESTION: Question ' || query_id || '?' || repeat(chr(10), 2) || 'PAPER EXCERPTS:' || chr(10) || repeat(chr(10), 2) || repeat('=', 50) || string_agg(block, repeat(chr(10), 2) ORDER BY n) || repeat(chr(10), 2) || 'Provide a structured comparison with citations:') AS prompt FROM p GROUP BY query_id""",
    "paper_markdown": rf"SELECT doc_id, md5({_strip(f'''array_to_string(list_concat(['# Item ' || doc_id], CASE WHEN source <> '' THEN ['## Abstract', source] ELSE [] END, ['### Data'], list_transform(string_split(text, chr(10)), lambda x: {_BARE})), repeat(chr(10), 2))''')} || chr(10)) AS markdown FROM documents",
    "report_grades": "SELECT vec_id, CASE WHEN g >= 0.7 THEN 'Excellent' WHEN g >= 0.5 THEN 'Good' WHEN g >= 0.3 THEN 'Fair' ELSE 'Needs Improvement' END AS grade FROM (SELECT vec_id, (vec_id % 100) / 100.0 AS g FROM embeddings)",
    "sample_warnings": "SELECT 'retrieval' AS measure, count(*) FILTER (doc_id % 15 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0) AS scorable, count(*) AS total FROM documents UNION ALL SELECT 'answers', 0, count(*) FROM documents",
    "corpus_integrity": """WITH n AS (SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS asked, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS ingested, (SELECT count(*) FROM documents) AS stored, (SELECT count(*) FROM labels) AS vectors)
SELECT *, expected = found AS ok FROM (SELECT 'papers_ingested' AS name, asked AS expected, ingested AS found FROM n UNION ALL SELECT 'documents_stored', asked, stored FROM n UNION ALL SELECT 'vectors_stored', stored, vectors FROM n)""",
}
