"""Registered queries on papers: documents dressed as papers, and their facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import papers as P
from corpusloom.functions.text import HEADINGS, PAPER_VENUES, venue

YEAR_NOW = 2026
# The front matter of the dressed documents, by doc_id % 5, and their DOI, by doc_id % 4.
FRONTS = ["Received 3 May 2019", "Journal of Proofs (2015) 12:84", "arXiv:2103.12345v1", "Between 1999 and 2001 and 2001", "IEEE Letters"]


# Their authors: up to three in a row, with a mark at every other paper.
AUTHORS = ["Ada B. Lovelace", "Alan Turing", "Jan van der Berg", "Emmy Noether", "O'Neil Smith"]


def _papers(spark, sf):
    pick = lambda items, n: F.get(F.array(*[F.lit(x) for x in items]), (F.col("doc_id") % n).cast("int"))
    number = F.when(F.col("doc_id") % 4 == 0, F.lit(" doi 10.1000/abc.12)., ")).otherwise(F.lit(""))
    names = F.array_join(F.slice(F.array(*[F.lit(n) for n in AUTHORS]), (F.col("doc_id") % 3 + 1).cast("int"), (F.col("doc_id") % 4).cast("int")), ", ")
    mark = F.when((F.col("doc_id") % 2 == 1) & (names != ""), F.lit("1")).otherwise(F.lit(""))
    about = F.substring(F.substring_index("text", "\n", 1), 1, 40)
    text = F.concat(F.lit("# A Study of "), about, F.lit("\n\n"), names, mark, F.lit("\n\n"), pick(FRONTS, 5), number, F.lit("\n\n## Abstract\n"), "text", F.lit("\n\nKeywords: proofs, x, long games\n\n## 2 Our Method\nAs [1, 2] and (Gauss, 1800) say $x$.\n\n## References\n[1] One\n[2] Two\n"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.alias("text"))


def paper_facts(spark, sf):
    c = F.col("text")
    return _papers(spark, sf).select("doc_id", P.year(c, YEAR_NOW).alias("year"), venue(c).alias("venue"), P.doi(c).alias("doi"), P.arxiv_id(c).alias("arxiv_id"), F.md5(P.abstract(c).cast("binary")).alias("abstract"), F.array_join(P.keywords(c), "|").alias("keywords"), P.reference_count(c).alias("n_references"), P.citation_count(c).alias("n_citations"))


def paper_structure(spark, sf):
    return P.with_structure(_papers(spark, sf)).select("doc_id", "s.title", F.array_join("s.authors", "|").alias("authors"), F.size("s.sections").alias("n_sections"), F.array_join(F.transform("s.sections", lambda x: x["kind"]), "|").alias("kinds"))


def paper_confidence(spark, sf):
    c = F.col("text")
    facts = P.with_structure(_papers(spark, sf)).withColumn("n_sections", F.size("s.sections")).withColumn("refs", P.reference_count(c))
    dated = P.year(c, YEAR_NOW).isNotNull() & venue(c).isNotNull()
    return facts.select("doc_id", F.round(P.confidence(P.abstract(c).isNotNull(), F.col("n_sections"), F.col("refs"), F.col("s.title").isNotNull(), F.size("s.authors"), P.citation_count(c), dated), 2).alias("confidence"), P.paper_type(P.arxiv_id(c), venue(c), F.col("n_sections"), F.col("refs")).alias("paper_type"))


def paper_citations(spark, sf):
    return _papers(spark, sf).select("doc_id", F.explode(P.citations(F.col("text"))).alias("c")).select("doc_id", "c.*")


PATHS = ["A Model", "1 Introduction", "Our Model", "Baseline Models", "Thanks", "Background", "Data", "Results and Discussion"]


def header_paths(spark, sf):
    """Three headings of every document, the first of which may be its title."""
    part = lambda n: F.get(F.array(*map(F.lit, PATHS)), F.expr(f"int(doc_id div {n} % {len(PATHS)})"))
    path = F.concat_ws(" > ", part(1), part(8), part(64))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", P.header_path_class(path, F.lit("a model!")).alias("section"))


QUERIES = {f.__name__: f for f in (paper_facts, paper_structure, paper_confidence, paper_citations, header_paths)}

_FRONT = "['" + "', '".join(FRONTS) + "'][doc_id % 5 + 1]"
_list = lambda items: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"
_NAMES = f"{_list(AUTHORS)}[doc_id % 3 + 1:doc_id % 3 + doc_id % 4]"
_ABOUT = "substr(split_part(text, chr(10), 1), 1, 40)"
_MD = f"SELECT doc_id, text AS body, '# A Study of ' || {_ABOUT} || e'\\n\\n' || array_to_string({_NAMES}, ', ') || CASE WHEN doc_id % 2 = 1 AND doc_id % 4 > 0 THEN '1' ELSE '' END || e'\\n\\n' || {_FRONT} || CASE WHEN doc_id % 4 = 0 THEN ' doi 10.1000/abc.12)., ' ELSE '' END || e'\\n\\n## Abstract\\n' || text || e'\\n\\nKeywords: proofs, x, long games\\n\\n## 2 Our Method\\nAs [1, 2] and (Gauss, 1800) say $x$.\\n\\n## References\\n[1] One\\n[2] Two\\n' AS md FROM documents"
_ABS = r"trim(regexp_replace(regexp_extract(md, '{}', 1), '\s+', ' ', 'g'), ' ')"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(heading), '{p}') THEN '{n}'" for n, p in HEADINGS.items()) + " ELSE 'other' END"
_VENUES = "CASE " + " ".join(rf"WHEN regexp_matches(lower(substr(md, 1, 2000)), '\b{v.lower()}\b') THEN '{v}'" for v in PAPER_VENUES) + " END"

ORACLES = {
    "paper_facts": rf"""WITH p AS ({_MD}), f AS (SELECT *, split_part(substr(md, 1, 2500), chr(10) || '## Abstract', 1) AS front, substr(md, 1, 2500) AS top FROM p),
y AS (SELECT *, nullif(regexp_extract(md, '{P.ARXIV}', 1), '') AS arxiv_id, nullif(regexp_extract(front, '{P.YEAR_CUE}', 1), '')::INT AS y1, nullif(regexp_extract(front, '{P.YEAR_HEAD}', 1), '')::INT AS y2, nullif(regexp_extract(top, '{P.YEAR_LINE}', 1), '')::INT AS y3, list_transform(regexp_extract_all(front, '{P.YEAR}', 1), lambda x: x::INT) AS ys FROM f),
a AS (SELECT *, {_ABS.format(P.ABSTRACT_HEAD)} AS a1, {_ABS.format(P.ABSTRACT_INLINE)} AS a2 FROM y)
SELECT doc_id, coalesce(CASE WHEN y1 BETWEEN 1970 AND 2027 THEN y1 END, CASE WHEN y2 BETWEEN 1970 AND 2027 THEN y2 END, CASE WHEN y3 BETWEEN 1970 AND 2027 THEN y3 END, 2000 + arxiv_id[1:2]::INT, (SELECT u FROM (SELECT unnest(ys) AS u) GROUP BY u ORDER BY count(*) DESC, u DESC LIMIT 1)) AS year, {_VENUES} AS venue,
nullif(regexp_replace(regexp_extract(md, '{P.DOI}', 1), '[.,;)\]]+$', ''), '') AS doi, arxiv_id, md5(CASE WHEN length(a1) BETWEEN 50 AND 3000 THEN a1 WHEN length(a2) BETWEEN 50 AND 3000 THEN a2 END) AS abstract,
array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(md, '{P.KEYWORDS}', 1), '[,;]'), lambda k: trim(k)), lambda k: length(k) BETWEEN 2 AND 50)[1:10], '|') AS keywords,
len(regexp_extract_all(regexp_extract(md, '{P.REFERENCES}', 1), '(?m)^\[\d+\]'))::INT AS n_references, (len(regexp_extract_all(md, '{P.NUMBERED}')) + len(regexp_extract_all(md, '{P.AUTHOR_YEAR}')))::INT AS n_citations FROM a""",
    "header_paths": f"""WITH n AS (SELECT doc_id, unnest([{', '.join(f"{_list(PATHS)}[doc_id // {k} % {len(PATHS)} + 1]" for k in (1, 8, 64))}]) AS heading, unnest([1, 2, 3]) AS place FROM documents), k AS (SELECT doc_id, place, {_KIND} AS kind FROM n WHERE NOT (place = 1 AND heading = 'A Model'))
SELECT doc_id, coalesce(arg_min(kind, place) FILTER (kind != 'other'), 'other') AS section FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id""",
    "paper_structure": f"""SELECT doc_id, trim(regexp_replace(trim('A Study of ' || {_ABOUT}, ' '), '[*_]+$', ''), ' ') AS title, CASE WHEN doc_id % 4 > 1 OR doc_id % 4 = 1 AND doc_id % 2 = 1 THEN array_to_string({_NAMES}, '|') ELSE '' END AS authors, 4::INT AS n_sections, 'other|abstract|methodology|references' AS kinds FROM documents""",
}
ORACLES["paper_confidence"] = f"""SELECT doc_id, round(least(1, CASE WHEN abstract IS NOT NULL THEN 0.3 ELSE 0 END + 0.2 + 0.1 + CASE WHEN doc_id % 4 > 0 THEN 0.1 ELSE 0 END + CASE WHEN n_citations > 10 THEN 0.1 ELSE 0 END + CASE WHEN year IS NOT NULL AND venue IS NOT NULL THEN 0.05 ELSE 0 END), 2)::DOUBLE AS confidence,
CASE WHEN arxiv_id IS NOT NULL THEN 'arxiv' WHEN regexp_matches(lower(venue), 'neurips|icml|cvpr|acl|aaai') THEN 'conference' WHEN regexp_matches(lower(venue), 'ieee|acm|nature|science') THEN 'journal' ELSE 'unknown' END AS paper_type FROM ({ORACLES['paper_facts']})"""
