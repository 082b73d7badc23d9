"""Registered text, answer, conversation and store queries, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunking, store
from corpusloom.operators.evaluation import latency_summary as summary
from corpusloom.operators.evaluation import multiset_f1
from corpusloom.sources.files import document_id

_t = lambda spark, sf, name: spark.read.parquet(f"{sf}/{name}.parquet")


def tokenize_terms(spark, sf):
    terms = X.tokens(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.size(terms).alias("n_tokens"), F.size(F.array_distinct(terms)).alias("n_terms"))


def clean_unicode(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(X.clean_unicode(F.col("text")).cast("binary")).alias("cleaned"))


def clean_whitespace(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(X.clean_whitespace(F.col("text")).cast("binary")).alias("cleaned"))


def collapse_newlines(spark, sf):
    doubled = F.regexp_replace("text", r"\. ", ".\n\n\n\n")
    return _t(spark, sf, "documents").select("doc_id", F.length(doubled).alias("before"), F.length(X.collapse_newlines(doubled)).alias("after"))


def page_artifacts(spark, sf):
    """Lines of 6 to 99 characters that a document repeats five times or more."""
    lines = _t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    return lines.filter((F.length("line") > 5) & (F.length("line") < 100)).groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter("n >= 5")


def source_windows(spark, sf):
    """X31 over lines as sentences."""
    return _t(spark, sf, "documents").select("doc_id", F.size(X.source_windows(F.split("text", "\n"))).alias("n_windows"), F.length(F.element_at(X.source_windows(F.split("text", "\n")), -1)).alias("last_length"))


def sentence_counts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"))


ASKED = ["How did they train the model?", "What accuracy did it achieve?", "Why does this fail in 2021?", "What is attention?", "future work and takeaway", "papers by Jane Doe at ICML from 2019 to 2022", "recent papers on parsing", "an arXiv preprint of 2020", "a journal article in Nature", "the new metric", "conference paper by Li", ""]


def _questions(spark, sf):
    """Every turn after one of a dozen questions."""
    asked = F.get(F.array(*map(F.lit, ASKED)), (F.col("turn") % len(ASKED)).cast("int"))
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.concat(asked, F.lit(" "), F.substring("text", 1, 40)).alias("question"))


def section_intent(spark, sf):
    return _questions(spark, sf).select("conv_id", "turn", X.section_intent(F.col("question")).alias("intent"))


def academic_filters(spark, sf):
    return _questions(spark, sf).select("conv_id", "turn", X.academic_filters(F.col("question"), 2026).alias("f")).select("conv_id", "turn", "f.*")


def query_expansion(spark, sf):
    return _questions(spark, sf).select("conv_id", "turn", F.array_join(X.basic_expansion(F.col("question")), "|").alias("expanded"))


NAMES = ["1 Introduction", "Our Model", "Experimental setup", "Results", "References", "Data collection", "Prior work", "Thanks", "Conclusions", "Appendix A"]


def heading_classes(spark, sf):
    """X21 on the first word of every document, after one of ten headings."""
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES)).cast("int"))
    heading = F.concat(F.substring_index("text", " ", 1), F.lit(" "), name)
    return _t(spark, sf, "documents").select("doc_id", X.heading_class(heading).alias("section"))


def _pairs(spark, sf):
    """A user's message and the answer that follows it."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    turns = _t(spark, sf, "conversations").withColumn("before", F.lag("text").over(by))
    return turns.filter("before is not null").select("conv_id", "turn", F.col("text").alias("answer"), F.col("before").alias("gold"))


def token_overlap_f1(spark, sf):
    word = lambda c: F.filter(F.split(F.lower(c), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    return _pairs(spark, sf).select("conv_id", "turn", F.round(X.set_f1(word(F.col("answer")), word(F.col("gold"))), 6).alias("f1"))


def squad_token_f1(spark, sf):
    word = lambda c: F.filter(F.split(X.squad_normal(F.col(c)), " "), lambda w: w != "")
    return multiset_f1(_pairs(spark, sf), ["conv_id", "turn"], f1=(word("answer"), word("gold"))).withColumn("f1", F.round("f1", 6))


def conversation_last6(spark, sf):
    return store.history(_t(spark, sf, "conversations")).select("conv_id", "turn", "role", F.length("text").alias("size"))


def conversation_context(spark, sf):
    return store.context(_t(spark, sf, "conversations"))


def query_stats(spark, sf):
    log = _t(spark, sf, "events").select((F.col("value") / 10).alias("seconds"), (F.col("value") - 20).alias("confidence"), (F.col("event_id") % 7).alias("results"))
    return store.query_stats(log)


def latency_summary(spark, sf):
    return summary(_t(spark, sf, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


def store_stats(spark, sf):
    docs = _t(spark, sf, "documents")
    return docs.agg(F.countDistinct("source").alias("documents"), F.count("*").alias("chunks"), F.round(F.count("*") / F.greatest(F.countDistinct("source"), F.lit(1)), 1).alias("avg_chunks"), F.round(F.avg("n_chars"), 1).alias("avg_chars"))


def document_stats(spark, sf):
    return _t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.round(F.avg("n_chars"), 1).alias("avg_chars"), F.count_if(F.col("text").contains("|")).alias("with_tables"), F.count_if(F.col("text").contains("```")).alias("with_code"))


def _votes(spark, sf):
    events = _t(spark, sf, "events")
    return events.select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("user_id"), F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("The  Claim ")).otherwise(F.lit("the claim ")), (F.col("event_id") % 9).cast("string")).alias("claim"), F.when(F.col("event_id") % 3 == 0, "wrong").otherwise("correct").alias("verdict"), (F.col("event_id") % 5 < 2).alias("flagged"), F.col("ts").alias("created_at"), F.col("event_id").alias("vote_id"))


def feedback_latest_vote(spark, sf):
    return store.latest_votes(_votes(spark, sf))


def feedback_summary(spark, sf):
    s = store.feedback_summary(store.latest_votes(_votes(spark, sf)))
    return s.withColumn("flag_precision", F.round("flag_precision", 6))


def dedupe_latest(spark, sf):
    return store.latest(_t(spark, sf, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


def orphan_check(spark, sf):
    return store.orphans(_t(spark, sf, "documents").select("doc_id", "lang"), _t(spark, sf, "labels"), "doc_id")


def document_ids(spark, sf):
    return _t(spark, sf, "pages").select("page_id", document_id(F.col("url")).alias("document_id"))


def citation_authors(spark, sf):
    names = F.slice(F.split("props_names", ","), 1, (F.col("item_id") % 4).cast("int"))
    rows = _t(spark, sf, "benchmark").select("item_id", F.lit("Ada B. Lovelace,Alan Turing,Grace Hopper").alias("props_names"))
    return rows.select("item_id", X.citation_author(names).alias("short"), X.citation_author(names, True).alias("long"))


def answer_confidence(spark, sf):
    """X40 on each user's four first events; only four an exchange are kept."""
    first = _t(spark, sf, "events").select("user_id", "event_id").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter("n <= 4")
    scored = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("event_id")), lambda i: (i % 11 - 3) / F.lit(4.0)).alias("scores"))
    return scored.select("user_id", F.round(X.answer_confidence(F.col("scores"), F.repeat(F.lit("x"), (F.col("user_id") % 700).cast("int"))), 6).alias("confidence"))


def chunk_documents(spark, sf):
    """X7-X13 with lines as paragraphs."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.chunk_documents(docs)


def html_pages(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


QUERIES = {f.__name__: f for f in (tokenize_terms, clean_unicode, clean_whitespace, collapse_newlines, page_artifacts, source_windows, sentence_counts, section_intent, academic_filters, query_expansion, heading_classes, token_overlap_f1, squad_token_f1, conversation_last6, conversation_context, query_stats, latency_summary, store_stats, document_stats, feedback_latest_vote, feedback_summary, dedupe_latest, orphan_check, document_ids, citation_authors, answer_confidence, chunk_documents, html_pages)}

_quoted = lambda words: "[" + ", ".join("'{}'".format(w.replace("'", "''")) for w in words) + "]"
_Q = f"(SELECT conv_id, turn, {_quoted(ASKED)}[turn % {len(ASKED)} + 1] || ' ' || substr(text, 1, 40) AS question FROM conversations)"
_H = f"(SELECT doc_id, split_part(text, ' ', 1) || ' ' || {_quoted(NAMES)}[doc_id % {len(NAMES)} + 1] AS heading FROM documents)"
_INTENT = "CASE " + " ".join("WHEN regexp_matches(lower(question), '{}') THEN '{}'".format("|".join(f"(?:{p})" for p in ps), n) for n, ps in X.SECTION_INTENTS.items()) + " END"
_HEAD = "CASE " + " ".join(f"WHEN regexp_matches(lower(heading), '{p}') THEN '{n}'" for n, p in X.HEADINGS.items()) + " ELSE 'other' END"
_VENUE = "CASE " + " ".join(rf"WHEN regexp_matches(lower(question), '\b{v.lower()}\b') THEN '{v}'" for v in X.QUERY_VENUES) + " END"
_BOTH = r"\b(20\d{2})\s*(?:-|to)\s*(20\d{2})\b"
_PAIR = "SELECT * FROM (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations) WHERE gold IS NOT NULL"
_VOTES = """v AS (SELECT concat('u', user_id % 20) AS user_id, concat(CASE WHEN event_id % 2 = 0 THEN 'The  Claim ' ELSE 'the claim ' END, event_id % 9) AS claim, CASE WHEN event_id % 3 = 0 THEN 'wrong' ELSE 'correct' END AS verdict, event_id % 5 < 2 AS flagged, ts, event_id FROM events),
h AS (SELECT *, sha256(trim(regexp_replace(lower(claim), '\\s+', ' ', 'g'))) AS claim_hash FROM v),
l AS (SELECT user_id, claim_hash, first(claim ORDER BY ts, event_id) AS claim, last(verdict ORDER BY ts, event_id) AS verdict, last(flagged ORDER BY ts, event_id) AS flagged FROM h GROUP BY ALL)""".replace("\\\\s", "\\s")
_LINE = "rtrim(concat(repeat(' ', least(4, length(x) - length(ltrim(x, ' ')))::INT), regexp_replace(trim(x, ' '), ' +', ' ', 'g')), ' ')"
_BARE = r"""regexp_replace(lower(TEXT), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g')"""
_ARTICLE = r"""regexp_replace(TEXT, '(^|[^\p{L}\p{N}])(a|an|the)($|[^\p{L}\p{N}])', '\1 \3', 'g')"""


def _normal(column: str) -> str:
    """Articles go twice, since two in a row share the space between them."""
    twice = _ARTICLE.replace("TEXT", _ARTICLE).replace("TEXT", _BARE.replace("TEXT", column))
    return f"trim(regexp_replace({twice}, '\\s+', ' ', 'g'), ' ')"


_MULTI = "(SELECT sum(least(len(list_filter(a, lambda y: y = t)), len(list_filter(g, lambda y: y = t)))) FROM (SELECT unnest(list_distinct(a)) AS t))"
_AUTHOR = "CASE item_id % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN '{}' WHEN 2 THEN '{}' ELSE 'Lovelace et al.' END"

ORACLES = {
    "tokenize_terms": r"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)",
    "clean_unicode": "SELECT doc_id, md5(translate(replace(replace(text, '…', '...'), chr(8203), ''), '“”‘’–—' || chr(160) || '•·', '\"\"''''-- --')) AS cleaned FROM documents",
    "clean_whitespace": f"SELECT doc_id, md5(array_to_string(list_transform(string_split(replace(text, chr(9), ' '), chr(10)), lambda x: {_LINE}), chr(10))) AS cleaned FROM documents",
    "collapse_newlines": r"SELECT doc_id, length(d)::INT AS before, length(regexp_replace(d, '\n{3,}', chr(10) || chr(10), 'g'))::INT AS after FROM (SELECT doc_id, replace(text, '. ', '.' || repeat(chr(10), 4)) AS d FROM documents)",
    "page_artifacts": "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE length(line) BETWEEN 6 AND 99 GROUP BY ALL HAVING count(*) >= 5",
    "source_windows": "SELECT doc_id, (CASE WHEN n <= 4 THEN 1 ELSE ceil((n - 4) / 2.0)::INT + 1 END)::INT AS n_windows, length(array_to_string(CASE WHEN n <= 4 THEN p ELSE list_slice(p, ceil((n - 4) / 2.0)::INT * 2 + 1, n) END, ' '))::INT AS last_length FROM (SELECT doc_id, string_split(text, chr(10)) AS p, len(string_split(text, chr(10))) AS n FROM documents)",
    "section_intent": f"SELECT conv_id, turn, {_INTENT} AS intent FROM {_Q}",
    "academic_filters": rf"""SELECT conv_id, turn, coalesce(a, CASE WHEN s IS NULL AND regexp_matches(lower(question), '{X.RECENT}') THEN 2024 END) AS year_min, b AS year_max, s AS year_eq, nullif(regexp_extract(question, '\bby\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)', 1), '') AS author, {_VENUE} AS venue,
CASE WHEN regexp_matches(lower(question), '\barxiv\b') THEN 'arxiv' WHEN regexp_matches(lower(question), '\b(conference|workshop) paper') THEN 'conference' WHEN regexp_matches(lower(question), '\bjournal (paper|article)') THEN 'journal' END AS paper_type
FROM (SELECT *, CASE WHEN a IS NULL THEN nullif(regexp_extract(question, '\b(20\d{{2}})\b', 1), '')::INT END AS s FROM (SELECT *, nullif(regexp_extract(question, '{_BOTH}', 1), '')::INT AS a, nullif(regexp_extract(question, '{_BOTH}', 2), '')::INT AS b FROM {_Q}))""",
    "query_expansion": f"SELECT conv_id, turn, concat_ws('|', CASE WHEN NOT ends_with(question, '?') THEN 'What is ' || question || '?' END, CASE WHEN NOT regexp_matches(lower(question), '^(what|how|why|explain)') THEN 'Explain ' || question END) AS expanded FROM {_Q}",
    "heading_classes": f"SELECT doc_id, {_HEAD} AS section FROM {_H}",
    "token_overlap_f1": rf"SELECT conv_id, turn, round(CASE WHEN c > 0 THEN 2.0 * c / (len(a) + len(g)) ELSE 0 END, 6) AS f1 FROM (SELECT *, len(list_intersect(a, g)) AS c FROM (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(answer), '[ \t\n\r\f\x0B]+'), lambda w: w != '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(gold), '[ \t\n\r\f\x0B]+'), lambda w: w != '')) AS g FROM ({_PAIR})))",
    "squad_token_f1": f"SELECT conv_id, turn, round(CASE WHEN coalesce(c, 0) > 0 THEN 2.0 * c / (len(a) + len(g)) ELSE 0 END, 6) AS f1 FROM (SELECT *, {_MULTI} AS c FROM (SELECT conv_id, turn, list_filter(string_split({_normal('answer')}, ' '), lambda w: w != '') AS a, list_filter(string_split({_normal('gold')}, ' '), lambda w: w != '') AS g FROM ({_PAIR})))",
    "conversation_last6": "SELECT conv_id, turn, role, length(text)::INT AS size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6",
    "conversation_context": "SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS context FROM (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn) AS size FROM (SELECT conv_id, turn, upper(role[1]) || lower(role[2:]) || ': ' || CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS line FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6)) WHERE size <= 4000 GROUP BY conv_id",
    "query_stats": "SELECT count(*) AS total, round(avg(value / 10), 3) AS avg_seconds, round(avg(value - 20) FILTER (value - 20 > 0), 3) AS avg_confidence, round(avg(event_id % 7), 1) AS avg_results FROM events",
    "latency_summary": "SELECT event_type, round(avg(value), 6) AS mean, list_sort(list(value))[(count(value) // 2 + 1)::INT] AS median FROM events GROUP BY event_type",
    "store_stats": "SELECT count(DISTINCT source) AS documents, count(*) AS chunks, round(count(*) / greatest(count(DISTINCT source), 1), 1) AS avg_chunks, round(avg(n_chars), 1) AS avg_chars FROM documents",
    "document_stats": "SELECT source, count(*) AS chunks, round(avg(n_chars), 1) AS avg_chars, count(*) FILTER (contains(text, '|')) AS with_tables, count(*) FILTER (contains(text, '```')) AS with_code FROM documents GROUP BY source",
    "feedback_latest_vote": f"WITH {_VOTES} SELECT * FROM l",
    "feedback_summary": f"WITH {_VOTES}, c AS (SELECT count(*) AS total, count(*) FILTER (flagged AND verdict = 'correct') AS flag_right, count(*) FILTER (flagged AND verdict != 'correct') AS flag_wrong, count(*) FILTER (NOT flagged AND verdict = 'correct') AS pass_right, count(*) FILTER (NOT flagged AND verdict != 'correct') AS pass_wrong FROM l) SELECT *, round(flag_right / nullif(flag_right + flag_wrong, 0), 6) AS flag_precision FROM c",
    "dedupe_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "orphan_check": "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)",
    "document_ids": "SELECT page_id, 'doc_' || md5(url || '_' || string_split(url, '/')[-1])[1:8] AS document_id FROM pages",
    "citation_authors": f"SELECT item_id, {_AUTHOR.format('Lovelace', 'Lovelace & Turing')} AS short, {_AUTHOR.format('Ada B. Lovelace', 'Ada B. Lovelace & Alan Turing')} AS long FROM benchmark",
    "answer_confidence": "SELECT user_id, round(CASE WHEN user_id % 700 = 0 THEN 0 ELSE greatest(0, least(1, 0.5 * list_avg(list_transform(s, lambda x: CASE WHEN x >= 0 AND x <= 1 THEN x ELSE 1 / (1 + exp(-x)) END)) + 0.3 * least(len(s) / 3.0, 1) + 0.2 * CASE WHEN user_id % 700 < 50 THEN 0.3 WHEN user_id % 700 < 200 THEN 0.7 ELSE 1.0 END)) END, 6) AS confidence FROM (SELECT user_id, list_slice(list_transform(list_sort(list(event_id)), lambda i: (i % 11 - 3) / 4.0), 1, 4) AS s FROM events GROUP BY user_id)",
    "html_pages": r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM pages",
    "sentence_counts": r"SELECT doc_id, len(string_split(regexp_replace(trim(text, ' '), '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)))::INT AS n_sentences FROM documents",
}
