"""Registered queries on answers, claims and citations, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.operators import verification
from corpusloom.operators.benchmark import faithfulness_summary as faithful_answers
from corpusloom.operators.evaluation import multiset_f1
from corpusloom.plans.content import _MULTI, _PAIR, _pairs
from corpusloom.streaming import limiter

_t = lambda spark, sf, name: spark.read.parquet(f"{sf}/{name}.parquet")


def claim_extraction(spark, sf):
    found = A.claims(F.col("text"))
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.size(found).alias("n_claims"), F.md5(F.array_join(found, "|").cast("binary")).alias("claims"))


def content_words(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.size(A.content_words(F.col("text"))).alias("n_words"))


def _answers(spark, sf):
    return _pairs(spark, sf).withColumn("answer_id", F.concat_ws("-", "conv_id", "turn"))


def _verdicts(spark, sf):
    return verification.verify_claims(_answers(spark, sf), _answers(spark, sf).select("answer_id", F.lit(0).alias("source_index"), F.col("gold").alias("text")))


def claim_verification(spark, sf):
    return _verdicts(spark, sf).withColumn("entailment", F.round("entailment", 6))


def answer_faithfulness(spark, sf):
    return verification.faithfulness(_answers(spark, sf), _verdicts(spark, sf)).withColumn("faithfulness", F.round("faithfulness", 6))


def _papers(spark, sf):
    names = F.slice(F.array(*[F.lit(n) for n in ("Ada B. Lovelace", "Alan Turing", "Grace Hopper", "Plato", "Emmy Noether")]), F.lit(1), (F.col("item_id") % 6).cast("int"))
    year = F.when(F.col("item_id") % 3 > 0, 2000 + F.col("item_id") % 20)
    venue = F.when(F.col("item_id") % 2 == 0, F.lit("ACL"))
    return _t(spark, sf, "benchmark").select("item_id", names.alias("authors"), year.alias("year"), venue.alias("venue"), F.lit("The Art, of Proof").alias("title"))


def citation_strings(spark, sf):
    a, y, t, v = (F.col(c) for c in ("authors", "year", "title", "venue"))
    return _papers(spark, sf).select("item_id", A.inline_citation(a, y, F.lit("results"), F.lit(9)).alias("inline"), A.reference_entry(F.col("item_id"), t, a, y, v, F.lit("10.1/x")).alias("reference"), A.bibtex_entry(a, y, t, v, F.lit(None).cast("string")).alias("bibtex"))


def unsupported_citations(spark, sf):
    sources = F.array(F.struct("authors", "year"))
    answer = F.concat(F.lit("According to Turing ("), F.coalesce("year", F.lit(1999)), F.lit("), machines think (Lovelace et al., 2001). it holds (a fact) , as Noether and Hilbert (1918) say."))
    return _papers(spark, sf).select("item_id", A.strip_citations(answer, sources).alias("s")).select("item_id", "s.*")


def citation_accuracy(spark, sf):
    answer = F.lit("Proved (Turing, 1936) and (Lovelace & Byron, 1843), then (Hopper et al., 1952); not (Gauss, 1800).")
    scored = _papers(spark, sf).select("item_id", A.citation_scores(answer, F.col("authors")).alias("s"))
    return scored.select("item_id", *[F.round(F.col(f"s.{c}"), 6).alias(c) for c in ("precision", "recall", "f1")])


def answer_completeness(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", F.round(A.completeness(F.col("answer"), F.col("gold")), 6).alias("completeness"))


def paragraph_f1(spark, sf):
    lines = lambda c: F.split(F.col(c), r"\. ")
    return _pairs(spark, sf).select("conv_id", "turn", F.round(A.paragraph_f1(lines("answer"), lines("gold")), 6).alias("f1"))


def cleaned_replies(spark, sf):
    raw = F.concat(F.when(F.col("turn") % 2 == 0, "<think>why\nnot</think> \"Final Answer: ").otherwise("answer:"), "text", F.lit('"'))
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.md5(A.clean_answer(raw).cast("binary")).alias("answer"))


def rouge_ngrams(spark, sf):
    a, g = A.rouge_tokens(F.col("answer")), A.rouge_tokens(F.col("gold"))
    pairs = _pairs(spark, sf).select("conv_id", "turn", a.alias("a"), g.alias("g"))
    scored = multiset_f1(pairs, ["conv_id", "turn"], rouge1=(F.col("a"), F.col("g")), rouge2=(A.ngrams(F.col("a"), 2), A.ngrams(F.col("g"), 2)))
    return scored.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("rouge1", "rouge2")])


def rouge_l(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", F.round(A.rouge_l(A.rouge_tokens(F.col("answer")), A.rouge_tokens(F.col("gold"))), 6).alias("rougeL"))


def evidence_coverage(spark, sf):
    pairs = _pairs(spark, sf)
    return pairs.select("conv_id", "turn", A.coverage(A.rouge_tokens(F.col("gold")), A.rouge_tokens(F.col("answer"))).alias("c")).select("conv_id", "turn", "c.*")


def rate_limited(spark, sf):
    """W1 with a day and two requests, since the events are days apart; times go to the nearest second, halves to the even one."""
    seconds = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    asked = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), seconds.alias("ts"))
    return limiter.rate_limit(asked, limit=2, length=86_400).groupBy("key").agg(F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"))


def faithfulness_summary(spark, sf):
    """A13 over all answers."""
    return faithful_answers(verification.faithfulness(_answers(spark, sf), _verdicts(spark, sf)))


QUERIES = {f.__name__: f for f in (faithfulness_summary, claim_extraction, content_words, claim_verification, answer_faithfulness, citation_strings, unsupported_citations, citation_accuracy, answer_completeness, paragraph_f1, cleaned_replies, rouge_ngrams, rouge_l, evidence_coverage, rate_limited)}

_q = lambda pattern: pattern.replace("'", "''")
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SPLIT = r"""list_filter(list_transform(flatten(list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '(?i)\b(et al|e\.g|i\.e|cf|vs|Fig|Figs|Eq|Eqs|Sec|Tab|approx|resp|etc)\.', '\1' || chr(57344), 'g'), '\r\n|[\n\r\x0b\x0c]'), lambda l: trim(l, ' ' || chr(9))), lambda l: l != ''), lambda l: string_split(regexp_replace(l, '([.!?])\s+(["''(\[A-Z0-9*-])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda s: trim(replace(s, chr(57344), '.'), ' ')), lambda s: s != '')"""
_RT = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_BIGRAM = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
_NAMES = _list(["Ada B. Lovelace", "Alan Turing", "Grace Hopper", "Plato", "Emmy Noether"])
_PAPER = f"SELECT item_id, {_NAMES}[1:(item_id % 6)::INT] AS a, CASE WHEN item_id % 3 > 0 THEN 2000 + item_id % 20 END AS y, CASE WHEN item_id % 2 = 0 THEN 'ACL' END AS v FROM benchmark"

ORACLES = {
    "claim_extraction": f"""WITH l AS (SELECT conv_id, turn, list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c]'), lambda x: {_STRIP.format('x')}) AS a FROM conversations),
s AS (SELECT *, list_position(list_transform(a, lambda x: regexp_matches(x, '{A.SOURCES}')), true) AS stop FROM l),
b AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(CASE WHEN stop > 0 THEN a[1:stop - 1] ELSE a END, lambda x: NOT starts_with(x, '#')), lambda x: regexp_replace(x, '{A.MARKDOWN}', '')), lambda x: NOT regexp_matches(x, '{A.BOLD_LINE}')) AS a FROM s),
p AS (SELECT conv_id, turn, flatten(list_transform(a, lambda x: {_SPLIT.format(f"regexp_replace(x, '{A.BOLD_LABEL}', '')")})) AS a FROM b),
c AS (SELECT conv_id, turn, list_filter(list_transform(a, lambda x: {_STRIP.format(f"replace(regexp_replace(regexp_replace(x, '{A.MARKDOWN}', ''), '{A.MARKER}', '', 'g'), '**', '')")}), lambda x: NOT ends_with(x, ':') AND len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w != '')) >= 4) AS a FROM p)
SELECT conv_id, turn, len(a)::INT AS n_claims, md5(array_to_string(a, '|')) AS claims FROM c""",
    "content_words": f"SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.\\-]*')), lambda w: NOT list_contains({_list(A.CLAIM_STOP)}, w)))::INT AS n_words FROM documents",
    "citation_strings": f"""WITH p AS ({_PAPER}), l AS (SELECT *, list_transform(a, lambda x: string_split(x, ' ')[-1]) AS s FROM p)
SELECT item_id, '(' || concat_ws(', ', CASE len(a) WHEN 0 THEN NULL WHEN 1 THEN s[1] WHEN 2 THEN s[1] || ' and ' || s[2] ELSE s[1] || ' et al.' END, coalesce(y::VARCHAR, 'n.d.'), 'Results', 'p.9') || ')' AS inline,
concat_ws(' ', '[' || item_id || ']', CASE WHEN len(a) > 0 THEN array_to_string(list_transform(a[1:3], lambda x: CASE WHEN contains(x, ' ') THEN string_split(x, ' ')[-1] || ', ' || x[1] || '.' ELSE x END), ', ') || CASE WHEN len(a) > 3 THEN ', et al.' ELSE '' END END, '(' || coalesce(y::VARCHAR, 'n.d.') || ').', 'The Art, of Proof.', v || '.', 'DOI: 10.1/x') AS reference,
concat_ws(chr(10), CASE WHEN v IS NULL THEN '@article{{' ELSE '@inproceedings{{' END || coalesce(lower(s[1]), 'unknown') || coalesce(y::VARCHAR, 'nd') || 'art,', '  title={{The Art, of Proof}},', CASE WHEN len(a) > 0 THEN '  author={{' || array_to_string(a, ' and ') || '}},' END, '  year={{' || y || '}},', '  booktitle={{' || v || '}},', '}}') AS bibtex FROM l""",
    "citation_accuracy": f"SELECT item_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT item_id, CASE WHEN n = 0 THEN 0 ELSE least(n, 3) / 4.0::DOUBLE END AS p, CASE WHEN n = 0 THEN 0 ELSE h / n END AS r FROM (SELECT item_id, len(a) AS n, CASE len(a) WHEN 0 THEN 0 ELSE least(len(a), 3) END::DOUBLE AS h FROM ({_PAPER})))",
    "answer_completeness": rf"SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 1 ELSE len(list_filter(q, lambda w: contains(lower(answer), w))) / len(q) END, 6) AS completeness FROM (SELECT *, list_filter(list_distinct(regexp_split_to_array(lower(gold), '\s+')), lambda w: w != '' AND NOT list_contains({_list(A.QUERY_STOP)}, w)) AS q FROM ({_PAIR}))",
    "paragraph_f1": f"SELECT conv_id, turn, round(2.0 * len(list_intersect(a, g)) / (len(a) + len(g)), 6) AS f1 FROM (SELECT conv_id, turn, string_split(answer, '. ') AS a, string_split(gold, '. ') AS g FROM ({_PAIR}))",
    "rouge_ngrams": f"""WITH t AS (SELECT conv_id, turn, {_RT.format('answer')} AS a1, {_RT.format('gold')} AS g1 FROM ({_PAIR})), u AS (SELECT *, {_BIGRAM.format('a1')} AS a2, {_BIGRAM.format('g1')} AS g2 FROM t),
o AS (SELECT conv_id, turn, 1 AS n, a1 AS a, g1 AS g FROM u UNION ALL SELECT conv_id, turn, 2, a2, g2 FROM u), c AS (SELECT *, coalesce({_MULTI}, 0) AS c FROM o)
SELECT conv_id, turn, round(max(CASE WHEN n = 1 THEN f END), 6) AS rouge1, round(max(CASE WHEN n = 2 THEN f END), 6) AS rouge2 FROM (SELECT *, CASE WHEN c > 0 THEN 2.0 * c / (len(a) + len(g)) ELSE 0.0 END AS f FROM c) GROUP BY ALL""",
    "rate_limited": """WITH RECURSIVE e AS (SELECT user_id, epoch(ts)::BIGINT AS ts FROM events), w AS (SELECT user_id, min(ts) AS start FROM e GROUP BY user_id UNION ALL SELECT e.user_id, min(e.ts) FROM w JOIN e ON e.user_id = w.user_id AND e.ts >= w.start + 86400 GROUP BY e.user_id),
n AS (SELECT w.user_id, start, count(*) AS n FROM w JOIN e ON e.user_id = w.user_id AND e.ts >= start AND e.ts < start + 86400 GROUP BY ALL)
SELECT user_id::VARCHAR AS key, sum(n)::BIGINT AS requests, sum(least(n, 2))::BIGINT AS allowed FROM n GROUP BY user_id""",
    "cleaned_replies": r"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_extract(text, '^[^\n\r]*'), '\"+$', ''), ' ')) AS answer FROM conversations",
    "rouge_l": f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {_RT.format('answer')} AS a, {_RT.format('gold')} AS g FROM ({_PAIR})),
w AS (SELECT conv_id, turn, a, g, 0 AS i, list_transform(range(len(g) + 1), lambda x: 0) AS row FROM t
UNION ALL SELECT conv_id, turn, a, g, i + 1, list_reduce(list_transform(range(1, len(g) + 1), lambda j: [CASE WHEN g[j] = a[i + 1] THEN row[j] + 1 ELSE row[j + 1] END]), lambda acc, x: acc || [greatest(x[1], acc[len(acc)])], [0]) FROM w WHERE i < len(a))
SELECT conv_id, turn, round(CASE WHEN len(a) + len(g) > 0 THEN 2.0 * row[len(row)] / (len(a) + len(g)) ELSE 0 END, 6) AS rougeL FROM w WHERE i = len(a)""",
}

_CLAIMS = ORACLES["claim_extraction"].rsplit("\nSELECT", 1)[0].replace("WITH l AS", "l AS").replace("coalesce(text, '')", "coalesce(answer, '')").replace("FROM conversations)", "FROM pairs)")
_CONTENT = f"list_filter(list_distinct(regexp_extract_all(lower({{}}), '[a-z0-9][a-z0-9.\\-]*')), lambda w: NOT list_contains({_list(A.CLAIM_STOP)}, w))"
_VERDICTS = f"""pairs AS ({_PAIR}), {_CLAIMS},
asked AS (SELECT conv_id, turn, unnest(a) AS claim, generate_subscripts(a, 1) - 1 AS claim_no FROM c),
parts AS (SELECT conv_id, turn, {_SPLIT.format('gold')} AS x FROM pairs),
told AS (SELECT conv_id, turn, x, len(x) AS n FROM parts WHERE len(x) > 0),
win AS (SELECT conv_id, turn, unnest(CASE WHEN n <= 4 THEN [array_to_string(x, ' ')] ELSE list_transform(range(0, (ceil((n - 4) / 2.0) * 2 + 1)::INT, 2), lambda i: array_to_string(x[i + 1:i + 4], ' ')) END) AS w, unnest(range(CASE WHEN n <= 4 THEN 1 ELSE ceil((n - 4) / 2.0)::INT + 1 END)) AS window_no FROM told),
cw AS (SELECT *, {_CONTENT.format('claim')} AS cws FROM asked), ww AS (SELECT *, {_CONTENT.format('w')} AS wws FROM win),
near AS (SELECT conv_id, turn, claim_no, w, cws, len(list_intersect(cws, wws)) AS shared, row_number() OVER (PARTITION BY conv_id, turn, claim_no ORDER BY len(list_intersect(cws, wws)) DESC, window_no) AS place FROM cw JOIN ww USING (conv_id, turn)),
e AS (SELECT conv_id, turn, claim_no, w, place, CASE WHEN len(cws) > 0 THEN shared / len(cws) ELSE 0.0 END AS ent FROM near WHERE place <= 4),
best AS (SELECT conv_id, turn, claim_no, max(ent) AS ent, arg_min(w, {{'e': -ent, 'p': place}}) AS evidence FROM e GROUP BY ALL),
v AS (SELECT conv_id, turn, claim_no, claim, ent, evidence FROM asked LEFT JOIN best USING (conv_id, turn, claim_no))"""
ORACLES["claim_verification"] = f"WITH {_VERDICTS} SELECT conv_id || '-' || turn AS answer_id, claim_no::INT AS claim_no, claim, round(coalesce(ent, 0), 6) AS entailment, CASE WHEN evidence IS NOT NULL THEN 0 END::INT AS source_index, evidence, 0.0::DOUBLE AS contradiction, evidence IS NOT NULL AND coalesce(ent, 0) >= 0.5 AS supported FROM v"
ORACLES["answer_faithfulness"] = f"WITH {_VERDICTS}, f AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (evidence IS NULL OR coalesce(ent, 0) < 0.5) AS bad FROM v GROUP BY ALL) SELECT conv_id || '-' || turn AS answer_id, coalesce(n, 0) AS num_claims, coalesce(bad, 0) AS num_unsupported, round(1 - bad / n, 6) AS faithfulness FROM pairs LEFT JOIN f USING (conv_id, turn)"
ORACLES["faithfulness_summary"] = f"WITH {_VERDICTS}, f AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (evidence IS NULL OR coalesce(ent, 0) < 0.5) AS bad FROM v GROUP BY ALL), j AS (SELECT n, bad FROM pairs LEFT JOIN f USING (conv_id, turn)) SELECT count(*) AS answers_checked, count(n) AS answers_with_claims, round(avg(1 - bad / n), 4) AS mean_faithfulness, sum(n)::BIGINT AS claims, sum(n - bad)::BIGINT AS claims_verified, round(sum(n - bad) / sum(n), 4) AS claim_level_faithfulness, count(*) FILTER (bad = 0) AS answers_fully_verified FROM j"
ORACLES["evidence_coverage"] = f"""WITH t AS (SELECT conv_id, turn, {_RT.format('gold')} AS g, {_RT.format('answer')} AS a FROM ({_PAIR})), e AS (SELECT conv_id, turn, unnest(g) AS w, generate_subscripts(g, 1) AS p FROM t), c AS (SELECT conv_id, turn, unnest(a) AS w, generate_subscripts(a, 1) AS p FROM t),
m AS (SELECT e.conv_id, e.turn, e.p, e.p - c.p AS diag FROM e JOIN c ON e.conv_id = c.conv_id AND e.turn = c.turn AND e.w = c.w),
i AS (SELECT conv_id, turn, count(*) AS run FROM (SELECT *, p - row_number() OVER (PARTITION BY conv_id, turn, diag ORDER BY p) AS island FROM m) GROUP BY conv_id, turn, diag, island), r AS (SELECT conv_id, turn, max(run) AS run FROM i GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN len(g) > 0 THEN coalesce(run, 0) / len(g) ELSE 0.0 END AS of_evidence, CASE WHEN len(a) > 0 THEN coalesce(run, 0) / len(a) ELSE 0.0 END AS of_chunk FROM t LEFT JOIN r USING (conv_id, turn)"""
ORACLES["unsupported_citations"] = f"""WITH s AS (SELECT item_id, len(a) >= 2 AND y IS NOT NULL AS turing, len(a) >= 1 AND coalesce(y = 2001, false) AS lovelace, y FROM ({_PAPER}))
SELECT item_id, CASE WHEN turing THEN 'According to Turing (' || y || '), machines' ELSE 'Machines' END || ' think' || CASE WHEN lovelace THEN ' (Lovelace et al., 2001)' ELSE '' END || '. It holds (a fact), as say.' AS answer, (1 + CASE WHEN turing THEN 0 ELSE 1 END + CASE WHEN lovelace THEN 0 ELSE 1 END)::INT AS removed FROM s"""
