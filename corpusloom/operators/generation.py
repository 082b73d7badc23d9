"""Answers around a language model that the caller brings: prompts, clean-up, citations, verification, chat turns.

The model is a function of two columns, prompt and system prompt, that gives the reply; a
null reply stands for a failure.  Everything else is columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.functions import prompts
from corpusloom.functions.text import answer_confidence
from corpusloom.operators import store
from corpusloom.operators.verification import faithfulness, verify_claims

Model = Callable[[Column, Column], Column]
# What is said in place of an answer, and what asks for conflicts.
NO_HITS = "No relevant documents found for your query. Please try rephrasing or broadening your search."
FAILED_RETRIEVAL = ("Retrieval failed: ", ". Unable to find relevant documents.")
FAILED = {"answer": "I was unable to generate an answer due to a technical issue.", "compare": "Unable to generate comparison.", "conflicts": "Unable to detect conflicts."}
CONFLICTS = ("Analyze the following research paper excerpts and identify any conflicting claims, results, or conclusions.\n\n", "\n\nIdentify all conflicts between these papers:")
CONFLICTS_QUERY = "Detect conflicting results across papers"
SYSTEM = {
    "answer": "Answer only from the sources, and cite each by the line that its block gives; cite nothing else. Note where sources disagree.",
    "compare": "Compare the papers: agreements, disagreements and differences of method, with exact numbers and citations.",
    "conflicts": "Name each conflict with both papers' claims, a possible reason and its severity.",
}
UNKNOWN_TITLES = ("", prompts.UNKNOWN)


def model_registry(models: dict[str, Model]) -> Callable[[str], Model]:
    """Models by name; an unknown name is an error, never another model."""

    def choose(name: str) -> Model:
        if name not in models:
            raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(models))}")
        return models[name]

    return choose


def first_sentences(prompt: Column, system: Column) -> Column:
    """A stand-in for a language model: the first sentence of the first source, with its citation."""
    cite = F.regexp_extract(prompt, r"\[Source 1\][^\n]*\nCite this source as: (\([^\n]*\))", 1)
    text = F.regexp_extract(prompt, r"\[Source 1\][^\n]*\n(?:Cite this source as: [^\n]*\n)?([^\n]+)", 1)
    first = F.regexp_extract(text, r"^(.{1,300}?[.!?])(?:\s|$)|^(.{1,300})", 0)
    return F.when(first != "", F.trim(F.concat_ws(" ", F.trim(first), F.when(cite != "", cite))))


def papers_cited(sources: Column) -> Column:
    """Titles in the order they are met, without the unknown one."""
    titles = F.transform(sources, lambda s: F.coalesce(s["paper_title"], F.lit("")))
    return F.filter(F.array_distinct(titles), lambda t: ~t.isin(*UNKNOWN_TITLES))


def gather_sources(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, sources and scores of ranked hits (query_id, chunk_id, score, rank); the few of a question meet in a row."""
    fields = ["paper_title", "authors", "year", "venue", "section_type", "text"]
    told = hits.join(chunks.select("chunk_id", *fields), "chunk_id")
    rows = told.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", F.struct(*fields).alias("s")))).alias("x"))
    return rows.select("query_id", F.transform("x", lambda r: r["s"]).alias("sources"), F.transform("x", lambda r: r["score"]).alias("scores"))


def _papers(sources: Column) -> Column:
    """The first source of each known paper."""
    return F.transform(papers_cited(sources), lambda t: F.get(F.filter(sources, lambda s: s["paper_title"] == t), F.lit(0)))


def references(sources: Column) -> Column:
    """The numbered reference list, one line a paper in the order they are met."""
    return F.array_join(F.transform(_papers(sources), lambda s, i: A.reference_entry(i + 1, s["paper_title"], s["authors"], s["year"], s["venue"], F.lit(None).cast("string"))), "\n")


def bibliography(sources: Column) -> Column:
    """The BibTeX entries of the same papers."""
    return F.array_join(F.transform(_papers(sources), lambda s: A.bibtex_entry(s["authors"], s["year"], s["paper_title"], s["venue"], F.lit(None).cast("string"))), "\n\n")


def generate(found: DataFrame, model: Model, mode: str = "answer") -> DataFrame:
    """Answers to questions (query_id, text, sources, scores, and context if any).

    Unsupported citations go from answers only; conflicts are asked for whatever the
    question, with a confidence of 0.5.  A reply that fails becomes a sentence saying so.
    """
    sources = F.col("sources")
    if mode == "answer":
        ask = prompts.prompt(F.col("text"), prompts.context(sources), F.col("context") if "context" in found.columns else None)
    elif mode == "compare":
        ask = prompts.comparison_prompt(F.col("text"), prompts.context_by_paper(sources))
    elif mode == "conflicts":
        ask = F.concat(F.lit(CONFLICTS[0]), prompts.context_by_paper(sources), F.lit(CONFLICTS[1]))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    said = found.withColumn("raw", F.coalesce(model(ask, F.lit(SYSTEM[mode])), F.lit(FAILED[mode])))
    if mode == "answer":
        said = said.withColumn("stripped", A.strip_citations(F.col("raw"), sources)).withColumn("answer", F.col("stripped.answer")).withColumn("citations_removed", F.col("stripped.removed"))
    else:
        said = said.withColumn("answer", F.col("raw")).withColumn("citations_removed", F.lit(0))
    confidence = F.lit(0.5) if mode == "conflicts" else answer_confidence(F.col("scores"), F.col("answer"))
    cited = papers_cited(sources)
    query = F.lit(CONFLICTS_QUERY) if mode == "conflicts" else F.col("text")
    return said.select("query_id", query.alias("query"), "answer", "citations_removed", "sources", F.size(sources).alias("num_sources"), cited.alias("papers_cited"), confidence.alias("confidence"), A.has_citation(F.col("answer")).alias("has_citations"), (F.lit(True) if mode == "compare" else F.size(cited) > 1).alias("is_multi_paper"), F.lit(mode).alias("mode"))


def respond(queries: DataFrame, hits: DataFrame, chunks: DataFrame, model: Model, mode: str = "answer", verify: bool = True, error: str | None = None) -> DataFrame:
    """The response to every question (query_id, text).

    Without hits, or where retrieval failed with ``error``, a message is the answer.  Its
    claims are checked against its own sources (G6); an answer without claims has no
    faithfulness (G8: a check that can't be made withholds nothing).
    """
    found = queries.join(gather_sources(hits, chunks), "query_id") if error is None else None
    empty = F.lit(error) if error is not None else F.lit(None).cast("string")
    message = F.when(empty.isNotNull(), F.concat(F.lit(FAILED_RETRIEVAL[0]), empty, F.lit(FAILED_RETRIEVAL[1]))).otherwise(F.lit(NO_HITS))
    if found is None:
        return queries.select("query_id", F.col("text").alias("query"), message.alias("answer"), F.lit("failed").alias("mode"))
    told = generate(found, model, mode).withColumn("reference_list", references(F.col("sources"))).withColumn("bibtex", bibliography(F.col("sources")))
    if verify:
        answers = told.select(F.col("query_id").alias("answer_id"), "answer")
        sources = told.select(F.col("query_id").alias("answer_id"), F.posexplode("sources").alias("source_index", "s")).select("answer_id", "source_index", F.col("s.text").alias("text"))
        checked = faithfulness(answers, verify_claims(answers, sources)).withColumnRenamed("answer_id", "query_id")
        told = told.join(checked, "query_id", "left")
    asked = queries.select("query_id", F.col("text").alias("asked"))
    out = asked.join(told, "query_id", "left")
    return out.withColumn("query", F.coalesce("query", "asked")).withColumn("answer", F.coalesce("answer", message)).withColumn("num_sources", F.coalesce("num_sources", F.lit(0))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("has_citations", F.coalesce("has_citations", F.lit(False))).drop("asked")


def chat_turns(messages: DataFrame, questions: DataFrame, window: int = 6) -> DataFrame:
    """C4: the next turn of conversations: conv_id, text, context of the last messages, turn_number (which saturates with the window).

    messages: conv_id, turn, role, text; questions: conv_id, text.
    """
    last = store.history(messages, window).groupBy("conv_id").agg(F.count("*").alias("n"))
    out = questions.join(store.context(messages, window), "conv_id", "left").join(last, "conv_id", "left")
    return out.select("conv_id", "text", "context", (F.floor(F.coalesce("n", F.lit(0)) / 2) + 1).cast("int").alias("turn_number"))


def chat_messages(messages: DataFrame, turns: DataFrame, answers: DataFrame) -> DataFrame:
    """The messages that turns add: the question, then the answer, after the conversation's last one."""
    at = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    both = turns.join(answers, "conv_id").join(at, "conv_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    said = F.array(F.struct(F.lit(1).alias("k"), F.lit("user").alias("role"), F.col("text").alias("said")), F.struct(F.lit(2).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("said")))
    return both.select("conv_id", "last", F.explode(said).alias("m")).select("conv_id", (F.col("last") + F.col("m.k")).alias("turn"), "m.role", F.col("m.said").alias("text"))


def conversation_list(messages: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` conversations that changed last: conv_id, messages, last turn, first question."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    listed = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.substring(first, 1, 80).alias("title"))
    return listed.orderBy(F.desc("last_turn"), "conv_id").limit(k)
