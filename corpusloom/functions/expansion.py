"""Other wordings of a question, and what a language model's replies on it say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms of research papers and what stands for them; the first two are used.
ACADEMIC_TERMS = {
    "transformer": ["transformer", "attention mechanism", "self-attention", "multi-head attention"],
    "bert": ["BERT", "bidirectional encoder", "masked language model"],
    "gpt": ["GPT", "generative pre-trained transformer", "autoregressive model"],
    "cnn": ["CNN", "convolutional neural network", "convolution"],
    "rnn": ["RNN", "recurrent neural network", "LSTM", "GRU"],
    "accuracy": ["accuracy", "F1 score", "precision", "recall", "performance metric"],
    "loss": ["loss function", "objective function", "cost function"],
    "perplexity": ["perplexity", "language model evaluation", "PPL"],
    "training": ["training", "fine-tuning", "optimization", "learning"],
    "learning rate": ["learning rate", "LR", "step size", "optimizer"],
    "batch size": ["batch size", "mini-batch", "training batch"],
    "classification": ["classification", "categorization", "prediction"],
    "generation": ["generation", "text generation", "synthesis"],
    "translation": ["translation", "machine translation", "MT"],
    "model": ["model", "network", "architecture", "system"],
    "dataset": ["dataset", "corpus", "benchmark"],
    "baseline": ["baseline", "comparison method", "reference model"],
}
# What a reply's lines begin with, and what is taken where one is missing.
INTENT, CONFIDENCE, STRATEGY = ("Intent:", "conversational"), ("Confidence:", 0.5), ("Strategy:", "hybrid")


def academic_expansion(c: Column, most: int = 4) -> Column:
    """The question and its wordings with related terms, in the order of the terms; at most ``most``."""
    low, wordings = F.lower(c), [c]
    for term, related in ACADEMIC_TERMS.items():
        for new in related[:2]:
            changed = F.replace(low, F.lit(term), F.lit(new))
            wordings.append(F.when(changed != low, changed))
    return F.slice(F.array_distinct(F.array_compact(F.array(*wordings))), 1, most)


def _quotes(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\"']+|[\"']+$", "")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rewritten(reply: Column, query: Column) -> Column:
    """A model's rewording without quotes; a blank reply leaves the question as it is."""
    bare = _quotes(_trimmed(reply))
    return F.coalesce(F.when(bare != "", bare), query)


def variations(reply: Column, query: Column, most: int = 2) -> Column:
    """The lines of a reply without numbering and quotes, but for the question itself."""
    lines = F.transform(F.split(_trimmed(reply), "\n"), lambda x: _quotes(F.regexp_replace(_trimmed(x), r"^[\d\-*).]+\s*", "")))
    return F.slice(F.filter(lines, lambda x: (x != "") & (x != query)), 1, most)


def _told(reply: Column, label: str) -> Column:
    """What follows a label in the last line that begins with it."""
    lines = F.filter(F.split(_trimmed(reply), "\n"), lambda x: x.startswith(label))
    return _trimmed(F.substring(F.get(lines, F.size(lines) - 1), len(label) + 1, 1 << 30))


def intent(reply: Column) -> Column:
    """Struct of intent, confidence and strategy; what is missing or no number takes its default."""
    number = _told(reply, CONFIDENCE[0])
    return F.struct(
        F.coalesce(F.lower(_told(reply, INTENT[0])), F.lit(INTENT[1])).alias("intent"),
        F.coalesce(number.try_cast("double"), F.lit(CONFIDENCE[1])).alias("confidence"),
        F.coalesce(_told(reply, STRATEGY[0]), F.lit(STRATEGY[1])).alias("strategy"),
    )
