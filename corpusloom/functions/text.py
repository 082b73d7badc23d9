"""Column functions on text: tokens, cleaning, classification of queries and headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section intents with their patterns; the first family that matches wins.
SECTION_INTENTS = {
    "methodology": [r"\bhow (did|do) (they|we|you|the authors)?\s*(implement|train|build|design|develop)", r"\b(methodology|method|approach|technique|algorithm)\b", r"\bwhat (algorithm|model|architecture|framework)\b", r"\b(implementation|experimental setup|training process)\b"],
    "results": [r"\b(accuracy|precision|recall|f1|performance|score|metric)\b", r"\b(achieve|report|obtain|show|demonstrate|outperform)\b.*\b(result)", r"\bwhat (accuracy|performance|results?)\b", r"\b(benchmark|evaluation|comparison)\b"],
    "discussion": [r"\bwhy (does|is|did)\b", r"\b(advantage|disadvantage|limitation|benefit|drawback)\b", r"\b(analysis|discussion|interpretation|insight)\b", r"\b(compare|comparison|versus|vs\.?)\b"],
    "abstract": [r"\bwhat is\b", r"\bdefin(e|ition)\b", r"\bintroduc(e|tion)\b", r"\boverview\b", r"\b(summary|abstract|background)\b"],
    "conclusion": [r"\b(conclusion|future work|summary|takeaway)\b", r"\bwhat (next|are the implications)\b"],
}
# Venues in the order in which they are tried.
QUERY_VENUES = ["NeurIPS", "ICML", "ICLR", "CVPR", "ICCV", "ECCV", "ACL", "EMNLP", "NAACL", "AAAI", "IJCAI", "KDD", "WWW", "SIGIR", "ICSE", "FSE", "IEEE", "ACM", "Nature", "Science", "arXiv"]
PAPER_VENUES = ["NeurIPS", "ICML", "ICLR", "CVPR", "ICCV", "ECCV", "ACL", "EMNLP", "NAACL", "AAAI", "IJCAI", "KDD", "WWW", "SIGIR", "ICSE", "FSE", "IEEE", "ACM", "Springer", "Nature", "Science", "arXiv"]
RECENT = r"\b(recent|latest|new|newest)\b\s+(?:\w+\s+){0,2}(papers?|work|works|research|studies|study|publications?|articles?|literature)\b"
# Heading classes with their patterns; the first that matches wins.
HEADINGS = {
    "references": r"\b(references|bibliograph(y|ies)|works cited)\b",
    "acknowledgements": r"\backnowledge?ments?\b",
    "appendix": r"\b(appendix|appendices|supplementary)\b",
    "abstract": r"\babstract\b",
    "related_work": r"\b(related work|literature review|prior work|previous work|related literature|state of the art)\b",
    "conclusion": r"\b(conclusions?|concluding remarks|future work|future directions|limitations?|takeaways?|summary)\b",
    "results": r"\b(results?|findings|error analysis|main finding)\b",
    "experiments": r"\b(experiments?|experimental|evaluation|validation|(experimental |training |implementation )?(setup|settings?|details)|ablations?|baselines?|hyper-?parameters?|(evaluation |training )?(metrics?|protocol|procedure)|case stud(y|ies)|user study|human evaluation)\b",
    "dataset": r"\b(datasets?|data set|corpus|corpora|data collection|data description|data preparation|annotation(s| scheme| process)?|data)\b",
    "methodology": r"\b(method(s|ology|ologies)?|approach(es)?|model(s|ling|ing)?|architectures?|systems?|algorithms?|frameworks?|networks?|formulation|preliminaries|notation|(task|problem) (definition|statement|formulation)|our (model|method|approach|system))\b",
    "discussion": r"\b(discussion|analysis|interpretation|qualitative)\b",
    "introduction": r"\b(introduction|motivation|overview|background)\b",
}
#: Characters and what replaces them.
CURLY, PLAIN = "“”‘’–—\u00a0•·", "\"\"''-- --"
ELLIPSIS, NO_SPACE = "…", "\u200b"
#: White space of every script and the separators 28 to 31.
SPACE = r"[\s\x1c-\x1f]"


def tokens(c: Column) -> Column:
    """Runs of word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1))


def clean_unicode(c: Column) -> Column:
    """X2 without canonical composition."""
    return F.translate(F.replace(F.replace(c, F.lit(ELLIPSIS), F.lit("...")), F.lit(NO_SPACE), F.lit("")), CURLY, PLAIN)


def clean_whitespace(c: Column) -> Column:
    """Tabs to spaces; each line loses its end and runs of spaces, and keeps four leading spaces at most.

    One pass over the whole text for each rule: line ends, white space that leads a line,
    runs within it.
    """
    other = r"[\s\x1c-\x1f&&[^\n]]"
    text = F.regexp_replace(F.translate(c, "\t", " "), rf"(?U)(?<!{other}){other}++(?=\n|\z)", "")
    # What leads a line becomes as many spaces; those over four go.
    text = F.regexp_replace(text, rf"(?U)(?<=\n|\A|\G){other}", " ")
    return F.regexp_replace(F.regexp_replace(text, r"(?<=\n {4}|\A {4}) +", ""), r"(?<=[^ \n]) {2,}", " ")


def collapse_newlines(c: Column, most: int = 2) -> Column:
    """X4."""
    return F.regexp_replace(c, "\n{%d,}" % (most + 1), "\n" * most)


def sentences(c: Column) -> Column:
    """Split after a full stop, question or exclamation mark."""
    return F.split(F.trim(c), r"(?<=[.!?])\s+")


def source_windows(parts: Column, width: int = 4, stride: int = 2) -> Column:
    """Windows of sentences, the last one reaching the end."""
    n = F.size(parts)
    last = F.ceil((n - width) / stride).cast("int") * stride
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), lambda i: F.array_join(F.slice(parts, i + 1, F.lit(width)), " "))
    return F.when(n <= width, F.array(F.array_join(parts, " "))).otherwise(windows)


def section_intent(c: Column) -> Column:
    """which section a question is after; null when none is recognised."""
    out = F.lit(None).cast("string")
    for name, patterns in reversed(SECTION_INTENTS.items()):
        out = F.when(F.lower(c).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)).otherwise(out)
    return out


def heading_class(c: Column) -> Column:
    """X21."""
    out = F.lit("other")
    for name, pattern in reversed(HEADINGS.items()):
        out = F.when(F.lower(c).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _venue(c: Column, venues: list[str]) -> Column:
    return F.coalesce(*[F.when(F.lower(c).rlike(r"\b%s\b" % v.lower()), F.lit(v)) for v in venues])


def venue(c: Column) -> Column:
    """The first listed venue named in the first 2000 characters."""
    return _venue(F.substring(c, 1, 2000), PAPER_VENUES)


def academic_filters(c: Column, year_now: int) -> Column:
    """filters that a question states; ``year_now`` replaces the wall clock."""
    some = lambda x: F.when(x != "", x)
    both = r"\b(20\d{2})\s*(?:-|to)\s*(20\d{2})\b"
    low, high = (some(F.regexp_extract(c, both, k)).cast("int") for k in (1, 2))
    single = F.when(low.isNull(), some(F.regexp_extract(c, r"\b(20\d{2})\b", 1)).cast("int"))
    recent = F.when(low.isNull() & single.isNull() & F.lower(c).rlike(RECENT), F.lit(year_now - 2))
    kind = F.when(F.lower(c).rlike(r"\barxiv\b"), "arxiv").when(F.lower(c).rlike(r"\b(conference|workshop) paper"), "conference").when(F.lower(c).rlike(r"\bjournal (paper|article)"), "journal")
    return F.struct(F.coalesce(low, recent).alias("year_min"), high.alias("year_max"), single.alias("year_eq"), some(F.regexp_extract(c, r"\bby\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", 1)).alias("author"), _venue(c, QUERY_VENUES).alias("venue"), kind.alias("paper_type"))


def basic_expansion(c: Column) -> Column:
    """At most two rewordings."""
    what = F.when(~c.endswith("?"), F.concat(F.lit("What is "), c, F.lit("?")))
    explain = F.when(~F.lower(c).rlike("^(what|how|why|explain)"), F.concat(F.lit("Explain "), c))
    return F.array_compact(F.array(what, explain))


def squad_normal(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(c), r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def set_f1(a: Column, b: Column) -> Column:
    """M7: F1 of two token arrays as sets."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(common > 0, 2 * common / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def citation_author(authors: Column, whole: bool = False) -> Column:
    """One, two, or the first of several authors (surnames, or whole names for one and two)."""
    last = lambda x: F.element_at(F.split(F.trim(x), r"\s+"), -1)
    name = (lambda x: x) if whole else last
    n = F.size(authors)
    return F.when(authors.isNull() | (n <= 0), F.lit("Unknown")).when(n == 1, name(F.get(authors, F.lit(0)))).when(n == 2, F.concat(name(F.get(authors, F.lit(0))), F.lit(" & "), name(F.get(authors, F.lit(1))))).otherwise(F.concat(last(F.get(authors, F.lit(0))), F.lit(" et al.")))


def answer_confidence(scores: Column, answer: Column) -> Column:
    """Scores outside 0 to 1 are squashed; mean, number of sources and answer length are weighed; 0 without either."""
    squash = F.transform(scores, lambda s: F.when((s >= 0) & (s <= 1), s).otherwise(1 / (1 + F.exp(-s))))
    n, length = F.size(scores), F.length(answer)
    mean = F.aggregate(squash, F.lit(0.0), lambda a, x: a + x) / n
    told = F.when(length < 50, F.lit(0.3)).when(length < 200, F.lit(0.7)).otherwise(F.lit(1.0))
    return F.when((n > 0) & (length > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * mean + 0.3 * F.least(n / F.lit(3.0), F.lit(1.0)) + 0.2 * told))).otherwise(F.lit(0.0))


def html_text(c: Column) -> Column:
    """Extension: a page's text without scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
