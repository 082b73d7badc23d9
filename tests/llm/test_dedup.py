"""The three exact deduplication operators against brute force."""

import hashlib
import random

import pytest

from corpusloom.llm import kernels as K
from corpusloom.llm.line_dedup import MinimalPerfectHash, dedup_lines
from corpusloom.llm.substring_dedup import dedup_substrings
from corpusloom.llm.suffix_dedup import dedup_suffixes

SCHEMA = "doc_id long, text string, slot string, payload int"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    passage = [" ".join(word() for _ in range(n)) for n in (30, 45, 25, 60)]
    base = [" ".join(word() for _ in range(r.randint(0, 120))) for _ in range(20)]
    texts = []
    for k in range(60):
        parts = [r.choice(base)[: r.randint(0, 500)], r.choice(passage), r.choice(base)]
        if k % 4 == 0:
            parts.append(r.choice(passage))
        texts.append(("\n" if k % 2 else "  \t").join(parts))
    texts += [texts[3], texts[3], None, "", " \n ", "a " * 300, "a " * 200, "x" * 400, "=" * 90, "Line of Text\n line of text \nLINE OF TEXT", "line of text\nshort\nshort", "short"]
    ids = list(range(0, 2 * len(texts), 2))
    r.shuffle(ids)
    rows = [(i, t, "extra", 1) for i, t in zip(ids, texts)]
    return rows + [rows[0], rows[1], (None, texts[5], None, None), (ids[9], texts[2], "same id, other text", 0)]


def words_expected(rows, window):
    seen, out = {}, []
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    for i, t, *_ in order:
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            at = (-1 if i is None else i, s)
            seen[key] = min(seen.get(key, at), at)
    for i, t, *_ in order:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] != (-1 if i is None else i, s):
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def bytes_expected(rows, window):
    first, out = {}, []
    num = lambda i: -1 if i is None else i
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - window + 1):
            key = b[s : s + window]
            first[key] = min(first.get(key, 1 << 60), num(i))
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < num(i):
                gone[s : s + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def lines_expected(rows):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\r\x0b\x0c"))
    num = lambda i: -1 if i is None else i
    holders, out = {}, []
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(num(i))
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == num(i)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


order = lambda rows: sorted(rows, key=lambda x: tuple((v is not None, v) for v in x))


@pytest.mark.parametrize("window", [20, 7])
def test_substrings(spark, window):
    rows = corpus()
    got = dedup_substrings(spark.createDataFrame(rows, SCHEMA), window).collect()
    assert order((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got) == order(words_expected(rows, window))


@pytest.mark.parametrize("window", [50, 33])
def test_suffixes(spark, window):
    rows = corpus()
    got = dedup_suffixes(spark.createDataFrame(rows, SCHEMA), window).collect()
    assert order((x.doc_id, x.n_bytes, x.n_removed, len(x.spans) // 2, bytes(x.kept)) for x in got) == order(bytes_expected(rows, window))


def test_suffixes_last_bit(spark):
    """Repeats of 49 to 63 bytes that end before bytes which differ in their last bit only."""
    r = random.Random(7)
    rows = []
    for n in range(49, 64):
        run = "".join(r.choice("abcdefgh") for _ in range(n))
        for k, rest in enumerate(("", "x", "wxyz")):
            own = run[::-1] if k == 1 else run if k == 2 else run.upper()
            rows += [(len(rows), own + "2" + rest, "", 0), (len(rows) + 1, own + "3" + rest, "", 0)]
    got = dedup_suffixes(spark.createDataFrame(rows, SCHEMA), 50).collect()
    assert order((x.doc_id, x.n_bytes, x.n_removed, len(x.spans) // 2, bytes(x.kept)) for x in got) == order(bytes_expected(rows, 50))


def test_lines(spark):
    rows = corpus()
    for bound in (1 << 20, 0):  # arrays on all workers, and in their shards
        got = dedup_lines(spark.createDataFrame(rows, SCHEMA), max_broadcast=bound, chunk_bytes=3000).collect()
        assert order((x.doc_id, x.n_lines, x.n_dropped, x.kept_text) for x in got) == order(lines_expected(rows))


def test_fingerprint_decides(spark, monkeypatch):
    """The perfect hash places foreign lines as well; without the right fingerprint a line stays."""
    import numpy as np

    from corpusloom.llm import line_dedup

    r = np.random.default_rng(1)
    keys, prints, foreign = (r.integers(0, 1 << 63, n).astype(np.uint64) for n in (1000, 1000, 5000))
    shard = line_dedup.Shard(*K.unpack(line_dedup.Shard.build(keys, prints, np.full(1000, 2, np.uint8), np.arange(1000))))
    none = np.iinfo(np.int64).max
    assert shard.owners(keys, prints).tolist() == list(range(1000))
    assert (shard.index(foreign) >= 0).any() and set(shard.owners(foreign, foreign).tolist()) == {none}
    shard.fingerprint[shard.index(keys[:1])] ^= np.uint64(1)
    assert shard.owners(keys, prints).tolist() == [none, *range(1, 1000)]
    shard.count[:] = 1
    assert set(shard.owners(keys, prints).tolist()) == {none}


@pytest.mark.parametrize("operator", [dedup_substrings, dedup_suffixes, dedup_lines])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_minimal_perfect_hash():
    import numpy as np

    keys = np.array([int.from_bytes(hashlib.md5(str(k).encode()).digest()[:8], "little") for k in range(5000)], np.uint64)
    assert sorted(MinimalPerfectHash.build(keys)(keys).tolist()) == list(range(5000))
    assert len(MinimalPerfectHash.build(keys[:0])(keys[:0])) == 0


def hot_corpus():
    """One line, one passage and one id in a third of all rows and more; a long text; rows that are equal."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    passage = " ".join(word() for _ in range(70))
    rows = [(k, f"{word()} {word()}\n{passage}\n{word()} the same line everywhere\nThe same line of all", "", 0) for k in range(300)]
    rows += [(None, f"{word()} {passage}", "", 0) for _ in range(150)] + [(7, passage, "", 1)] * 150
    return rows + [(900, " ".join(word() for _ in range(60_000)) + " " + passage, "", 0), (901, "x" * 300_000, "", 0)]


@pytest.mark.parametrize(("chunk_bytes", "hot"), [(4000, 256), (4000, 2), (1 << 20, 2), (4000, 9)])
def test_hot_keys(spark, chunk_bytes, hot):
    """Results don't hang on the number of chunks, and a hot key costs a slot one entry a chunk."""
    rows = hot_corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = dedup_substrings(docs, 20, chunk_bytes=chunk_bytes, hot_chunks=hot).collect()
    assert order((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got) == order(words_expected(rows, 20))
    got = dedup_suffixes(docs, 50, chunk_bytes=chunk_bytes, hot_chunks=hot).collect()
    assert order((x.doc_id, x.n_bytes, x.n_removed, len(x.spans) // 2, bytes(x.kept)) for x in got) == order(bytes_expected(rows, 50))
    got = dedup_lines(docs, max_broadcast=chunk_bytes, chunk_bytes=chunk_bytes).collect()
    assert order((x.doc_id, x.n_lines, x.n_dropped, x.kept_text) for x in got) == order(lines_expected(rows))


def test_words_decide():
    """Places that meet under one hash but differ in their words are told apart."""
    import numpy as np

    from corpusloom.llm.substring_dedup import first_places

    texts = [list(range(4)), list(range(4)), [0, 9, 2, 3], [5, 0, 1, 2, 3], [0, 1, 2, 8]]
    codes = np.array(sum(texts, []))
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    same = np.zeros(5, np.uint64)
    anchor, size = np.array([0, 0, 0, 1, 0]), np.array([1, 1, 1, 2, 1])
    got = first_places(same, (codes, begins), anchor, size, np.array([3, 1, 0, 2, 4]), np.zeros(5, np.int64), 4, 2)
    assert got.tolist() == [False, True, True, True, False, True]
