"""SimHash near-duplicates found by deletion-variant signatures.

64-bit fingerprints that differ in at most d bits are cut into d // 2 + 1 segments,
so that one segment differs by at most one bit.  Each segment is indexed once for
each of its bits with that bit left out; two fingerprints that agree in such a
variant meet by equality on it and are verified by their distance.  Equal
fingerprints are one entry from the start, with their smallest document.

Within a group of equal variants only a spanning forest is emitted, never all pairs:
small groups are compared by offset, larger ones by a search that drops whatever it
has reached, so a large clump of near copies costs about its size.  Components are
found on Spark.

Cases: a null text, or one without words, has fingerprint zero and links like any
other; fewer words than a shingle are one shingle; rows with the same id share their
component; a null id sorts first, as component it is null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import exchange as X
from corpusloom.llm import kernels as K
from corpusloom.llm.components import connected_components
from corpusloom.runtime import materialise, ship_package

SEED = 42
_PRINTS = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Groups up to this size are compared by offset.
SMALL_GROUP = 256
#: Fingerprint variants of one slot, about.
SLOT_ENTRIES = 1 << 19
#: Hashes whose bits are laid open at once, about.
HASHES_AT_ONCE = 1 << 17


def fingerprint_texts(docs: K.Docs, shingle: int) -> np.ndarray:
    """SimHash of each document."""
    hash64, hashes, counts = xxhash.xxh64_intdigest, [], np.zeros(len(docs), np.int64)
    low = docs.lowered()
    for k in range(len(docs)):
        words = low.text(k).split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(hash64(line, SEED))
            counts[k] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes += [hash64(line[a:b], SEED) for a, b in zip(starts[: 1 - shingle or None].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
        counts[k] = len(words) - shingle + 1
    return majorities(np.array(hashes, np.uint64), counts)


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of documents whose hashes stand one document after the other: bits set in over half of them; zero without hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts[full])
    first = 0
    while first < len(full):
        # As many documents as have about so many hashes, at least one.
        begin = ends[first] - counts[full[first]]
        last = max(first + 1, int(np.searchsorted(ends, begin + HASHES_AT_ONCE, "right")))
        bits = np.unpackbits(hashes[begin : ends[last - 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = counts[full[first:last]]
        begins = np.cumsum(own) - own
        ones = np.stack([bits[b : b + n].sum(axis=0, dtype=np.int64) for b, n in zip(begins, own, strict=True)])
        out[full[first:last]] = np.packbits(2 * ones > own[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
        first = last
    return out


def _fingerprints(shingle: int):
    def run(batches):
        K.clear()
        for docs in K.documents(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(docs.ids), pa.array(fingerprint_texts(docs, shingle).view(np.int64))], schema=_PRINTS)

    return run


def _variants(distance: int) -> list[tuple[int, int]]:
    """Segment mask and left-out bit of each variant."""
    edges = [64 * k // (distance // 2 + 1) for k in range(distance // 2 + 2)]
    return [(((1 << (b - a)) - 1) << a, 1 << bit) for a, b in zip(edges, edges[1:], strict=False) for bit in range(a, b)]


def _signatures(distance: int, slots: int):
    variants = _variants(distance)

    def run(batches):
        for batch in batches:
            bits = batch.column(0).to_numpy().view(np.uint64)
            owner = batch.column(1).to_numpy()
            if not len(bits):
                continue
            kept = np.array([mask & ~bit for mask, bit in variants], np.uint64)
            which = np.repeat(np.arange(len(variants), dtype=np.uint8), len(bits))
            keys = (bits[None, :] & kept[:, None]).reshape(-1)
            slot = (K.mix(keys + which.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(slots)).astype(np.int32)
            row = np.tile(np.arange(len(bits)), len(variants))
            yield K.packed_rows([(s, K.pack(which[part], bits[row[part]], owner[row[part]])) for s, part in K.dealt(slot)])

    return run


def _near(bits: np.ndarray, one: np.ndarray | np.uint64, distance: int) -> np.ndarray:
    return np.bitwise_count(bits ^ one) <= distance


def _links(distance: int):
    variants = _variants(distance)
    kept = np.array([mask & ~bit for mask, bit in variants], np.uint64)

    def run(table: pa.Table) -> pa.Table:
        which, bits, owner = (np.concatenate(x) for x in zip(*(K.unpack(p) for p in table.column("payload").to_pylist()), strict=True))
        key = bits & kept[which]
        order = np.lexsort((bits, key, which))
        which, bits, owner, key = which[order], bits[order], owner[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (which[1:] != which[:-1]) | (key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(heads, append=len(key))
        left, right = [], []
        last = np.repeat(heads + sizes, sizes)
        last[np.repeat(sizes > SMALL_GROUP, sizes)] = 0
        at, step = np.arange(len(key)), 1
        while len(at := at[at + step < last[at]]):
            near = at[_near(bits[at], bits[at + step], distance)]
            left.append(owner[near])
            right.append(owner[near + step])
            step += 1
        for k in np.flatnonzero(sizes > SMALL_GROUP):
            open_ = np.arange(heads[k], heads[k] + sizes[k])
            while len(open_):
                reached, open_ = [open_[0]], open_[1:]
                while reached and len(open_):
                    x = reached.pop()
                    near = _near(bits[open_], bits[x], distance)
                    found, open_ = open_[near], open_[~near]
                    left.append(np.full(len(found), owner[x]))
                    right.append(owner[found])
                    reached.extend(found.tolist())
        pairs = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])], axis=1), axis=0)
        roots: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := roots.get(x, x)) != x:
                roots[x] = roots.get(up, up)
                x = up
            return x

        for a, b in pairs.tolist():
            a, b = root(a), root(b)
            if a != b:
                roots[max(a, b)] = min(a, b)
        nodes = np.unique(pairs)
        tops = np.array([root(x) for x in nodes.tolist()], np.int64)
        linked = nodes != tops
        return pa.Table.from_arrays([pa.array(nodes[linked]), pa.array(tops[linked])], schema=_EDGES)

    return run


def fingerprint_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b), a spanning forest of each group of equal variants, between the owners of
    distinct fingerprints (bits, owner) that differ in at most ``distance`` bits."""
    n = max(2, -(-prints.count() * len(_variants(distance)) // SLOT_ENTRIES))
    return prints.mapInArrow(_signatures(distance, n), K.PACKED).groupBy("slot").applyInArrow(_links(distance), "a long, b long")


def simhash_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints and near-duplicate components of documents.

    Returns per input row: doc_id, fingerprint (16 hexadecimal digits), component_id
    (the smallest id that links of at most ``distance`` differing bits reach).
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = X.select_texts(docs, id_col, text_col)
    prints = materialise(texts.mapInArrow(_fingerprints(shingle), "doc_id long, bits long"), "prints")
    owners = materialise(prints.groupBy("bits").agg(F.min("doc_id").alias("owner")), "owners")
    roots = connected_components(fingerprint_links(owners, distance))
    classes = owners.join(roots, owners["owner"] == roots["node"], "left").select("bits", F.coalesce("root", "owner").alias("component"))
    real = lambda c: F.when(F.col(c) != F.lit(int(K.NULL_ID)), F.col(c))
    return prints.join(classes, "bits").select(real("doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), real("component").alias("component_id"))
