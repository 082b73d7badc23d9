"""Token ids in Arrow files of equal-length sequences, with random access.

A shard is an Arrow IPC file whose record batches hold ``ids`` and ``mask`` as
fixed-size lists; all sequences have one length and all batches but the last one
size, so sequence k is found by division and read from the mapped file without a
copy.  The mask is false on the padding that ends a shard.  Beside it stands an index
of its documents (id, first token, number of tokens).

Documents are range-partitioned by id and the start of their text, into as many shards
as their bytes ask for, so shards follow each other; a shard's place in the whole stream
is the sum of those before it.  Tasks write under names of their own through pyarrow's
file systems, and only what the committed manifest names counts, so lost or repeated tasks
leave no wrong data.

Cases: a null or empty text is its end token; rows with the same id stand next to each
other in the order of their texts; a null id comes first; an empty table gives no
documents; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import exchange as X
from corpusloom.llm import kernels as K
from corpusloom.runtime import shared_dir, ship_package

MANIFEST = "shard int, path string, n_docs long, n_tokens long"
_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
#: Bytes of text in a shard, about.
SHARD_BYTES = 16 << 20
#: Sequences in a record batch.
BATCH_SEQUENCES = 256
#: Distinct words whose ids a worker remembers at most.
REMEMBERED = 500_000
#: How byte-level BPE vocabularies of this family cut a text before merging; a fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _latin1_pieces() -> re.Pattern:
    """``WORDS`` for Latin-1 texts, its classes written out, since ``re`` knows no ``\\p`` but is the faster engine."""
    letters, digits, spaces = ("".join(re.escape(c) for c in map(chr, range(256)) if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    # What begins with a space or a letter goes first, since most pieces do and no other kind before it can begin so.
    first = r" ?\p{L}+|"
    inside = (first + WORDS.replace(first, "")).replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]")
    for name, members in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{digits}]"), (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]")):
        inside = inside.replace(name, members)
    return re.compile(inside)


class Encoder:
    """Texts to ids with the tokenizers library.

    Byte-level BPE merges within the pieces of a fixed pattern only, so the ids of
    distinct pieces are remembered (up to ``REMEMBERED``).  Texts outside Latin-1, or
    with a special token's string, and other kinds of tokenizers take the library's
    whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        cut = spec.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        self.by_piece = plain and not spec.get("normalizer") and spec["model"].get("type") == "BPE" and not spec.get("truncation")
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.dtype is np.uint16 else "I"
        self.end = np.zeros(1, self.dtype).tobytes()
        self.pieces = _latin1_pieces().findall
        self.known: dict[str, bytes] = {}
        # Tokens that begin with a space, which byte-level vocabularies write as U+0120.
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces.

        A space and letters is cut off from the next such piece by the pattern itself, so
        many of them are encoded as one text, and its tokens that begin with a space tell
        where each begins.
        """
        fast = self.tokenizer.encode_batch_fast
        plain, rest = [], []
        for p in pieces:  # after a space and a letter the pattern takes letters alone
            (plain if p[0] == " " and p[1:2].isalpha() else rest).append(p)
        groups = [plain[k : k + 1000] for k in range(0, len(plain), 1000)]
        for group, e in zip(groups, fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(group):  # not a vocabulary of this kind after all
                rest += group
                continue
            body, cuts = ids.tobytes(), (cuts * ids.itemsize).tolist()
            self.known.update(zip(group, [body[a:z] for a, z in zip(cuts, [*cuts[1:], len(body)], strict=True)], strict=True))
        for piece, e in zip(rest, fast(rest, add_special_tokens=False), strict=True):
            self.known[piece] = array(self.code, e.ids).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and an end, as bytes."""
        out: list = [None] * len(texts)
        cut: dict[int, list[str]] = {}
        for k, text in enumerate(texts):
            if self.by_piece and not any(s in text for s in self.special):
                try:
                    text.encode("latin-1")
                    cut[k] = self.pieces(text)
                    continue
                except UnicodeEncodeError:
                    pass
            out[k] = self.whole(text) + self.end
        pieces = set().union(*cut.values())
        missing = list(pieces.difference(self.known))
        if missing:
            if len(self.known) + len(missing) > REMEMBERED:
                self.known.clear()
                missing = list(pieces)
            self.learn(missing)
        ids = self.known.__getitem__
        for k, pieces in cut.items():
            out[k] = b"".join(map(ids, pieces)) + self.end
        return out


def encoder(path: str) -> Encoder:
    return K.held(("encoder", path), lambda: Encoder(path))


def _schema(dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Writes one shard's ids as they come."""

    def __init__(self, sink, dtype, length: int):
        self.dtype, self.length, self.schema = dtype, length, _schema(dtype, length)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[bytes] = []
        self.held = self.total = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        n = len(ids) // np.dtype(self.dtype).itemsize
        self.held += n
        self.total += n
        if self.held >= BATCH_SEQUENCES * self.length:
            self._flush(self.held // (BATCH_SEQUENCES * self.length) * BATCH_SEQUENCES * self.length)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.dtype)
        self.waiting, self.held = [ids[n:].tobytes()], len(ids) - min(n, len(ids))
        real = np.ones(n, bool)
        if n > len(ids):
            real[len(ids) :] = False
            ids = np.concatenate([ids, np.zeros(n - len(ids), self.dtype)])
        step = BATCH_SEQUENCES * self.length
        for at in range(0, n, step):
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[at : min(at + step, n)]), self.length) for x in (ids, real)]
            self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._flush(-(-self.held // self.length) * self.length)
        self.file.close()


class Shard:
    """Random access to a shard; sequences and masks are views of the mapped file."""

    def __init__(self, path: str):
        fs, at = pa.fs.FileSystem.from_uri(path)
        source = pa.memory_map(at) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return 0 if not n else (n - 1) * BATCH_SEQUENCES + self.reader.get_batch(n - 1).num_rows

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        batch = self.reader.get_batch(k // BATCH_SEQUENCES)
        at = k % BATCH_SEQUENCES * self.length
        return batch.column(0).values.to_numpy()[at : at + self.length], batch.column(1).values.slice(at, self.length)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the shard's stream."""
        step, parts = BATCH_SEQUENCES * self.length, []
        while n > 0:
            values = self.reader.get_batch(start // step).column(0).values.to_numpy()
            part = values[start % step :][:n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def _encode(tokenizer: str, folder: str, length: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        writer, docs, known = None, (array("q"), array("q"), array("q")), array("b")
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for at in range(0, len(texts), 512):
                if writer is None and texts:
                    path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
                    fs, place = pa.fs.FileSystem.from_uri(path)
                    fs.create_dir(os.path.dirname(place), recursive=True)
                    sink = fs.open_output_stream(place + ".arrow")
                    writer = ShardWriter(sink, encode.dtype, length)
                for i, ids in zip(batch.column(0)[at : at + 512].to_pylist(), encode.batch(texts[at : at + 512]), strict=True):
                    known.append(i is not None)
                    for column, value in zip(docs, (i or 0, writer.total, len(ids) // np.dtype(encode.dtype).itemsize), strict=True):
                        column.append(value)
                    writer.add(ids)
        if writer is not None:
            writer.close()
            sink.close()
            K.release()
            with fs.open_output_stream(place + ".index.arrow") as out, pa.ipc.new_file(out, _INDEX) as index:
                columns = [pa.array(np.frombuffer(c, np.int64), mask=None if k else np.frombuffer(known, np.int8) == 0) for k, c in enumerate(docs)]
                index.write_batch(pa.RecordBatch.from_arrays(columns, schema=_INDEX))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(docs[0])], pa.int64()), pa.array([writer.total], pa.int64())], schema=_MANIFEST)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts in ascending order of their ids and write them as shards.

    tokenizer: path of a tokenizers file, the same on all machines.  folder: a URI
    that pyarrow can write; by default a new one in the shared folder.  Returns the
    manifest: shard, path, n_docs, n_tokens, and first_token, the ids in all shards before.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    texts = X.select_texts(docs, id_col, text_col)
    n = X.parts_of(texts, SHARD_BYTES)
    # Rows of one id, or of none, may be many: the text's first characters divide them in the order of texts.
    dealt = texts.repartitionByRange(n, "doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_encode(tokenizer, folder, length), MANIFEST).write.parquet(f"{folder}/manifest")
    shards = sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect())  # one row a shard
    first = np.concatenate([[0], np.cumsum([s.n_tokens for s in shards])]).tolist()
    return spark.createDataFrame([(*s, f) for s, f in zip(shards, first, strict=False)], MANIFEST + ", first_token long")


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard(path + ".arrow")
            fs, place = pa.fs.FileSystem.from_uri(path + ".index.arrow")
            with fs.open_input_file(place) as source:
                index = pa.ipc.open_file(source).read_all()
            starts, counts = index.column("start").to_pylist(), index.column("n_tokens").to_pylist()
            for at in range(0, len(starts), 8192):
                s, n = starts[at : at + 8192], counts[at : at + 8192]
                sums = [zlib.crc32(shard.tokens(a, k).astype("<u4").tobytes()) for a, k in zip(s, n, strict=True)]
                ids = index.column("doc_id").slice(at, 8192).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, pa.array([first + a for a in s], pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.int64())], schema=_DOCUMENTS)


def read_documents(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start in the whole stream, n_tokens, ids_crc32 of each document."""
    return manifest.select("path", "first_token").repartition(max(1, manifest.count())).mapInArrow(_read, DOCUMENTS)
