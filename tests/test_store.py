"""The store, file conversion and runs on values worked out by hand."""

import io
import json
import zipfile
import zlib

from pyspark.sql import functions as F

from corpusloom.operators import store
from corpusloom.sources import convert as C


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", "COSINE")
    assert s.metric == "cosine" and store.Store(spark, "x", "odd").metric == "cosine" and s.table("chunks").collect() == []
    doc = lambda i, u, day: (i, u, f"{i}.md", day)
    docs = lambda *rows: spark.createDataFrame(list(rows), "document_id string, user_id string, filename string, processing_date string").withColumn("created_at", F.to_timestamp("processing_date"))
    s.put_documents(docs(doc("a", "u", "2024-01-01"), doc("b", "v", "2024-01-03")))
    s.put_documents(docs(doc("a", "u", "2024-01-02")))
    assert [(r.document_id, r.processing_date) for r in s.documents().collect()] == [("b", "2024-01-03"), ("a", "2024-01-02")]
    s.append("chunks", spark.createDataFrame([("a1", "a", 1, "two"), ("a0", "a", 0, "one"), ("b0", "b", 0, "three"), ("z", "gone", 0, "x")], "chunk_id string, document_id string, chunk_index int, text string"))
    s.append("vectors", spark.createDataFrame([("a0", "a", [1.0]), ("b0", "b", [0.5])], "chunk_id string, document_id string, embedding array<float>"))
    assert [r.chunk_id for r in s.chunks_of("a").collect()] == ["a0", "a1"]
    assert [r.chunk_id for r in s.all_chunks().collect()] == ["a0", "a1", "b0"] and [r.chunk_id for r in s.all_chunks("v").collect()] == ["b0"]
    assert s.owner("a") == "u" and s.owner("none") is None and s.info()["vectors"] == 2 and s.count("chunks", F.col("document_id") == "a") == 2
    assert not s.delete_document("a", "v") and not s.delete_document("none") and s.delete_document("a", "u")
    assert s.count("vectors") == 1 and s.count("documents") == 1 and s.count("chunks") == 2
    s.append("conversations", spark.createDataFrame([("c", "u")], "conv_id string, user_id string").withColumn("updated_at", F.to_timestamp(F.lit("2024-01-01"))))
    s.add_message(spark.createDataFrame([("c", 0, "user", "hi")], "conv_id string, turn int, role string, text string").withColumn("created_at", F.to_timestamp(F.lit("2024-05-01"))))
    assert str(s.table("conversations").first().updated_at) == "2024-05-01 00:00:00"
    s.delete_conversation("c")
    assert s.count("messages") == 0 == s.count("conversations") and s.drop("vectors") and s.count("vectors") == 0


def test_projections(spark):
    df = spark.createDataFrame([("x" * 300, "u", None)], "text string, user_id string, year int")
    one = df.select(store.preview(F.col("text")).alias("p"), store.metadata_json(df, "user_id", "year").alias("m"), store.content_id(F.col("text")).alias("i")).first()
    assert len(one.p) == 200 and json.loads(one.m) == {"user_id": "u"} and len(one.i) == 32
    assert df.select(store.from_metadata(F.lit('{"a": 1}'), "a int").alias("x"), store.from_metadata(F.lit("no"), "a int").alias("y")).first().x.a == 1
    assert store.owned(df, None).count() == 1 == store.owned(df, "u").count() and store.owned(df, "w").count() == 0
    tokens = spark.createDataFrame([("t", 5), ("s", 9)], "token string, expires_at int")
    assert [r.token for r in store.unexpired(tokens, F.lit(6)).collect()] == ["s"] and [r.token for r in store.recent(tokens, "expires_at", 1, "token").collect()] == ["s"]
    votes = spark.createDataFrame([("c1", "e", "correct", False), ("c2", "e", "correct", True), ("c3", "e", "wrong", True)], "claim string, evidence string, verdict string, flagged boolean")
    assert {r.claim: r.label for r in store.feedback_export(votes).collect()} == {"c1": 1, "c2": 0, "c3": 1}


def test_resume(spark, tmp_path):
    asked = spark.createDataFrame([(k,) for k in range(4)], "question_id int")
    saved = spark.createDataFrame([(store.run_key({"k": 1, "m": "x"}), 0, "yes"), (store.run_key({"k": 2}), 1, "other")], "run string, question_id int, answer string")
    left, done = store.resume(asked, saved, {"m": "x", "k": 1})
    assert sorted(r.question_id for r in left.collect()) == [1, 2, 3] and [r.answer for r in done.collect()] == ["yes"]
    store.write_report({"mrr": 0.5, "é": [1]}, f"file://{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"mrr": 0.5, "é": [1]}


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r><w:r><w:tab/><w:t>end</w:t></w:r></w:p>" if p else "<w:p/>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(*pages):
    streams = []
    for k, text in enumerate(pages):
        body = b"BT /F1 12 Tf 72 700 Td (" + text.encode("latin-1") + rb") Tj 0 -14 Td (line \(2\)) Tj ET"
        body = zlib.compress(body) if k % 2 else body
        streams.append(b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream\n")
    return b"%PDF-1.4\n" + b"".join(streams) + b"%%EOF"


def test_convert(spark, tmp_path):
    files = {"a.docx": docx("One", "", "Two"), "b.pdf": pdf("First page", "Second"), "c.txt": "café".encode("latin-1"), "d.md": b"  \n", "e.docx": b"broken", "f.exe": b"x", "g.txt": b"\xef\xbb\xbfplain", "big.txt": b"y" * 3000}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    read = C.read_files(spark, [str(tmp_path / n) for n in [*files, "gone.txt"]])
    results = C.convert(read, max_mb=0.002)
    got = {r.path.rsplit("/", 1)[-1]: r for r in results.collect()}
    assert got["a.docx"].markdown == "One\tend\n\nTwo\tend" and got["b.pdf"].markdown.startswith("## Page 1\n\nFirst page\nline (2)\n\n## Page 2\n\nSecond")
    assert got["c.txt"].markdown == "café" and got["g.txt"].markdown == "plain"
    assert got["d.md"].error == "Conversion failed: No text extracted from MD" and got["e.docx"].error.startswith("Conversion failed") and got["f.exe"].error.startswith("Unsupported file type: .exe")
    assert got["gone.txt"].error.startswith("File not found: ") and got["big.txt"].error.startswith("File too large: 0.0 MB")
    own = C.convert(read.filter("path like '%e.docx' or path like '%c.txt'"), primary=lambda path, content: "own" if path.endswith("docx") else "")
    assert {r.path.rsplit("/", 1)[-1]: r.markdown for r in own.collect()} == {"e.docx": "own", "c.txt": "café"}
    told = C.converted(results, read)
    a = told.filter("path like '%a.docx'").first()
    assert a.filename == "a.docx" and a.file_type == ".docx" and a.markdown_length == len(a.markdown) and a.document_id.startswith("doc_")
    written = C.write_markdown(told, f"file://{tmp_path}/md").collect()
    assert len(written) == 4 and all(r.written for r in written)
    assert (tmp_path / "md" / f"{a.document_id}_a.md").read_text() == a.markdown


def test_html():
    page = b"<html><head><title>t</title></head><body><h2>Head</h2><p>One &amp; two</p><script>x()</script><ul><li>a<li>b</ul></body></html>"
    assert C.html_text(page) == "## Head\n\nOne & two\n\n- a\n- b"
    assert C.plain_text("﻿hi".encode("utf-16-le")) == "hi"
