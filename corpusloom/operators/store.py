"""Documents, conversations, query log and feedback as tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# K2: the tables of a store.  Metadata is JSON text.
TABLES = {
    "documents": "document_id string, user_id string, filename string, file_path string, file_type string, total_chunks int, processing_date string, metadata string, created_at timestamp",
    "chunks": "chunk_id string, document_id string, chunk_index int, text string, token_count int, header_path string, page_number int, has_code boolean, has_tables boolean, has_overlap boolean, merged boolean, emergency_split boolean, metadata string, created_at timestamp",
    "images": "image_id string, document_id string, image_path string, description string, ocr_text string, vision_provider string, metadata string, created_at timestamp",
    "conversations": "conv_id string, user_id string, title string, metadata string, created_at timestamp, updated_at timestamp",
    "messages": "message_id string, conv_id string, turn int, role string, text string, sources string, metadata string, created_at timestamp",
    "query_log": "query_id string, conv_id string, query string, num_results int, seconds double, confidence double, model_used string, created_at timestamp",
    "feedback": "vote_id string, user_id string, conv_id string, claim string, claim_hash string, verdict string, flagged boolean, evidence string, entailment double, created_at timestamp",
    "vectors": "chunk_id string, document_id string, user_id string, embedding array<float>, payload string",
}
METRICS = ("cosine", "euclidean", "dot")


class Store:
    """The tables as Parquet folders under one root.

    Rows are appended; what replaces or deletes rows writes the table anew beside the old one
    and takes its place.  Reading a table that nothing was written to gives no rows.
    """

    def __init__(self, spark: SparkSession, root: str, metric: str = "cosine"):
        self.spark, self.root = spark, root.rstrip("/")
        self.metric = metric.lower() if metric.lower() in METRICS else "cosine"

    def _path(self, table: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, table: str) -> DataFrame:
        path, files = self._path(table)
        if not files.exists(path):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}")

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], TABLES[table]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])

    def append(self, table: str, rows: DataFrame) -> None:
        """K4, K5, K8: bulk insert; columns that are missing are null."""
        self._shaped(table, rows).write.mode("append").parquet(f"{self.root}/{table}")

    def replace(self, table: str, rows: DataFrame) -> None:
        """The table anew: written beside the old one, then in its place."""
        path, files = self._path(table)
        beside = self._path(f"_{table}")[0]
        files.delete(beside, True)
        self._shaped(table, rows).write.parquet(f"{self.root}/_{table}")
        files.delete(path, True)
        files.rename(beside, path)

    def put_documents(self, rows: DataFrame) -> None:
        """K3: insert or replace by document_id; the new row stays."""
        old = self.table("documents").join(rows.select("document_id").distinct(), "document_id", "left_anti")
        self.replace("documents", old.unionByName(self._shaped("documents", latest(rows, "document_id", F.desc("processing_date")))))

    def drop(self, table: str) -> bool:
        """K13."""
        path, files = self._path(table)
        return files.delete(path, True)

    def info(self) -> dict:
        """Where the collection is and what it holds."""
        return {"root": self.root, "metric": self.metric, "vectors": self.table("vectors").count()}

    def count(self, table: str, condition: Column | None = None) -> int:
        """Rows, of those that a condition keeps."""
        rows = self.table(table)
        return (rows if condition is None else rows.filter(condition)).count()

    def chunks_of(self, document_id: str) -> DataFrame:
        """S12."""
        return self.table("chunks").filter(F.col("document_id") == document_id).orderBy("chunk_index")

    def all_chunks(self, user_id: str | None = None) -> DataFrame:
        """All chunks, or those of a tenant's documents, in the order that breaks ties."""
        return tenant_chunks(self.table("chunks"), self.table("documents"), user_id).orderBy("document_id", "chunk_index")

    def document(self, document_id: str) -> DataFrame:
        """S14."""
        return self.table("documents").filter(F.col("document_id") == document_id)

    def owner(self, document_id: str) -> str | None:
        """S14."""
        row = self.document(document_id).select("user_id").first()
        return row.user_id if row else None

    def documents(self, user_id: str | None = None) -> DataFrame:
        """Newest first."""
        rows = self.table("documents")
        return (rows if user_id is None else rows.filter(F.col("user_id") == user_id)).orderBy(F.desc("created_at"), "document_id")

    def delete_document(self, document_id: str, user_id: str | None = None) -> bool:
        """Vectors first, then the rows; false for a document of somebody else, or of nobody."""
        found = self.document(document_id).select("user_id").first()
        if found is None or (user_id is not None and found.user_id != user_id):
            return False
        for table in ("vectors", "chunks", "images", "documents"):
            if self.count(table, F.col("document_id") == document_id):
                self.replace(table, self.table(table).filter(F.col("document_id") != document_id))
        return True

    def add_message(self, rows: DataFrame) -> None:
        """Messages, and the time of the last one on their conversations."""
        self.append("messages", rows)
        self.replace("conversations", touched(self.table("conversations"), self.table("messages")))

    def delete_conversation(self, conv_id: str) -> None:
        """With its messages."""
        for table in ("messages", "conversations"):
            self.replace(table, self.table(table).filter(F.col("conv_id") != conv_id))


def tenant_chunks(chunks: DataFrame, documents: DataFrame, user_id=None, owner: str = "user_id") -> DataFrame:
    """Chunks of known documents, of one tenant if one is named."""
    known = documents if user_id is None else documents.filter(F.col(owner) == user_id)
    return chunks.join(known.select("document_id"), "document_id", "left_semi")


def touched(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with the time of their last message, where that is later."""
    last = messages.groupBy("conv_id").agg(F.max("created_at").alias("_last"))
    return conversations.join(last, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last")


def owned(df: DataFrame, user_id: str | None, owner: str = "user_id") -> DataFrame:
    """what a user may see; no user sees everything."""
    return df if user_id is None else df.filter(F.col(owner) == user_id)


def listing(documents: DataFrame) -> DataFrame:
    """the documents as lists show them."""
    return documents.select("document_id", "filename", "file_type", "total_chunks", "processing_date")


def preview(c: Column, size: int = 200) -> Column:
    """the beginning of a source's text."""
    return F.substring(c, 1, size)


def recent(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The ``k`` last rows."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def metadata_json(df: DataFrame, *columns: str) -> Column:
    """Columns as one JSON text; nulls are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def from_metadata(c: Column, ddl: str) -> Column:
    """JSON text as a struct; broken text is null."""
    return F.from_json(c, ddl)


def content_id(*parts: Column) -> Column:
    """An id from what a row holds, the same on every run."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def unexpired(tokens: DataFrame, now: Column) -> DataFrame:
    """Revoked tokens that still matter; a write drops the others."""
    return tokens.filter(F.col("expires_at") >= now)


def feedback_export(votes: DataFrame) -> DataFrame:
    """Votes as labelled claims: claim, evidence, label 1 for supported."""
    right = F.col("verdict") == "correct"
    return votes.select("claim", "evidence", F.when(right == ~F.col("flagged"), F.lit(1)).otherwise(F.lit(0)).alias("label"))


def run_key(settings: dict) -> str:
    """What a run's configuration comes to."""
    return json.dumps(settings, sort_keys=True, default=str)


def resume(questions: DataFrame, saved: DataFrame, settings: dict, key: str = "question_id") -> tuple[DataFrame, DataFrame]:
    """What is left to do, and what a run of the same configuration has done.

    saved: run, the key and results; rows of another configuration are ignored.
    """
    done = saved.filter(F.col("run") == run_key(settings))
    return questions.join(done.select(key), key, "left_anti"), done


def write_report(report: dict, path: str) -> None:
    """A summary as JSON text, by Spark's own file systems."""
    spark = SparkSession.getActiveSession()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(report, indent=2, ensure_ascii=False, sort_keys=True).encode()))
    out.close()


def latest(df: DataFrame, key: str, *order) -> DataFrame:
    """K3: keep one row a key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is missing."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def delete_cascade(key: str, ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """K6: the tables without the rows of the given keys."""
    return [t.join(ids.select(key).distinct(), key, "left_anti") for t in tables]


def history(messages: DataFrame, n: int = 6) -> DataFrame:
    """Each conversation's last n messages."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= n).drop("_n")


def context(messages: DataFrame, n: int = 6, each: int = 500, most: int = 4000) -> DataFrame:
    """The history as one text; long messages are cut, and what passes the limit is left out with all after it."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.when(F.length("text") > each, F.concat(F.substring("text", 1, each), F.lit("..."))).otherwise(F.col("text")))
    lines = history(messages, n).withColumn("line", line)
    so_far = Window.partitionBy("conv_id").orderBy("turn")
    kept = lines.withColumn("size", F.sum(F.length("line")).over(so_far)).filter(F.col("size") <= most)
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("context"))


def query_stats(log: DataFrame) -> DataFrame:
    """A4 on (seconds, confidence, results); confidence counts only over 0."""
    return log.agg(F.count("*").alias("total"), F.round(F.avg("seconds"), 3).alias("avg_seconds"), F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 3).alias("avg_confidence"), F.round(F.avg("results"), 1).alias("avg_results"))


def vote_hash(c: str):
    """The key of a claim, whatever its case and spacing."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")).cast("binary"), 256)


def latest_votes(votes: DataFrame) -> DataFrame:
    """A8 on (user_id, claim, verdict, flagged, created_at, vote_id): the first claim text, the last verdict."""
    at = F.struct("created_at", "vote_id")
    return votes.withColumn("claim_hash", vote_hash("claim")).groupBy("user_id", "claim_hash").agg(F.min_by("claim", at).alias("claim"), F.max_by("verdict", at).alias("verdict"), F.max_by("flagged", at).alias("flagged"))


def feedback_summary(votes: DataFrame) -> DataFrame:
    """A5: counts by kind and the precision of flags, null without reviews."""
    yes, flagged = F.col("verdict") == "correct", F.col("flagged")
    return votes.agg(F.count("*").alias("total"), F.count_if(flagged & yes).alias("flag_right"), F.count_if(flagged & ~yes).alias("flag_wrong"), F.count_if(~flagged & yes).alias("pass_right"), F.count_if(~flagged & ~yes).alias("pass_wrong")).withColumn("flag_precision", F.try_divide("flag_right", F.col("flag_right") + F.col("flag_wrong")))
