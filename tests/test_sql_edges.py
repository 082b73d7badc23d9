"""Registered queries against their SQL on small tables with what the generated tables seldom hold."""

import datetime as dt
import random

import duckdb
from test_queries import rows

import __spark_entry__ as entry
from corpusloom.operators import retrieval as R


def both(spark, folder, name, **tables):
    """A query's rows and those of its SQL over these tables."""
    duck = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    expected = duck.sql(entry.oracle_sql()[name])
    return rows(got.columns, got.collect()), rows(expected.columns, expected.fetchall())


def test_evidence_paragraphs_lengths(spark, tmp_path):
    """Lines of 20 and 21 characters some of which a case folding or compatibility form makes longer or shorter."""
    lines = ["Zu und. Dieüauß der.", "Zu und. Dieüauß der..", "a" * 18 + "ﬁ.", "a" * 18 + "ﬁ..", "İ" * 20, "İ" * 21, "é" * 11, "x" * 20 + "\xa0", "ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ ΟΔΟΣ", "‘quoted’ — with “dashes”", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕ"]
    docs = spark.createDataFrame([*enumerate(lines), (20, "Straßenecke am Marktplatz\nstrassenecke am marktplatz"), (21, None), (22, "")], "doc_id long, text string")
    got, expected = both(spark, tmp_path, "evidence_paragraphs", documents=docs)
    assert got == expected and len(got) == 9


def test_rate_limited_fractions(spark, tmp_path):
    """Windows that end within the second in which a request comes."""
    base = dt.datetime(2024, 1, 1, 0, 0, 10)
    after = [[0.4, 86410.3, 86410.6, 86411], [0.6, 86400.5, 86400.7, 86401.4], [0.5, 1, 86400.4, 86400.5, 86401.5], [1.5, 2, 86401.4, 86401.5, 86402.5]]
    events = [(u, base + dt.timedelta(seconds=s)) for u, times in enumerate(after) for s in times] + [(None, base), (9, None)]
    table = spark.createDataFrame(events, "user_id long, ts timestamp_ntz")
    got, expected = both(spark, tmp_path, "rate_limited", events=table)
    assert got == expected


def test_scores_of_equal_bags(spark):
    """Chunks of the same words in another order tie exactly, so fusion keeps them in the order of their ids."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(30) for _ in range(1 + k % 4)]
    bags = [(k, " ".join(r.sample(words, len(words)))) for k in range(40)] + [(k, " ".join(f"x{r.randrange(60)}" for _ in range(50))) for k in range(40, 140)]
    chunks = spark.createDataFrame(bags, "chunk_id long, text string").repartition(4)
    asked = spark.createDataFrame([(0, " ".join(words))], "query_id long, text string")
    scores = {x.chunk_id: x.score for x in R.bm25_scores(asked, chunks, R.bm25_index(chunks)).collect()}
    assert len({scores[k] for k in range(40)}) == 1 and scores[0] > 0
    lexical = R.bm25(asked, chunks, 40)
    none = lexical.limit(0)
    fused = R.fuse(none, lexical, 40).orderBy("rank").collect()
    own = [x.chunk_id for x in fused if x.chunk_id < 40]
    assert own == sorted(own) and len(own) > 1
