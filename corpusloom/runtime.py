"""Session-level helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", None) == sc.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(), "corpusloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("corpusloom", os.path.relpath(full, here)))
    sc.addPyFile(target)
    sc._corpusloom_shipped = sc.applicationId


_written: list[tuple[object, str]] = []
#: What is kept for a session between queries; it goes with the tables.
kept: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and everything
    runs in one process (as in local tests) a local folder is chosen, set, and removed at the end.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    What is written stays until ``release_tables``, since results are read from it later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession) -> int:
    """Delete what this session has materialised; results that were made from it must have been written or collected."""
    own = [path for session, path in _written if session is spark]
    for path in own:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written[:] = [x for x in _written if x[0] is not spark]
    kept.clear()
    return len(own)


def state_of(df: DataFrame) -> tuple:
    """The files that a table is read from, with their sizes and times: equal as long as they hold the same."""
    spark = df.sparkSession
    conf, out = spark._jsc.hadoopConfiguration(), []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return (spark.sparkContext.applicationId, *out)
