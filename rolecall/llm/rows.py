"""Helpers shared by the operators: row keys, and columns under names of our own."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many narrow rows (some 20 MB) are broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, text): only the columns an operator reads, so extra columns
    with any name never clash.  ``th`` hashes the text: two rows with one
    (doc_id, th) are repeats of each other and get one result each."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("th"),
        F.col(f"`{text_col}`").alias("text"),
    )


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on (doc_id, th); null ids equal null ids."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def row_condition(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """As ``same_row``, from a table of documents to rows of keys."""
    return docs[f"`{id_col}`"].cast("long").eqNullSafe(keys["doc_id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == keys["th"])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.
    Only a local session may go without one, and gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder; the session's own setting comes first.
    A collection on the driver then lets Spark's cleaner drop the shuffle files of
    the lineage that was cut, which would stay on executors' disks until some later one."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    sc._jvm.System.gc()
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again: lineage is cut as by
    ``checkpointed``, in columns and compressed, which suits long narrow tables.
    The table goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function for tasks that gives ``value``, broadcast with the code of its class, so that
    executors need not have this package.  Each worker unpacks it once, at its first use."""
    box = spark.sparkContext.broadcast([cloudpickle.dumps(value)])

    def given() -> Any:
        if isinstance(box.value[0], bytes):
            box.value[0] = pickle.loads(box.value[0])
        return box.value[0]

    return given


def few(rows: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """``rows`` marked for broadcast if they are counted to be at most ``most``, with at most
    ``most_bytes`` of text, else None: the caller then joins in another way."""
    texts = [F.sum(F.octet_length(F.col(quoted(c)))) for c, kind in rows.dtypes if kind in ("string", "binary")]
    count, *sizes = rows.agg(F.count("*"), *texts).first()
    return F.broadcast(rows) if count <= most and sum(x or 0 for x in sizes) <= most_bytes else None
