"""Versioned tables: snapshots that one rename puts in force.

``folder`` holds a directory for each version and ``current``, a small file that names
the version in force and what it was built from.  A version is written whole
before ``current`` is replaced, so readers see the old one until then and the new
one after; a version that is never put in force is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Busy(RuntimeError):
    """Another writer holds the folder."""


def _files(spark: SparkSession, folder: str):
    """The folder's file context, and a function from names in it to paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}" if name else folder)
    root = path("").getFileSystem(conf).makeQualified(path(""))
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf), root.getFileSystem(conf), path


def current(spark: SparkSession, folder: str) -> dict | None:
    """The manifest in force: version, rows, and the key it was built for; None if there is none."""
    _, fs, path = _files(spark, folder)
    if not fs.exists(path("current")):
        return None
    return json.loads(spark.read.text(f"{folder}/current", wholetext=True).first()[0])


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The version in force when this is called; a later one does not change it."""
    now = current(spark, folder)
    if now is None:
        raise FileNotFoundError(f"{folder} has no version in force")
    return spark.read.parquet(f"{folder}/{now['version']}")


@contextmanager
def writing(spark: SparkSession, folder: str) -> Iterator[None]:
    """The folder's only writer; ``Busy`` while there is another."""
    _, fs, path = _files(spark, folder)
    fs.mkdirs(path(""))
    if not fs.createNewFile(path("writer")):
        raise Busy(f"{folder}/writer exists: another writer is at work, or one was killed")
    try:
        yield
    finally:
        fs.delete(path("writer"), False)


def put_in_force(spark: SparkSession, folder: str, made: dict) -> None:
    """Replace the manifest in force by one rename."""
    context, fs, path = _files(spark, folder)
    name = f"next-{uuid.uuid4().hex}"
    out = fs.create(path(name))
    out.write(bytearray(json.dumps(made, sort_keys=True).encode()))
    out.close()
    gateway = spark.sparkContext._gateway
    rename = gateway.jvm.org.apache.hadoop.fs.Options.Rename
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(path(name), path("current"), how)


def publish(rows: DataFrame, folder: str, key: dict[str, str]) -> dict:
    """Write ``rows`` as a new version and put it in force.  While another writer is at work this
    raises ``Busy``.  A failure leaves the version in force as it was."""
    spark = rows.sparkSession
    with writing(spark, folder):
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{folder}/{version}")
        made = {"version": version, "rows": spark.read.parquet(f"{folder}/{version}").count(), "key": key}
        put_in_force(spark, folder, made)
        return made


def get_or_build(spark: SparkSession, folder: str, key: dict[str, str], build: Callable[[], DataFrame]) -> DataFrame:
    """The version in force if it was built for ``key``, else a new one from ``build``."""
    now = current(spark, folder)
    if now is None or now["key"] != key:
        publish(build(), folder, key)
    return load(spark, folder)


def merge(batch: DataFrame, folder: str, number: int, key: list[str], newest: Callable[[DataFrame], DataFrame], buckets: int = 64) -> bool:
    """Fold a batch into a keyed table of ``buckets`` parts; False if batch ``number`` is in it already.

    Only the parts that the batch touches are read and written anew, then one manifest
    that names the version of every part is put in force, with the batch's number: a
    batch that is run again, after a failure or in another attempt, changes nothing.
    ``newest`` keeps one row of each key.
    """
    spark = batch.sparkSession
    with writing(spark, folder):
        now = current(spark, folder) or {"batch": -1, "parts": {}}
        if number <= now["batch"]:
            return False
        rows = batch.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select("_part").distinct().collect()]  # as many as there are parts at most
        old = [f"{folder}/{now['parts'][str(p)]}/_part={p}" for p in touched if str(p) in now["parts"]]
        both = batch.unionByName(spark.read.schema(batch.schema).parquet(*old)) if old else batch
        version = f"v-{uuid.uuid4().hex}"
        merged = newest(both).withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        merged.write.partitionBy("_part").parquet(f"{folder}/{version}")
        put_in_force(spark, folder, {"batch": number, "parts": now["parts"] | {str(p): version for p in touched}})
        return True


def merged(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The keyed table as the manifest in force has it."""
    parts = (current(spark, folder) or {"parts": {}})["parts"]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{folder}/{v}/_part={p}" for p, v in parts.items()))


def clean(spark: SparkSession, folder: str) -> list[str]:
    """Delete versions that are not in force; for times without readers of old ones."""
    _, fs, path = _files(spark, folder)
    now = current(spark, folder) or {}
    live = {now.get("version"), *now.get("parts", {}).values()}
    names = [s.getPath().getName() for s in fs.listStatus(path(""))]
    old = [n for n in names if n.startswith("next-") or n.startswith("v-") and n not in live]
    for name in old:
        fs.delete(path(name), True)
    return sorted(old)
