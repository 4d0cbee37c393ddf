"""Bundles whose files and digest depend on the rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import numbered


def bundled(rows: DataFrame, order: list[str], size: int = 100_000) -> DataFrame:
    """(part, rows, sha256, lines): ``rows`` as sorted JSON lines in parts of ``size``, each with its digest.

    A row's part is its place in the order of ``order`` and then of its whole line, divided
    by ``size``: it depends neither on the partitioning nor on how the rows arrived.
    Keys of a line stand in order, nulls are written.
    """
    line = F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))), {"ignoreNullFields": "false"})
    placed = numbered(rows.select(*order, line.alias("_line")), [], [*order, "_line"])
    parts = placed.select(F.floor(F.col("place") / size).alias("part"), "place", "_line").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "_line"))).alias("l"))
    lines = F.transform("l", lambda x: x["_line"])
    return parts.select("part", F.size("l").alias("rows"), F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("sha256"), lines.alias("lines"))


def manifest(parts: DataFrame) -> DataFrame:
    """(parts, rows, sha256): the digest over the digests of all parts in order."""
    each = F.array_sort(F.collect_list(F.struct("part", "rows", "sha256")))
    text = F.array_join(F.transform(F.col("m"), lambda p: F.concat_ws(":", p["part"].cast("string"), p["rows"].cast("string"), p["sha256"])), ";")
    return parts.agg(each.alias("m")).select(F.size("m").alias("parts"), F.aggregate("m", F.lit(0).cast("long"), lambda a, p: a + p["rows"]).alias("rows"), F.sha2(text, 256).alias("sha256"))


def write_bundle(rows: DataFrame, order: list[str], folder: str, size: int = 100_000) -> str:
    """Write the parts (one directory each) and the manifest; returns the digest."""
    parts = bundled(rows, order, size)
    parts.select("part", F.posexplode("lines").alias("k", "value")).repartition("part").sortWithinPartitions("part", "k").select("part", "value").write.partitionBy("part").text(f"{folder}/parts")
    whole = manifest(parts)
    whole.coalesce(1).write.json(f"{folder}/manifest")
    return whole.first()["sha256"]


def verify_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """(part, sha256): digests of the parts as they are on disk, in the form that ``bundled`` gives."""
    lines = spark.read.text(f"{folder}/parts").withColumn("k", F.monotonically_increasing_id())
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), "\n")
    return lines.groupBy(F.col("part").cast("long").alias("part")).agg(F.sha2(F.concat(whole, F.lit("\n")), 256).alias("sha256"))
