"""The folder that driver and executors share, and cutting the lineage of loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Only a local session may go without one, and
    gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` checkpointed in the shared folder."""
    sc = rows.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0) in an order within their group, and its ``size``.

    Rows are range-partitioned by group and order and counted by partition, so a group
    of most rows is ranked by many tasks; at most one count for each group and
    partition is summed up.
    """
    keys = [*by, *order]
    at = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    group = F.struct(F.lit(0).alias("_"), *by)
    parts = at.groupBy(group.alias("_g"), "_part").agg(F.min("_at").alias("_lo"), F.count("*").alias("_n"))
    w = Window.partitionBy("_g")
    parts = parts.select("_g", F.col("_part").alias("_p"), "_lo", (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("size"))
    met = at.join(parts, group.eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("place", F.col("_at") - F.col("_lo") + F.col("_before")).drop("_at", "_part", "_g", "_p", "_lo", "_before")
