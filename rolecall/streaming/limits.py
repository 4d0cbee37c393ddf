"""Time windows and state: rate limits, life cycles, upserts.  Batch and streaming share the expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..operators.operations import latest
from ..sources import versions


def limited(requests: DataFrame, limits: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """Requests (ts, client, method, ord) with ``window_start``, ``n`` (place in the window) and
    ``rejected``; windows are aligned to the epoch and belong to one client and method."""
    parts = None
    for method, (limit, width) in (limits or C.RATE_LIMITS).items():
        some = requests.filter(F.col("method") == method).withColumn("window_start", F.window("ts", width)["start"])
        w = Window.partitionBy("client", "window_start").orderBy("ts", "ord")
        some = some.withColumn("n", F.row_number().over(w)).withColumn("rejected", F.col("n") > limit)
        parts = some if parts is None else parts.unionByName(some)
    return parts


def rejected_counts(requests: DataFrame, method: str, limits: dict[str, tuple[int, str]] | None = None, late: str = "2 minutes") -> DataFrame:
    """Streaming form: (client, window_start, n, rejected_n) of each closed window of a method.
    Requests later than ``late`` behind the newest are dropped, as the watermark says."""
    limit, width = (limits or C.RATE_LIMITS)[method]
    rows = requests.filter(F.col("method") == method)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    g = rows.groupBy(F.window("ts", width).alias("w"), "client").agg(F.count("*").alias("n"))
    return g.select("client", F.col("w.start").alias("window_start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected_n"))


#: Which state may follow which.
NEXT = {
    "document": {None: ["PENDING"], "PENDING": ["PROCESSING"], "PROCESSING": ["READY", "FAILED"]},
    "match": {None: ["PENDING"], "PENDING": ["RUNNING"], "RUNNING": ["SUCCEEDED", "FAILED"]},
}


def allowed(before: Column, after: Column, kind: str = "document") -> Column:
    ok = F.lit(False)
    for a, some in NEXT[kind].items():
        ok = ok | ((before.isNull() if a is None else before == a) & after.isin(some))
    return ok


def transitions(changes: DataFrame, kind: str = "document") -> DataFrame:
    """State changes (id, ord, state) with the one before and whether it may follow."""
    w = Window.partitionBy("id").orderBy("ord")
    rows = changes.withColumn("before", F.lag("state").over(w))
    return rows.withColumn("allowed", F.coalesce(allowed(F.col("before"), F.col("state"), kind), F.lit(False)))


def merge_batch(path: str, key: list[str], order: str, buckets: int = 64):
    """A foreachBatch function: the keyed table at ``path`` (``versions.merged``) holds the latest row of each key.

    A batch rewrites only the parts of the table that its keys fall into, and one that
    is run again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        versions.merge(batch, path, number, key, lambda rows: latest(rows, key, [order]), buckets)

    return write
