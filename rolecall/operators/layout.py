"""Page layout: where a page has two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 20
ZONE = (0.2, 0.8)


def column_gaps(words: DataFrame, gap_ratio: float = 0.1, min_words: int = 10) -> DataFrame:
    """(page, gap_start, gap_end) of pages with one wide empty strip inside and in the middle zone.

    ``words``: page, x (left edge), width (of the page).  Words are counted by bin
    first, so a window sees at most 20 rows of a page; an empty strip is what lies
    between two occupied bins.
    """
    bins = words.filter("width > 0 and x is not null").groupBy("page", "width", F.least(F.floor(F.col("x") / (F.col("width") / BINS)), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"))
    page = Window.partitionBy("page", "width")
    rows = bins.withColumn("words", F.sum("n").over(page)).withColumn("before", F.lag("bin").over(page.orderBy("bin")))
    least = max(1, round(gap_ratio * BINS))
    lo, hi = int(ZONE[0] * BINS), int(ZONE[1] * BINS)
    gaps = rows.filter((F.col("words") >= min_words) & (F.col("bin") - F.col("before") - 1 >= least) & (F.col("before") + 1 < hi) & (F.col("bin") - 1 >= lo))
    step = F.col("width") / BINS
    one = gaps.groupBy("page", "width").agg(F.count("*").alias("gaps"), F.min("before").alias("before"), F.max("bin").alias("bin")).filter("gaps = 1")
    return one.select("page", F.greatest((F.col("before") + 1) * step, ZONE[0] * F.col("width")).alias("gap_start"), F.least(F.col("bin") * step, ZONE[1] * F.col("width")).alias("gap_end"), "width")


def column_ranges(gaps: DataFrame) -> DataFrame:
    """(page, left, right): the two x-ranges beside a gap."""
    part = lambda a, b: F.struct(F.col(a).alias("from") if isinstance(a, str) else a.alias("from"), F.col(b).alias("to"))
    return gaps.select("page", part(F.lit(0.0), "gap_start").alias("left"), part("gap_end", "width").alias("right"))
