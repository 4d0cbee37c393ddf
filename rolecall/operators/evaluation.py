"""Evaluation: confusion, precision and recall, sweeps, grids, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.lineage import numbered

CLASSES = ("strong", "possible", "no")


def confusion(predictions: DataFrame, gold: DataFrame, key: list[str], by: list[str] | None = None, classes: tuple = CLASSES) -> DataFrame:
    """(by..., gold, predicted, n) for every pair of classes, zeros too, over keys on both sides."""
    by = by or []
    rows = predictions.join(gold, key).groupBy(*by, "gold", "predicted").agg(F.count("*").alias("n"))
    pairs = F.explode(F.array(*(F.struct(F.lit(g).alias("gold"), F.lit(p).alias("predicted")) for g in classes for p in classes))).alias("p")
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    every = groups.select(*by, pairs).select(*by, "p.gold", "p.predicted")
    return every.join(rows, [*by, "gold", "predicted"], "left").fillna(0, ["n"])


def class_metrics(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., class, support, precision, recall, f1) of a confusion matrix; nothing of nothing is 0."""
    by = by or []
    long = matrix.select(*by, F.explode(F.array(F.struct(F.col("gold").alias("class"), F.lit(True).alias("is_gold")), F.struct(F.col("predicted").alias("class"), F.lit(False).alias("is_gold")))).alias("s"), "gold", "predicted", "n")
    g = long.groupBy(*by, "s.class").agg(
        F.sum(F.when(F.col("s.is_gold"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("s.is_gold"), F.col("n")).otherwise(0)).alias("predicted_n"),
        F.sum(F.when(F.col("s.is_gold") & (F.col("gold") == F.col("predicted")), F.col("n")).otherwise(0)).alias("hit"),
    )
    p, r = scores.ratio(F.col("hit"), F.col("predicted_n")), scores.ratio(F.col("hit"), F.col("support"))
    return g.select(*by, "class", "support", "predicted_n", "hit", p.alias("precision"), r.alias("recall"), scores.f1(p, r).alias("f1"))


def summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro, weighted and balanced figures of class metrics."""
    total = F.sum("support")
    return metrics.groupBy(*(by or [])).agg(
        F.avg("f1").alias("macro_f1"),
        scores.ratio(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"),
        scores.ratio(F.sum("hit"), total).alias("accuracy"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
    )


def guards(metrics: DataFrame, by: list[str], floor: float = 0.1) -> DataFrame:
    """Which guards a combination fails: a class never predicted, precision or recall under a floor."""
    return metrics.groupBy(*by).agg(
        F.array_sort(
            F.array_distinct(
                F.filter(
                    F.flatten(F.collect_list(F.array(F.when(F.col("predicted_n") == 0, "all_classes_predicted"), F.when(F.col("precision") < floor, "precision_floor"), F.when(F.col("recall") < floor, "recall_floor")))),
                    lambda x: x.isNotNull(),
                )
            )
        ).alias("failed")
    )


def swept(rows: DataFrame, score: str, gold: Column, thresholds: list[float]) -> DataFrame:
    """Precision, recall, F1 of ``score >= threshold`` for each threshold, in one pass: rows are
    counted by how many thresholds they reach, and counts are summed from the top."""
    reach = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in thresholds[1:]), F.when(F.col(score) >= thresholds[0], 1).otherwise(0))
    g = rows.select(reach.alias("reach"), gold.cast("int").alias("g")).groupBy("reach").agg(F.sum("g").alias("pos"), F.count("*").alias("n"))
    spark = rows.sparkSession
    grid = spark.createDataFrame([(float(t), k + 1) for k, t in enumerate(sorted(thresholds))], "threshold double, k int")
    totals = g.join(F.broadcast(grid), F.col("reach") >= F.col("k")).groupBy("threshold").agg(F.sum("pos").alias("tp"), F.sum("n").alias("predicted"))
    positives = g.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"))
    out = grid.select("threshold").join(totals, "threshold", "left").fillna(0).crossJoin(F.broadcast(positives))
    p, r = scores.ratio(F.col("tp"), F.col("predicted")), scores.ratio(F.col("tp"), F.col("positives"))
    return out.select("threshold", F.col("tp").cast("long").alias("tp"), F.col("predicted").cast("long").alias("predicted"), p.alias("precision"), r.alias("recall"), scores.f1(p, r).alias("f1"))


def percentiles(rows: DataFrame, value: str, by: list[str], at: tuple = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Linearly interpolated percentiles of a value in each group; nulls are left out.

    Values are numbered in order by range partitions, and only the two beside each
    percentile travel on, so no task holds a group.
    """
    names = [f"p{round(a * 100)}" for a in at]
    g = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    each = numbered(rows.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null"), by, ["_v"])
    spot = lambda a: (F.col("size") - 1) * F.lit(a)
    near = each.filter(F.exists(F.array(*(spot(a) for a in at)), lambda s: (F.col("place") == F.floor(s)) | (F.col("place") == F.ceil(s))))
    side = lambda a, f: F.max(F.when(F.col("place") == f(spot(a)), F.col("_v")))
    part = lambda a: F.max(spot(a) - F.floor(spot(a)))
    found = near.groupBy(F.struct(F.lit(0).alias("_"), *by).alias("_g")).agg(*(((1 - part(a)) * side(a, F.floor) + part(a) * side(a, F.ceil)).alias(n) for a, n in zip(at, names)))
    return g.join(found, F.struct(F.lit(0).alias("_"), *by).eqNullSafe(F.col("_g")), "left").drop("_g")


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n): half-open bins by edges; what lies outside goes to the last bin."""
    c = F.when(F.lit(False), 0)
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        c = c.when((F.col(value) >= a) & (F.col(value) < b), k)
    return rows.groupBy(c.otherwise(len(edges) - 2).alias("bin")).agg(F.count("*").alias("n"))


def breakdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, agreement, score figures, and rows and hits of each gold class for each key alone and for all, in one
    pass of grouping sets."""
    g = cells.groupingSets([[k] for k in keys] + [[]], *keys)
    same = F.col("gold") == F.col("predicted")
    split = [x for c in CLASSES for x in (F.count(F.when(F.col("gold") == c, 1)).alias(f"gold_{c}"), F.count(F.when((F.col("gold") == c) & same, 1)).alias(f"hit_{c}"))]
    return g.agg(F.count("*").alias("n"), F.count(F.when(same, 1)).alias("agree"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), *split)


def composition(gold: DataFrame, row: str, classes: tuple = CLASSES) -> DataFrame:
    """Counts of each class for each row and over all (rollup)."""
    return gold.rollup(row).agg(*(F.count(F.when(F.col("gold") == c, 1)).alias(c) for c in classes))


def retrieval(ranks: DataFrame, k: int = 10) -> DataFrame:
    """MRR@k and accuracy@1/5/k of the rank of each query's one relevant item (null: not found)."""
    hit = lambda n: F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0))
    return ranks.agg(F.avg(F.when(F.col("rank") <= k, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"), hit(1).alias("acc_1"), hit(5).alias("acc_5"), hit(k).alias("acc_k"), F.count("*").alias("queries"))


def peak(curve: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Where a curve peaks, whether it never falls (1e-9 slack) and how far it ends below its peak."""
    w = Window.partitionBy(*by).orderBy(x)
    rows = curve.withColumn("up", F.coalesce(F.col(y) >= F.lag(y).over(w) - 1e-9, F.lit(True)))
    return rows.groupBy(*by).agg(
        F.max_by(x, F.struct(F.col(y), -F.col(x).cast("long"))).alias("peak_x"), F.max(y).alias("peak"), F.bool_and("up").alias("monotone"), (F.max(y) - F.max_by(y, x)).alias("gap")
    )
