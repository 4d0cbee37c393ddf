"""Search for thresholds: scores of many settings, a cumulative confusion cube, guards and winners."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scores
from ..functions.lineage import cut
from .evaluation import CLASSES


def regraded(factors: DataFrame, gates: list[float], weights: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, gate, weight, cv_id, jd_id, score): the overall score of each pair under each setting.

    ``factors``: *by, cv_id, jd_id, importance, req_conf, cand_conf, uri_sim.  Sums for all
    gates come from one grouping; weights only mix them.
    """
    p, req = F.col("req_conf") * F.col("cand_conf") * F.col("uri_sim"), F.col("importance") == "required"
    total = lambda c: F.coalesce(F.sum(F.when(c, p)), F.lit(0.0))
    sums = F.array(*(F.struct(F.lit(float(g)).alias("gate"), total((p >= g) & req).alias("rs"), total((p >= g) & ~req).alias("ns")) for g in gates))
    g = factors.groupBy(*by, "cv_id", "jd_id").agg(F.count(F.when(req, 1)).alias("rt"), F.count(F.when(~req, 1)).alias("nt"), sums.alias("sums"))
    g = g.select(*by, "cv_id", "jd_id", "rt", "nt", F.inline("sums")).withColumn("weight", F.explode(F.array(*(F.lit(float(w)) for w in weights))))
    r, s = scores.ratio(F.col("rs"), F.col("rt")), scores.ratio(F.col("ns"), F.col("nt"))
    score = F.when(F.col("rt") > 0, F.col("weight") * r + (1 - F.col("weight")) * s).otherwise(s)
    return g.select(*by, "gate", "weight", "cv_id", "jd_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def _reached(score: Column, edges: list[float], low: int = 0) -> Column:
    """How many of the sorted edges a score reaches, by halving."""
    if not edges:
        return F.lit(low)
    m = len(edges) // 2
    return F.when(score >= edges[m], _reached(score, edges[m + 1 :], low + m + 1)).otherwise(_reached(score, edges[:m], low))


def confusion_cube(scored: DataFrame, by: list[str], edges: list[float]) -> DataFrame:
    """(*by, k, strong, possible, no, none): rows of each gold class (``none`` without one) whose
    score reaches the k-th of the sorted edges; k = 0 counts all.

    Scores are counted by how many edges they reach, so nothing grows with the number of
    distinct scores, and the counts are summed from the top once.
    """
    names = [*CLASSES, "none"]
    kind = F.when(F.col("gold").isin(*CLASSES), F.col("gold")).otherwise("none")
    counts = scored.groupBy(*by, _reached(F.col("score"), edges).alias("k")).agg(*(F.count(F.when(kind == c, 1)).alias(c) for c in names))
    counts = cut(counts)  # a row for each setting and edge: the scores behind them are read once, however often the cube is
    every = counts.select(*by).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(edges)))))
    w = Window.partitionBy(*by).orderBy(F.desc("k"))  # as many rows as edges
    return every.join(counts, [*by, "k"], "left").select(*by, "k", *(F.sum(F.coalesce(c, F.lit(0))).over(w).alias(c) for c in names))


def combinations(scored: DataFrame, by: list[str], grid: list[tuple[float, float]], precision_floor: float = 0.05, recall_floor: float = 0.05, relaxed_floor: float = 1e-9) -> DataFrame:
    """Every setting ``by`` with every pair (t1, t2) of ``grid``: macro_f1, weighted_f1, accuracy,
    balanced_accuracy, precision, recall and F1 of each class, ``failed`` and ``failed_relaxed`` (names of guards).

    ``scored``: *by, score, gold (null where there is no judgment: such rows count only in the guard of
    score buckets).  Predictions are read from the cube as differences of two rows.
    """
    edges = sorted({t for pair in grid for t in pair})
    place = {t: k + 1 for k, t in enumerate(edges)}
    spark = scored.sparkSession
    table = spark.createDataFrame([(float(a), float(b), place[a], place[b]) for a, b in grid], "t1 double, t2 double, k1 int, k2 int")
    cube = confusion_cube(scored, by, edges)
    side = lambda name: cube.select(*by, F.col("k").alias(f"k{name}"), *(F.col(c).alias(f"{c}{name}") for c in (*CLASSES, "none")))
    rows = side(1).join(F.broadcast(table), "k1").join(side(2), [*by, "k2"]).join(side(0).filter("k0 = 0"), by)
    at = {}
    for g in (*CLASSES, "none"):
        low = F.greatest(f"{g}1", f"{g}2")
        at[g] = {"strong": F.col(f"{g}1"), "possible": low - F.col(f"{g}1"), "no": F.col(f"{g}0") - low}
    predicted = {p: sum((at[g][p] for g in CLASSES[1:]), at[CLASSES[0]][p]) for p in CLASSES}
    support = {g: F.col(f"{g}0") for g in CLASSES}
    rows = rows.select(
        *by, "t1", "t2", *(at[c][c].alias(f"hit_{c}") for c in CLASSES), *(predicted[c].alias(f"predicted_{c}") for c in CLASSES), *(support[c].alias(f"support_{c}") for c in CLASSES),
        F.least(*(predicted[c] + at["none"][c] for c in CLASSES)).alias("bucket"),
    )
    for c in CLASSES:
        rows = rows.withColumns({f"precision_{c}": scores.ratio(F.col(f"hit_{c}"), F.col(f"predicted_{c}")), f"recall_{c}": scores.ratio(F.col(f"hit_{c}"), F.col(f"support_{c}"))})
        rows = rows.withColumn(f"f1_{c}", scores.f1(F.col(f"precision_{c}"), F.col(f"recall_{c}")))
    add = lambda name, *times: sum((F.col(f"{name}_{c}") * (F.col(f"{times[0]}_{c}") if times else 1) for c in CLASSES), F.lit(0))
    judged = add("support")
    there = sum((F.when(F.col(f"support_{c}") > 0, 1).otherwise(0) for c in CLASSES), F.lit(0))

    def failed(floor_p: float, floor_r: float, buckets: bool) -> Column:
        tests = [
            F.when(F.col("t2") >= F.col("t1"), "t2_lt_t1"),
            F.when(F.least(*(F.col(f"predicted_{c}") for c in CLASSES)) == 0, "all_three_classes_predicted"),
            *(F.when(F.col(f"{m}_{c}") < f, f"{m}_floor_{c}") for c in CLASSES for m, f in (("precision", floor_p), ("recall", floor_r))),
        ]
        if buckets:
            tests.append(F.when(F.col("bucket") == 0, "score_buckets_non_empty"))
        return F.array_compact(F.array(*tests))

    return rows.withColumns({
        "macro_f1": add("f1") / 3, "weighted_f1": scores.ratio(add("f1", "support"), judged), "accuracy": scores.ratio(add("hit"), judged), "balanced_accuracy": scores.ratio(add("recall"), there),
        "failed": failed(precision_floor, recall_floor, True), "failed_relaxed": failed(relaxed_floor, relaxed_floor, False),
    })


def winners(found: DataFrame, by: list[str], objective: str = "macro_f1") -> DataFrame:
    """The best combination under all guards (``strict``), under the relaxed ones and under none, ties to the
    smaller settings; a kind that nothing passes has no row."""
    key = F.struct(-F.round(objective, 9), *by, "t1", "t2")
    best = lambda ok: F.min_by(F.struct(*found.columns), F.when(ok, key))
    kinds = {"strict": F.size("failed") == 0, "relaxed": F.size("failed_relaxed") == 0, "unguarded": F.lit(True)}
    one = found.agg(*(best(ok).alias(k) for k, ok in kinds.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("c")) for k in kinds))).alias("w")).select("w.kind", "w.c.*").filter("t1 is not null")


def grid_search(scored: DataFrame, pairs: list[tuple[float, float]]) -> DataFrame:
    """(t1, t2, macro_f1, accuracy, rank) of every pair of thresholds over (score, gold), best first."""
    found = combinations(scored.withColumn("run", F.lit(0)), ["run"], pairs)
    w = Window.orderBy(F.round("macro_f1", 9).desc(), "t1", "t2")  # over the pairs alone
    return found.select("t1", "t2", "macro_f1", "accuracy", F.row_number().over(w).alias("rank"))


def grid(first: list[float], second: list[float]) -> list[tuple[float, float]]:
    """Every (t1, t2) with t2 < t1."""
    return [(a, b) for a, b in product(first, second) if b < a]


#: Settings in force.
DEFAULT = {"gate": C.REQUIREMENT_GATE, "weight": C.REQUIRED_WEIGHT, "t1": C.T1, "t2": C.T2}
