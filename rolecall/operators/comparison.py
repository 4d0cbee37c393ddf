"""Requirement lists, predictors against gold, comparison of runs, and changes by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .lexical import beside_text


def requirement_list(candidates: DataFrame) -> DataFrame:
    """Candidates (jd_id, skill_uri, label, confidence, source, ord) as an editable list: dropped ones
    go, one row for each concept (highest confidence, then first), placed by confidence and label."""
    kept = candidates.filter("source <> 'lexical_dropped'")
    best = kept.groupBy("jd_id", "skill_uri").agg(F.max_by(F.struct("label", "confidence"), F.struct(F.col("confidence"), -F.col("ord"))).alias("c"))
    rows = best.select("jd_id", "skill_uri", "c.label", "c.confidence")
    place = Window.partitionBy("jd_id").orderBy(F.desc("confidence"), F.lower("label"), "skill_uri")
    return rows.withColumn("place", F.row_number().over(place))


def judged(gold: DataFrame, cvs: DataFrame, jds: DataFrame) -> DataFrame:
    """Gold cells (cv_id, jd_id) with a status: scored, or skipped as NO_CV or NO_JD."""
    c = cvs.select("cv_id", F.lit(True).alias("has_cv")).distinct()
    j = jds.select("jd_id", F.lit(True).alias("has_jd")).distinct()
    status = F.when(F.col("has_cv").isNull(), "NO_CV").when(F.col("has_jd").isNull(), "NO_JD").otherwise("scored")
    return gold.join(c, "cv_id", "left").join(j, "jd_id", "left").withColumn("status", status).drop("has_cv", "has_jd")


def outcomes(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(cv_id, predictor, uri, outcome): tp and fp of every predictor, and what each of them misses of
    the gold set (fn).  ``predicted``: cv_id, predictor, uri; ``gold``: cv_id, uri."""
    g = gold.select("cv_id", "uri").distinct()
    p = predicted.select("cv_id", "predictor", "uri").distinct()
    hit = p.join(g.withColumn("in_gold", F.lit(True)), ["cv_id", "uri"], "left").select("cv_id", "predictor", "uri", F.when(F.col("in_gold"), "tp").otherwise("fp").alias("outcome"))
    wanted = g.join(F.broadcast(p.select("predictor").distinct()), F.lit(True))  # a few names
    missed = wanted.join(p, ["cv_id", "predictor", "uri"], "left_anti").select("cv_id", "predictor", "uri", F.lit("fn").alias("outcome"))
    return hit.unionByName(missed)


def views(results: DataFrame) -> DataFrame:
    """(predictor, documents, macro_p, macro_r, macro_f1, micro_p, micro_r, micro_f1) of outcomes."""
    n = lambda k: F.count(F.when(F.col("outcome") == k, 1)).alias(k)
    per = results.groupBy("predictor", "cv_id").agg(n("tp"), n("fp"), n("fn"))
    p, r = scores.ratio(F.col("tp"), F.col("tp") + F.col("fp")), scores.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    g = per.select("predictor", "tp", "fp", "fn", p.alias("p"), r.alias("r"), scores.f1(p, r).alias("f")).groupBy("predictor").agg(
        F.count("*").alias("documents"), F.avg("p").alias("macro_p"), F.avg("r").alias("macro_r"), F.avg("f").alias("macro_f1"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))
    )
    p, r = scores.ratio(F.col("tp"), F.col("tp") + F.col("fp")), scores.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select("predictor", "documents", "macro_p", "macro_r", "macro_f1", p.alias("micro_p"), r.alias("micro_r"), scores.f1(p, r).alias("micro_f1"))


def deltas(before: DataFrame, after: DataFrame, key: str, value: str, win: float = 0.10, loss: float = -0.05) -> DataFrame:
    """(key, before, after, delta, verdict) of two runs; what a run lacks counts as 0."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer").fillna(0.0, ["before", "after"])
    both = both.withColumn("delta", F.round(F.col("after") - F.col("before"), 9))
    return both.withColumn("verdict", F.when(F.col("delta") >= win, "win").when(F.col("delta") < loss, "regression").otherwise("same"))


def attributed(rows: DataFrame, flag: Column) -> DataFrame:
    """(flag, n, mean_delta, improved): how far a change follows a property of its rows."""
    return rows.groupBy(flag.alias("flag")).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.count(F.when(F.col("delta") > 0, 1)).alias("improved"))


def counters(rows: DataFrame, by: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """One column of counts for each kind, zeros too, and ``other`` for the rest."""
    known = F.coalesce(F.col(kind).isin(*kinds), F.lit(False))
    return rows.groupBy(*by).agg(*(F.count(F.when(F.col(kind) == k, 1)).alias(k) for k in kinds), F.count(F.when(~known, 1)).alias("other"))


def mismatches(rows: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """(by..., counted, stored) where the counts of ``rows`` differ from the stored ``n``; a lacking side is 0."""
    g = rows.groupBy(*by).agg(F.count("*").alias("counted"))
    both = g.join(totals.select(*by, F.col("n").alias("stored")), by, "full_outer").fillna(0, ["counted", "stored"])
    return both.filter("counted <> stored")


def positives(hits: DataFrame, documents: DataFrame, floor: float = 0.65) -> DataFrame:
    """Hits (doc_id, start, end, confidence, ...) fit for training: sure enough, and a span of the text that is not blank."""
    both = beside_text(hits.filter(F.col("confidence") >= floor), documents)
    span = lambda h: F.substring(F.col("text"), h["start"] + 1, h["end"] - h["start"])
    ok = lambda h: (h["start"] >= 0) & (h["start"] < h["end"]) & (h["end"] <= F.length("text")) & (F.length(F.trim(span(h))) > 0)
    kept = F.transform(F.filter("hits", ok), lambda h: F.struct(*(h[c].alias(c) for c in hits.columns), span(h).alias("span")))
    return both.select(F.inline(kept))


def distractors(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(pair_id, negative): for positives (pair_id, surface, uri) the least other concept that the
    catalogue (lemma, uri) of known false positives has for the same lower-case surface."""
    c = catalogue.select(F.lower("lemma").alias("k"), F.col("uri").alias("negative")).distinct()
    both = rows.select("pair_id", F.lower("surface").alias("k"), "uri").join(c, "k").filter("negative <> uri")
    return both.groupBy("pair_id").agg(F.min("negative").alias("negative"))


def conflicts(links: DataFrame, key: list[str]) -> DataFrame:
    """Links (id, key...) whose key another id holds too, with the number of holders."""
    g = links.groupBy(*key).agg(F.count_distinct("id").alias("holders")).filter("holders > 1")
    return links.join(g, key)


def overwritten(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` from ``updates`` where it has the key and a value; keys only in ``updates`` are skipped."""
    u = updates.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    both = rows.join(u, key, "left")
    return both.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def replaced(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """All rows of a key give way to the new rows of that key."""
    return current.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def precision_recall(ranks: DataFrame, at: tuple = (5, 10)) -> DataFrame:
    """Precision and recall at each cut and MAP at the last, of the rank of each query's one relevant item (null: not found)."""
    hit = lambda k: F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
    columns = [c for k in at for c in (F.avg(hit(k) / k).alias(f"precision_{k}"), F.avg(hit(k)).alias(f"recall_{k}"))]
    return ranks.agg(*columns, F.avg(F.when(F.col("rank") <= at[-1], 1 / F.col("rank")).otherwise(0.0)).alias(f"map_{at[-1]}"), F.count("*").alias("queries"))


#: The order of disagreements (gold, predicted), the gravest first.
SEVERITY = [("strong", "no"), ("no", "strong"), ("strong", "possible"), ("possible", "no"), ("no", "possible"), ("possible", "strong")]


def gravest(cells: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    """(key..., gold, predicted, score, severity): the n gravest disagreements by class, then by size of the score."""
    rank = F.lit(99)
    for k, (gold, predicted) in enumerate(SEVERITY):
        rank = F.when((F.col("gold") == gold) & (F.col("predicted") == predicted), k).otherwise(rank)
    rows = cells.filter("gold <> predicted").select(*key, "gold", "predicted", "score", rank.alias("severity"))
    return rows.orderBy("severity", F.desc(F.abs("score")), *key).limit(n)


def examples(cells: DataFrame, key: list[str], wanted: dict[str, int]) -> DataFrame:
    """``cells`` (key..., kind, ...): the first ``wanted[kind]`` of each kind by key; each kind is cut by
    Spark's top-n, so no kind is ordered in one task."""
    parts = [cells.filter(F.col("kind") == kind).orderBy(*key).limit(n) for kind, n in wanted.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def method_summary(rows: DataFrame) -> DataFrame:
    """(method, ok, errors, quality, ms) of runs (method, error, quality_score, time_ms): means over
    runs without an error, the time as a whole number; 0 where there is none."""
    good = F.coalesce(F.col("error"), F.lit("")) == ""
    ok = F.count(F.when(good, 1))
    quality = F.coalesce(F.avg(F.when(good, F.col("quality_score"))), F.lit(0.0))
    ms = F.coalesce(F.floor(F.sum(F.when(good, F.col("time_ms"))) / ok), F.lit(0)).cast("long")
    return rows.groupBy("method").agg(ok.alias("ok"), F.count(F.when(~good, 1)).alias("errors"), quality.alias("quality"), ms.alias("ms"))


def gate(views_: DataFrame, floor: Column, go: float = 0.55, borderline: float = 0.45) -> DataFrame:
    """``views_`` (semantic_f1, ensemble_f1) with ``decision``: go, borderline or re-rank."""
    decision = F.when((F.col("semantic_f1") >= go) & (F.col("ensemble_f1") > floor), "go").when((F.col("semantic_f1") >= borderline) & (F.col("semantic_f1") < go), "borderline").otherwise("re-rank")
    return views_.withColumn("decision", decision)


def backfill(documents: DataFrame) -> DataFrame:
    """(id, reason): documents to take up again: ready without any address, or left unfinished."""
    none = (F.col("status") == "READY") & F.col("extracted_email").isNull() & F.col("manual_email").isNull()
    reason = F.when(none, "EMAIL").when(F.col("status").isin("PENDING", "PROCESSING"), "UNFINISHED")
    return documents.select("id", reason.alias("reason")).filter("reason is not null")


def by_email(wanted: DataFrame, applications: DataFrame) -> DataFrame:
    """``wanted`` (jd_id, email) with the applications (id, jd_id, email) of the same position and address, whatever its case; repeated wishes count once."""
    a = applications.select("id", F.col("jd_id").alias("j"), F.lower("email").alias("e"))
    return wanted.distinct().join(a, (F.col("jd_id") == F.col("j")) & (F.lower("email") == F.col("e"))).drop("j", "e")


def frequency(positives: DataFrame) -> DataFrame:
    """(uri, n): how often training has each concept."""
    return positives.groupBy("uri").agg(F.count("*").alias("n"))
