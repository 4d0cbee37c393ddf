"""Scores of candidates against requirements, ranking and explanations.

``requirements``: jd_id, req_ord, text, skill_uri, importance (required or
nice_to_have), req_conf; ``candidates``: cv_id, skill_uri, confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scores
from .linking import top_k


def requirement_rows(positions: DataFrame) -> DataFrame:
    """Positions (jd_id, required_skills, nice_to_have_skills) to requirement rows: required first, 0.5 sure, no concept yet."""
    part = lambda c, i, base: positions.select("jd_id", F.posexplode(c).alias("p", "text"), F.lit(i).alias("importance"), base.alias("base"))
    rows = part("required_skills", "required", F.lit(0)).unionByName(part("nice_to_have_skills", "nice_to_have", F.coalesce(F.size("required_skills"), F.lit(0))))
    return rows.select("jd_id", (F.col("base") + F.col("p")).alias("req_ord"), "text", F.lit(None).cast("string").alias("skill_uri"), "importance", F.lit(0.5).alias("req_conf"))


def exact_matches(pairs: DataFrame, requirements: DataFrame, candidates: DataFrame, gate: float = C.REQUIREMENT_GATE) -> DataFrame:
    """Every requirement of each pair (cv_id, jd_id) with the candidate of its concept, if that passes the gate."""
    c = candidates.select("cv_id", "skill_uri", F.col("confidence").alias("match_score"))
    rows = pairs.join(requirements, "jd_id").join(c, ["cv_id", "skill_uri"], "left")
    return rows.withColumn("match_score", F.when(F.col("match_score") >= gate, F.col("match_score")))


def placed_requirements(requirements: DataFrame) -> DataFrame:
    """``requirements`` with ``k``, their place (from 0) in their position, and its ``required_total`` and ``nice_total``."""
    w = Window.partitionBy("jd_id")
    n = lambda kind: F.count(F.when(F.col("importance") == kind, 1)).over(w).cast("int")
    rows = requirements.select("jd_id", "req_ord", "text", "skill_uri", "importance")
    return rows.select("*", (F.row_number().over(w.orderBy("req_ord", "text", "skill_uri", "importance")) - 1).alias("k"), n("required").alias("required_total"), n("nice_to_have").alias("nice_total"))


def exact_hits(pairs: DataFrame, placed: DataFrame, candidates: DataFrame, gate: float = C.REQUIREMENT_GATE) -> DataFrame:
    """(cv_id, jd_id, k, required, nice, required_total, nice_total, match_score): the ``placed``
    requirements of each pair (cv_id, jd_id) that the surest candidate of their concept meets, and
    place 0 in any case, so that no pair is lost.

    As ``exact_matches``, but only narrow rows look for their candidates, and what is not met
    goes no further: it is what else the position asks for.  Candidates are hashed, not
    sorted, within the partitions of the shuffle.
    """
    sure = candidates.filter(F.col("confidence") >= gate).groupBy("cv_id", "skill_uri").agg(F.max("confidence").alias("match_score"))
    kind = lambda name: F.coalesce(F.col("importance") == name, F.lit(False))
    asked = placed.select("jd_id", "k", "skill_uri", kind("required").alias("required"), kind("nice_to_have").alias("nice"), "required_total", "nice_total")
    rows = pairs.join(asked, "jd_id").join(sure.hint("shuffle_hash"), ["cv_id", "skill_uri"], "left")
    return rows.filter("k = 0 or match_score is not null").drop("skill_uri")


def semantic_fallback(unmatched: DataFrame, candidates: DataFrame, threshold: float = C.KEEP, gate: float = C.REQUIREMENT_GATE) -> DataFrame:
    """For unmatched requirements (cv_id, jd_id, req_ord, vec): the candidate (cv_id, skill_uri,
    confidence, vec) of that document with the highest cosine, ties to the smaller concept.
    Requirements and candidates of a document meet in blocks."""
    asked = unmatched.select("cv_id", F.struct("jd_id", "req_ord").alias("query"), "vec")
    near = top_k(asked, candidates.select("cv_id", F.col("skill_uri").alias("id"), "vec"), 1, by=("cv_id",))
    sure = candidates.groupBy("cv_id", F.col("skill_uri").alias("cand_uri")).agg(F.max("confidence").alias("match_score"))
    best = near.select("cv_id", "query.jd_id", "query.req_ord", F.col("id").alias("cand_uri"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")).alias("similarity"))
    best = best.filter(F.col("similarity") >= threshold).join(sure, ["cv_id", "cand_uri"]).filter(F.col("match_score") >= gate)
    return best.select("cv_id", "jd_id", "req_ord", "cand_uri", "similarity", "match_score")


def overall(matched: DataFrame, required_weight: float = C.REQUIRED_WEIGHT) -> DataFrame:
    """(cv_id, jd_id, overall_score, required_coverage, nice_to_have_coverage, ...) from requirement
    rows with ``match_score`` (null where unmatched).  Without required ones the nice score counts alone."""
    req, nice = F.col("importance") == "required", F.col("importance") == "nice_to_have"
    n = lambda c: F.count(F.when(c, 1))
    hit = F.col("match_score").isNotNull()
    g = matched.groupBy("cv_id", "jd_id").agg(
        n(req).alias("required_total"),
        n(nice).alias("nice_total"),
        n(req & hit).alias("required_matched"),
        n(nice & hit).alias("nice_matched"),
        F.coalesce(F.sum(F.when(req, F.col("match_score"))), F.lit(0.0)).alias("rs"),
        F.coalesce(F.sum(F.when(nice, F.col("match_score"))), F.lit(0.0)).alias("ns"),
    )
    return _weighted(g, required_weight)


def overall_of_hits(hits: DataFrame, required_weight: float = C.REQUIRED_WEIGHT) -> DataFrame:
    """``overall`` from ``exact_hits``, whose rows bring the totals of their position."""
    hit, part = F.col("match_score").isNotNull(), lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("match_score"))), F.lit(0.0))
    g = hits.groupBy("cv_id", "jd_id").agg(
        F.max("required_total").cast("long").alias("required_total"),
        F.max("nice_total").cast("long").alias("nice_total"),
        F.count(F.when(F.col("required") & hit, 1)).alias("required_matched"),
        F.count(F.when(F.col("nice") & hit, 1)).alias("nice_matched"),
        part("required").alias("rs"),
        part("nice").alias("ns"),
    )
    return _weighted(g, required_weight)


def _weighted(g: DataFrame, required_weight: float) -> DataFrame:
    r, s = scores.ratio(F.col("rs"), F.col("required_total")), scores.ratio(F.col("ns"), F.col("nice_total"))
    score = F.when(F.col("required_total") > 0, required_weight * r + (1 - required_weight) * s).otherwise(s)
    return g.select(
        "cv_id", "jd_id", "required_total", "nice_total", "required_matched", "nice_matched",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("overall_score"),
        scores.ratio(F.col("required_matched"), F.col("required_total")).alias("required_coverage"),
        scores.ratio(F.col("nice_matched"), F.col("nice_total")).alias("nice_to_have_coverage"),
    )


def tri_factor(factors: DataFrame, gate: float, required_weight: float) -> DataFrame:
    """``overall`` of factor rows (req_conf, cand_conf, uri_sim) whose product passes the gate."""
    product = F.col("req_conf") * F.col("cand_conf") * F.col("uri_sim")
    return overall(factors.withColumn("match_score", F.when(product >= gate, product)), required_weight)


def ranked(results: DataFrame, order: str = "pool_ord") -> DataFrame:
    """Ranks within each position by score, stable in pool order; failed rows (null score) come last, unranked."""
    w = Window.partitionBy("jd_id").orderBy(F.col("overall_score").desc_nulls_last(), order)
    return results.withColumn("rank", F.when(F.col("overall_score").isNotNull(), F.row_number().over(w)))


def stored_reports(rows: DataFrame) -> DataFrame:
    """(jd_id, top_score, candidate_count, report): ranked candidates (jd_id, cv_id, overall_score, rank) as one JSON text a
    position, with the figures that lists of reports are sorted by; unranked ones come last."""
    each = F.struct(F.coalesce("rank", F.lit(2**31 - 1)).alias("o"), "cv_id", "overall_score", "rank")
    g = rows.groupBy("jd_id").agg(F.max("overall_score").alias("top_score"), F.count("*").alias("candidate_count"), F.array_sort(F.collect_list(each)).alias("l"))
    kept = F.transform("l", lambda x: F.struct(x["cv_id"].alias("cv_id"), x["overall_score"].alias("score"), x["rank"].alias("rank")))
    return g.select("jd_id", "top_score", "candidate_count", F.to_json(kept).alias("report"))


def shortlist(rows: DataFrame, n: int) -> DataFrame:
    return rows.filter(F.col("rank").isNotNull() & (F.col("rank") <= n))


def explained(matched: DataFrame) -> DataFrame:
    """(cv_id, jd_id, explanation): what is covered, the three strongest matches, what required is missing."""
    req, hit = F.col("importance") == "required", F.col("match_score").isNotNull()
    g = matched.groupBy("cv_id", "jd_id").agg(
        F.count(F.when(req, 1)).alias("n"),
        F.count(F.when(req & hit, 1)).alias("m"),
        F.slice(F.array_sort(F.collect_list(F.when(hit, F.struct((-F.col("match_score")).alias("k"), "req_ord", "text", "match_score")))), 1, 3).alias("top"),
        F.array_sort(F.collect_list(F.when(req & ~hit, F.struct("req_ord", "text")))).alias("gaps"),
    )
    return _told(g)


def explained_of_hits(hits: DataFrame, placed: DataFrame) -> DataFrame:
    """``explained`` from ``exact_hits`` and the placed requirements that they point to."""
    hit = F.col("match_score").isNotNull()
    met = hits.groupBy("cv_id", "jd_id").agg(
        F.count(F.when(F.col("required") & hit, 1)).alias("m"),
        F.sort_array(F.collect_list(F.when(hit, F.struct((-F.col("match_score")).alias("by"), "k", "match_score")))).alias("met"),
    )
    needed = F.when(F.col("importance") == "required", F.struct("k", "text"))
    own = placed.groupBy("jd_id").agg(F.max("required_total").alias("n"), F.sort_array(F.collect_list(F.struct("k", "text"))).alias("asked"), F.sort_array(F.collect_list(needed)).alias("needed"))
    rows = met.select("cv_id", "jd_id", "m", "met", F.col("met.k").alias("places")).join(own, "jd_id")
    top = F.transform(F.slice("met", 1, 3), lambda t: F.struct(F.get("asked", t["k"])["text"].alias("text"), t["match_score"].alias("match_score")))
    gaps = F.filter("needed", lambda x: ~F.array_contains("places", x["k"]))
    return _told(rows.select("cv_id", "jd_id", "n", "m", top.alias("top"), gaps.alias("gaps")))


def _told(g: DataFrame) -> DataFrame:
    strengths = F.array_join(F.transform("top", lambda t: F.format_string("%s (%.2f)", t["text"], t["match_score"])), ", ")
    missing = F.array_join(F.col("gaps.text"), ", ")
    clause = lambda head, body: F.when(F.length(body) > 0, F.concat(F.lit(head), body, F.lit(".")))
    cover = F.when(F.col("n") > 0, F.concat(F.lit("Covers "), F.col("m").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" required.")))
    lines = g.select("cv_id", "jd_id", cover.alias("cover"), strengths.alias("strengths"), missing.alias("missing"))
    return lines.select("cv_id", "jd_id", F.concat_ws(" ", "cover", clause("Strengths: ", F.col("strengths")), clause("Missing critical: ", F.col("missing"))).alias("explanation"))
