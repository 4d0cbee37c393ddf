"""Bundles, percentiles, defaults and views with nulls and odd rows."""

import pytest
from pyspark.sql import functions as F

from rolecall.functions.lineage import numbered
from rolecall.operators import evaluation, preparation, projections
from rolecall.sources import bundle, taxonomy


def test_bundles(spark, tmp_path):
    rows = spark.createDataFrame([(k % 50, f"t{k % 7}", None if k % 3 else "é") for k in range(200)], "k int, t string, n string")
    digests = set()
    for parts in (1, 3, 11):
        some = rows.repartition(parts, "t")
        digests.add(bundle.write_bundle(some, ["k"], str(tmp_path / str(parts)), 30))
        made = {r["part"]: r["sha256"] for r in bundle.bundled(some, ["k"], 30).collect()}
        assert made == {r["part"]: r["sha256"] for r in bundle.verify_bundle(spark, str(tmp_path / str(parts))).collect()} and len(made) == 7
    assert len(digests) == 1
    assert bundle.bundled(rows.limit(0), ["k"]).count() == 0
    assert bundle.manifest(bundle.bundled(rows.filter("k <> 0"), ["k"], 30)).first()["sha256"] not in digests


def test_percentiles(spark):
    rows = spark.createDataFrame([(k % 3 or None, float((k * 37) % 101)) for k in range(300)] + [(9, None), (8, 5.0)], "g int, v double").repartition(5)
    got = {r["g"]: r for r in evaluation.percentiles(rows, "v", ["g"], (0.25, 0.9)).collect()}
    want = rows.groupBy("g").agg(F.percentile("v", [0.25, 0.9]).alias("p")).collect()
    for r in want:
        mine = got[r["g"]]
        assert (mine["p25"], mine["p90"]) == (pytest.approx(r["p"][0]), pytest.approx(r["p"][1])) if r["p"] else (mine["p25"], mine["n"]) == (None, 0)
    at = numbered(rows.select("g", "v").fillna(-1, ["v"]), ["g"], ["v"]).collect()
    for g in {r["g"] for r in at}:
        mine = sorted((r["place"], r["v"], r["size"]) for r in at if r["g"] == g)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1] for m in mine] == sorted(m[1] for m in mine) and {m[2] for m in mine} == {len(mine)}


def test_defaults_and_views(spark):
    rows = spark.createDataFrame([(" a ", None, None, None), (None, "required", 0.0, "EXTRACTED"), ("b", "NICE_TO_HAVE", 0.2, "web")], "text string, importance string, req_conf double, source string")
    assert [tuple(r) for r in projections.requirement_inputs(rows).collect()] == [("a", "required", 0.5, "MANUAL"), ("b", "nice_to_have", 0.2, "MANUAL")]
    jobs = spark.createDataFrame([(1, "ok", '{"top_score": 0.5, "candidates": 3}'), (2, "ok", "{"), (3, "ok", None), (4, "ok", "[1]"), (5, "ok", '{"top_score": "x"}')], "id int, status string, report string")
    assert [tuple(r)[3:] for r in projections.job_views(jobs).orderBy("id").collect()] == [(0.5, 3), (None, None), (None, None), (None, None), (None, None)]
    assert [r["report"] is None for r in projections.job_views(jobs).orderBy("id").collect()] == [False, True, True, True, False]
    m = projections.manifests(spark.createDataFrame([("a", '{"x": 1, "y": null}'), ("b", None)], "path string, text string"), ["x", "y"]).collect()
    assert [r["missing"] for r in m] == [["y"], ["x", "y"]]
    anchor = projections.training_anchor(F.lit(" "), F.lit("a "), F.lit("b"), F.lit(None).cast("string"))
    assert spark.range(1).select(anchor).first()[0] == "a b"
    labels = spark.createDataFrame([(1, "a", "high"), (1, "b", "medium")], "cv_id int, label string, level string")
    updates = spark.createDataFrame([(1, "a", None, True), (1, "c", "high", False), (1, "d", None, False)], "cv_id int, label string, level string, reject boolean")
    assert {tuple(r) for r in projections.label_changes(labels, updates).collect()} == {(1, "a", "negative"), (1, "b", "medium"), (1, "c", "high")}
    examples = spark.createDataFrame([(2, "p", "x", None), (1, "t", "x", "y"), (1, "t", "x", None)], "cv_id int, kind string, positive string, negative string")
    assert [r["negative"] for r in projections.ordered_examples(examples).collect()] == [None, "y", None]
    assert {r[0] for r in taxonomy.known_uris(spark.createDataFrame([("a",), (None,)], "concept_uri string"), spark.createDataFrame([("a",), ("b",)], "concept_uri string")).collect()} == {"a", "b"}
    profile = {r["lang"]: r for r in preparation.corpus_profile(spark.createDataFrame([("x", "en"), (None, "en"), ("abc", None)], "text string, lang string"), ["lang"], {"chars": F.length("text")}).filter("level = 0").collect()}
    assert (profile["en"]["n"], profile["en"]["no_chars"], profile[None]["mean_chars"]) == (2, 1, 3.0)
