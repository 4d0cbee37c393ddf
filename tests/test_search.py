"""Closure, places in a category, windows of spans, threshold search."""

import random

import pytest
from pyspark.sql import functions as F

from rolecall.operators import linking, preparation, tuning
from rolecall.sources import taxonomy


def test_closure(spark):
    rng = random.Random(3)
    up = {k: rng.randrange(k) for k in range(1, 60)} | {k: k - 1 for k in range(100, 141)}  # a tree, and a path of 41
    up |= {200: 201, 201: 202, 202: 200, 203: 200}  # a cycle
    rows = [(k, p, 0) for k, p in up.items()] + [(k, 999, 1) for k in up] + [(None, 1, 0), (300, None, 0), (301, 301, 0)]
    got = {(r["node"], r["ancestor"]): r["level"] for r in preparation.closure(spark.createDataFrame(rows, "child int, parent int, ord int")).collect()}
    want = {}
    for k in up:
        at, level = up[k], 1
        while at is not None and at != k and (k, at) not in want:
            want[k, at] = level
            at, level = up.get(at), level + 1
    assert got == want
    none = spark.createDataFrame([], "child int, parent int")
    assert preparation.closure(none).count() == 0


def test_hierarchy_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("Level 0 URI,Level 1 URI,Level 2 URI,Level 3 URI\nS,S1, S1.1 ,\nS,S1,S1.2,S1.2.1\nS,,,\n")
    (tmp_path / "b.csv").write_text("conceptUri,broaderUri\nx, S1.1\nx,S1.2\n,S\ny,x\n")
    edges = taxonomy.hierarchy_edges(taxonomy.hierarchy(spark, str(tmp_path / "h.csv")))
    assert {tuple(r) for r in edges.collect()} == {("S1", "S"), ("S1.1", "S1"), ("S1.2", "S1"), ("S1.2.1", "S1.2")}
    broader = taxonomy.broader_edges(spark, str(tmp_path / "b.csv"))
    both = preparation.closure(broader.unionByName(edges.withColumn("ord", F.lit(0).cast("long"))))
    assert {(r["ancestor"], r["level"]) for r in both.filter("node = 'y'").collect()} == {("x", 1), ("S1.1", 2), ("S1", 3), ("S", 4)}
    with pytest.raises(ValueError):
        taxonomy.broader_edges(spark, str(tmp_path / "h.csv"))


def test_places_in_a_category(spark):
    rows = [(i, "big" if i % 5 else None if i % 10 else "s") for i in range(500)]
    got = preparation.placed(spark.createDataFrame(rows, "k int, c string").withColumn("h", preparation.seeded(F.col("k"), 1)), "c", "h", "k").collect()
    for c in ("big", None, "s"):
        mine = sorted((r["h"], r["k"], r["place"], r["size"]) for r in got if r["c"] == c)
        assert [m[2] for m in mine] == list(range(len(mine))) and {m[3] for m in mine} == {len(mine)}
    one = preparation.sampled(spark.createDataFrame(rows, "k int, c string").repartition(7), ["c"], "k", 4, 2)
    two = preparation.sampled(spark.createDataFrame(rows[::-1], "k int, c string").coalesce(1), ["c"], "k", 4, 2)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 12


def test_windows_of_spans(spark):
    rng = random.Random(8)
    windows = [(d, w, s := rng.randrange(900), s + rng.randrange(1, 400)) for d in range(3) for w in range(25)] + [(9, 1, 5, 9)]
    spans = [(d, k, s := rng.randrange(1000), s + rng.randrange(1, 120)) for d in range(4) for k in range(60)]
    got = {tuple(r) for r in linking.nearest_window(spark.createDataFrame(spans, "doc_id int, span int, s int, e int"), spark.createDataFrame(windows, "doc_id int, window int, w0 int, w1 int"), 100).collect()}
    want = set()
    for d, k, s, e in spans:
        own = [w for w in windows if w[0] == d]
        held = [w for w in own if w[2] <= s and w[3] >= e]
        want |= {(d, k, w[1]) for w in held or sorted(own, key=lambda w: (abs(w[2] - s), w[1]))[:1]}
    assert got == want


def test_threshold_search(spark):
    rng = random.Random(4)
    rows = [(run, round(rng.random(), 2), rng.choice(["strong", "possible", "no", None])) for run in "ab" for _ in range(80)] + [("c", 0.5, "no")]
    pairs = tuning.grid([0.3, 0.5, 0.81], [0.1, 0.4]) + [(0.2, 0.6)]
    found = {(r["run"], r["t1"], r["t2"]): r for r in tuning.combinations(spark.createDataFrame(rows, "run string, score double, gold string"), ["run"], pairs).collect()}
    assert len(found) == 3 * len(pairs)
    for (run, t1, t2), r in found.items():
        mine = [(g, "strong" if s >= t1 else "possible" if s >= t2 else "no") for x, s, g in rows if x == run]
        judged = [m for m in mine if m[0]]
        f1 = []
        for c in ("strong", "possible", "no"):
            hit = sum(g == p == c for g, p in judged)
            p, q = sum(p == c for _, p in judged), sum(g == c for g, _ in judged)
            f1.append(2 * hit / (p + q) if hit else 0.0)
        assert r["macro_f1"] == pytest.approx(sum(f1) / 3) and r["accuracy"] == pytest.approx(sum(g == p for g, p in judged) / len(judged))
        assert ("score_buckets_non_empty" in r["failed"]) == (len({p for _, p in mine}) < 3)
        assert ("all_three_classes_predicted" in r["failed_relaxed"]) == (len({p for _, p in judged}) < 3)
        assert ("t2_lt_t1" in r["failed"]) == (t2 >= t1)
    table = spark.createDataFrame(rows, "run string, score double, gold string").filter("run = 'c'")
    assert {r["kind"] for r in tuning.winners(tuning.combinations(table, ["run"], pairs), ["run"]).collect()} == {"unguarded"}
