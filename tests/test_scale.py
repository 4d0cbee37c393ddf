"""Queries on planted tables against their SQL, and operators on shapes that larger tables have."""

import json

import duckdb
from pyspark.sql import functions as F

from rolecall.operators import linking, preparation, scoring, sections, tuning
from rolecall.plans import queries as plans
from rolecall.sources import reports, taxonomy

from test_queries import cell, rows_of


def check(spark, folder, name, **tables):
    """The query equals its SQL on the tables (SELECT statements) alone."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = plans.QUERIES[name](spark, str(folder))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(plans.ORACLES[name])
    want = rows_of(rel.columns, rel.fetchall())
    assert want[1] and got == want


def test_columns_with_halves(spark, tmp_path):
    # 24.5 is 24 for the SQL, so the strip beside it starts one bin later
    values = ", ".join(f"(1, {v})" for v in [1.0] * 8 + [24.5] * 4 + [30.5])
    check(spark, tmp_path, "column_detection", events=f"select row_number() over () as event_id, CAST(u AS BIGINT) as user_id, CAST(v AS DOUBLE) as value from (values {values}) t(u, v)")


def test_nearest_window_with_halves(spark, tmp_path):
    # halves go to the even number for the SQL, which decides what is held and what is nearest
    spans = "select CAST(k AS BIGINT) as event_id, CAST(90 + k % 2 * 3 AS BIGINT) as user_id, CAST(10 + k / 2.0 AS DOUBLE) as value from range(80) t(k)"
    check(spark, tmp_path, "nearest_window", events=spans, customer="select CAST(c AS BIGINT) as c_custkey from range(6000) t(c)")


def test_shared_windows_stand_once(spark, monkeypatch):
    vec = lambda i: [float((i * p) % 7 - 3) for p in (3, 5, 2)]
    concepts = spark.createDataFrame([("a", u, vec(u)) for u in range(9)], "encoder string, uri int, vec array<float>")
    shared = spark.createDataFrame([(g, "a", w, vec(w + g)) for g in range(3) for w in range(20)], "group int, encoder string, window int, vec array<float>")
    groups = spark.createDataFrame([(c, c % 4) for c in range(40)], "cv_id int, group int")
    gold = spark.createDataFrame([(c, (c * k) % 9) for c in range(40) for k in (1, 2, 2)], "cv_id int, uri int")
    own = groups.join(shared, "group").drop("group")
    asked, inner = [], linking.top_k

    def top_k(queries, index, *args, **more):
        asked.append((queries.count(), index.count()))
        return inner(queries, index, *args, **more)

    monkeypatch.setattr(linking, "top_k", top_k)
    got = {tuple(r) for r in linking.gold_similarity(gold, concepts, shared, groups).collect()}
    assert got == {tuple(r) for r in linking.gold_similarity(gold, concepts, own).collect()} and got
    assert asked[0][0] <= 36 and asked[0][1] == 60 and asked[1][1] == 600  # windows of the groups, not of the documents


def test_nearest_at_ties_and_not_finite(spark):
    index = spark.createDataFrame([(i, [1.0, 1e-13 * (i % 5)]) for i in range(50, 0, -1)], "id int, vec array<double>")
    asked = spark.createDataFrame([(q, [1.0, 1.0]) for q in range(3)], "query int, vec array<double>")
    for unique in (False, True):
        got = linking.top_k(asked, index, 3, block=2, part=13, unique=unique).collect()
        assert sorted((r["query"], r["rank"], r["id"]) for r in got) == [(q, k, k) for q in range(3) for k in (1, 2, 3)]
    odd = index.limit(4).union(spark.createDataFrame([(0, [float("nan"), 1.0])], "id int, vec array<double>"))
    assert linking.top_k(asked, odd, 2).count() == 6


def test_scores_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [("a", i / 40, ("strong", "possible", "no", None)[i % 4]) for i in range(40)]
    scored = spark.createDataFrame(rows, "run string, score double, gold string")
    found = tuning.combinations(scored.mapInArrow(seen, scored.schema), ["run"], [(0.5, 0.2), (0.7, 0.1)])
    assert len(found.collect()) == 2 and len(found.collect()) == 2
    assert read.value == 40


def test_pairs_are_sorted_before_they_are_lines(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "cv2", 5, 6, "x"), ("p2", "cv1", 7, 9, None), ("p3", "cv1", 2, 3, "é")], "pair_id string, cv_id string, span_start int, span_end int, text_span string").selectExpr("*", "'positive' as pair_type", "'u' as concept_uri")
    taxonomy.write_pairs(rows, {"pair_count": 3}, f"{tmp_path}/p")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/p").collect()]
    assert {"pair_count": 3} in lines and len(lines) == 4
    assert [r.pair_id for r in taxonomy.read_pairs(spark, f"{tmp_path}/p").orderBy("pair_id").collect()] == ["p1", "p2", "p3"]
    assert all("_head" not in x and "_k" not in x for x in lines)


def test_leaves_are_made_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    leaves = spark.createDataFrame([("r", "a.b[0].c", "1"), ("r", "ab", "2"), ("r", "d", "3"), ("s", "a.b[0].c", "4"), (None, "a", "5")], "path string, leaf string, value string")
    sources = spark.createDataFrame([("r", "a.b"), ("r", "d"), ("r", None), ("t", "ab")], "path string, leaf string")
    got = {tuple(r) for r in reports.unsourced(leaves.mapInArrow(seen, leaves.schema), sources).collect()}
    assert got == {("r", "ab", "2"), ("s", "a.b[0].c", "4"), (None, "a", "5")}
    assert read.value == 5


def test_only_what_is_met_goes_on(spark):
    # long rows say what each pair meets and what not; the narrow ones say the same
    req = [(j, k % 17, f"t{k % 5}", None if k == 9 else k % 13, ("required", "nice_to_have", "other", None)[k % 4 if j else 1]) for j in range(3) for k in range(40)] + [(7, 0, "x", None, "required")]
    req = spark.createDataFrame(req, "jd_id int, req_ord int, text string, skill_uri int, importance string").withColumn("req_conf", F.lit(1.0))
    pairs = spark.createDataFrame([(c, j) for c in range(20) for j in (0, 1, 2, 7, 8)] + [(None, 1)], "cv_id int, jd_id int")
    cand = spark.createDataFrame([(c, (c * 7) % 13, 0.05 + c / 20) for c in range(20)] + [(c, c % 5, 0.8) for c in range(9)] + [(3, None, 0.9), (None, 1, 0.9)], "cv_id int, skill_uri int, confidence double")
    cand = cand.groupBy("cv_id", "skill_uri").agg(F.max("confidence").alias("confidence"))
    long = scoring.exact_matches(pairs, req, cand, 0.3)
    placed = scoring.placed_requirements(req)
    hits = scoring.exact_hits(pairs, placed, cand.union(cand.limit(3)), 0.3)
    rows = lambda df, *more: sorted((tuple(cell(v) for v in r) for r in df.select("cv_id", "jd_id", *more).collect()), key=str)
    score = ["overall_score", "required_total", "nice_total", "required_matched", "nice_matched", "required_coverage", "nice_to_have_coverage"]
    assert rows(scoring.overall_of_hits(hits), *score) == rows(scoring.overall(long), *score)
    assert rows(scoring.explained_of_hits(hits, placed), "explanation") == rows(scoring.explained(long), "explanation")
    met = long.filter("match_score is not null").count()
    assert 0 < hits.count() <= met + 81 < long.count() / 2


def test_slashes_of_a_small_file_are_many_tasks(spark, tmp_path):
    # one task read and searched a small file; the search stands after the exchange, and once
    docs = spark.createDataFrame([(i, f"/x C/C++ {i}/C" if i % 3 else None) for i in range(500)], "doc_id int, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/docs")
    names = spark.createDataFrame([("C",), ("c++",)], "surface string")
    new = sections.slash_segmented(spark.read.parquet(f"{tmp_path}/docs"), names)
    assert {r.doc_id: r.text for r in new.collect()} == {i: f"/x C / C++ {i}/C" if i % 3 else None for i in range(500)}
    plan = new._jdf.queryExecution().optimizedPlan().toString().split("\n")
    found = [i for i, line in enumerate(plan) if "regexp_extract_all" in line]
    dealt = [i for i, line in enumerate(plan) if "RepartitionByExpression" in line]
    assert found and not any("Filter" in plan[i] for i in found)
    assert all(any(i < d for d in dealt) for i in found)


def test_shingles_are_made_once(spark, tmp_path):
    # a filter inferred from the explode made the shingles of every text a second time
    spark.createDataFrame([(1, "a b c d e f g"), (2, "a b"), (3, ""), (4, None), (5, "x a b c d e")], "doc_id int, text string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(8, "b c d e f g"), (9, "A  b"), (7, None)], "item_id int, text string").write.parquet(f"{tmp_path}/h")
    best = preparation.best_overlap(spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/h"))
    assert {tuple(r) for r in best.collect()} == {(1, 8, 2 / 3), (2, 9, 1.0)}
    plan = best._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("array_distinct" in line for line in plan)
    assert not any("array_distinct" in line for line in plan if "Filter" in line)
