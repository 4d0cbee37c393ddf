"""Exact values of operators on tiny inputs."""

import json

import pytest
from pyspark.sql import functions as F

from rolecall.functions import scores, text
from rolecall.operators import lexical, linking, operations, preparation, scoring
from rolecall.sources import overlays, taxonomy, versions
from rolecall.streaming import limits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.clean(lit("ﬁne  text\r\n\n\n\nrnarket\u0001 "), True)) == "fine text\n\nmarket"
    assert one(spark, text.emails(lit("<A@b.com>, a@B.com; x@y and c@d.org."))) == ["a@b.com", "c@d.org"]
    assert one(spark, text.header_key(lit("  Experiență: "))) == "experienta"
    assert one(spark, text.negated(lit("I have no experience with Java"), lit(26), ["no experience with"])) is True
    assert one(spark, text.negated(lit("no experience with it. " + "x" * 60 + "Java"), lit(83), ["no experience with"])) is False
    assert one(spark, text.first_wins(text.alternative_labels(lit("Alpha\nalpha|ALPHA;Beta")))) == ["Alpha", "Beta"]
    assert one(spark, text.context(lit("One. Two here three! Four"), lit(9), lit(13))).asDict() == {"before": "Two ", "after": " three"}
    assert [one(spark, text.window_count(lit(n))) for n in (0, 1, 30, 31, 45, 46)] == [0, 1, 1, 2, 2, 3]
    assert one(spark, text.effective_email(lit(" "), lit("M@x.io "), lit("e@x.io"))).asDict() == {"email": "m@x.io", "source": "MANUAL"}
    assert one(spark, text.shingles(text.lower_words(lit("a b c")), 5)) == ["a b c"]
    assert one(spark, text.concept_text(lit("L"), F.array(lit("b"), lit("a")), lit("D"))) == "L. a, b. D"


def test_denials(spark):
    cues = ["hardly any", "nothing of", "nu prea"]
    for sentence, want in (("Hardly any ", True), ("hardly\n any ", True), ("He knows nothing of ", True), ("Nu prea ", True), ("hardly any more ", False), ("manothing of ", False), ("", False)):
        assert one(spark, text.negated(F.lit(sentence + "Java"), F.lit(len(sentence)), cues)) is want
    far = "nothing of " + " " * 60
    assert one(spark, text.negated(F.lit(far + "Java"), F.lit(len(far)), cues)) is False
    with pytest.raises(ValueError):
        text.negated(F.lit("x"), F.lit(0), [])
    docs = spark.createDataFrame([(1, "nothing of Java, Java"), (2, None)], "doc_id int, text string")
    hits = spark.createDataFrame([(1, 11), (1, 17), (2, 0)], "doc_id int, start int")
    assert [tuple(r) for r in lexical.without_negated(hits, docs, cues).collect()] == [(1, 17)]


def test_alternative_labels_keep_digits(spark):
    assert one(spark, text.alternative_labels(F.lit("Grade 1 | 1st; 2\n 20 |"))) == ["Grade 1", "1st", "2", "20"]


def test_score_functions(spark):
    lit = F.lit
    assert one(spark, scores.confidence(lit("skills"), lit("exact"), lit(1))) == pytest.approx(1.0)
    assert one(spark, scores.confidence(lit("skills"), lit("alt"), lit(1))) == pytest.approx(0.85)
    assert one(spark, scores.banded(lit(0.8), lit(0.42)))["confidence"] == pytest.approx(0.61)
    assert one(spark, scores.banded(lit(0.8), lit(0.40)))["confidence"] == pytest.approx(0.8 * 0.40 / 0.42)
    assert one(spark, scores.banded(lit(0.8), lit(0.1)))["source"] == "lexical_dropped"
    assert [one(spark, scores.projected(lit(s))) for s in (0.06, 0.005, 0.0049)] == ["strong", "possible", "no"]
    assert one(spark, scores.display_band(lit(0.695))) == "excellent"
    with pytest.raises(ValueError):
        scores.projected(lit(1.0), 0.1, 0.2)
    empty = F.array().cast("array<string>")
    assert one(spark, scores.set_prf(empty, empty))["f1"] == 1 and one(spark, scores.set_prf(empty, F.array(lit("a"))))["recall"] == 0


def test_sections_hits_and_filters(spark):
    docs = spark.createDataFrame([(1, "Intro\nSkills:\nPython and machine learning\nEDUCATION\n"), (2, None), (3, "plain")], "doc_id long, text string")
    s = lexical.sections(docs, lexical.header_table(spark))
    assert sorted((r.doc_id, r.label, r.start, r.end) for r in s.collect()) == [(1, "education", 52, 52), (1, "other", 0, 6), (1, "skills", 14, 42), (2, "other", 0, 0), (3, "other", 0, 5)]
    pats = spark.createDataFrame([("u1", "Python", "preferred", "Python"), ("u2", "ML", "alt", "machine learning"), ("u3", "Learning", "preferred", "learning")], "concept_uri string, label string, label_kind string, surface string")
    hits = lexical.phrase_hits(docs, pats)
    assert sorted((r.concept_uri, r.pos) for r in hits.collect()) == [("u1", 2), ("u2", 4), ("u3", 5)]
    w = lexical.words(docs)
    placed = hits.join(w.select("doc_id", "pos", "start"), ["doc_id", "pos"]).withColumn("end", F.col("start") + F.length("surface"))
    full = lexical.in_sections(placed, s).withColumn("match_kind", lexical.match_kind(F.col("label_kind")))
    assert {(r.concept_uri, r.section) for r in full.collect()} == {("u1", "skills"), ("u2", "skills"), ("u3", "skills")}
    moved = full.withColumn("section", F.lit("other"))
    ents = spark.createDataFrame([(1, 18, 22)], "doc_id long, start int, end int")
    allowed = spark.createDataFrame([("nothing",)], "surface string")
    assert {r.concept_uri for r in lexical.without_entities(moved, ents, allowed).collect()} == {"u2", "u3"}
    rules = spark.createDataFrame([("python", "u1", False, None, ["education"], ["machine"], None, 60)], "surface string, target_uri string, case_sensitive boolean, allowed_sections array<string>, forbidden_sections array<string>, surrounding_any array<string>, surrounding_none array<string>, window_chars int")
    assert [r.concept_uri for r in lexical.suppressed(full, rules, docs).collect()] == ["u1"]
    m = {r.concept_uri: r for r in lexical.skill_matches(full).collect()}
    assert m["u1"].confidence == pytest.approx(1.0) and m["u2"].match_kind == "alt"


def test_linking(spark):
    vec = lambda *x: [float(v) for v in x]
    index = spark.createDataFrame([(i, vec(*(1 if k == i % 4 else 0 for k in range(4)))) for i in range(12)], "id long, vec array<float>")
    got = linking.top_k(index.withColumnRenamed("id", "query").filter("query < 2"), index, 3).collect()
    assert sorted((r.query, r.rank, r.id) for r in got) == [(0, 1, 0), (0, 2, 4), (0, 3, 8), (1, 1, 1), (1, 2, 5), (1, 3, 9)]
    rows = linking.encoded(spark.createDataFrame([("a",), ("a",), (None,)], "t string"), "t").collect()
    assert rows[0].vec == rows[1].vec and sum(v * v for v in rows[0].vec) == pytest.approx(1, abs=1e-5)
    w = linking.token_windows(spark.createDataFrame([(1, " ".join(f"t{k}" for k in range(46))), (2, ""), (3, "C++ .NET CI/CD")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.first_token, r.n_tokens) for r in w.collect()) == [(1, 0, 30), (1, 15, 30), (1, 30, 16), (3, 0, 3)]


def test_scoring(spark):
    rows = [(1, 1, 0, "required", 0.8), (1, 1, 1, "required", None), (1, 1, 2, "nice_to_have", 0.5), (2, 1, 0, "nice_to_have", 0.5), (3, 1, 0, "required", 1.0)]
    m = spark.createDataFrame(rows, "cv_id long, jd_id long, req_ord int, importance string, match_score double").withColumn("text", F.concat(F.lit("t"), "req_ord"))
    o = {r.cv_id: r for r in scoring.overall(m).collect()}
    assert o[1].overall_score == pytest.approx(0.85 * 0.4 + 0.15 * 0.5) and o[2].overall_score == pytest.approx(0.5) and o[3].overall_score == pytest.approx(0.85)
    x = {r.cv_id: r.explanation for r in scoring.explained(m).collect()}
    assert x[1] == "Covers 1/2 required. Strengths: t0 (0.80), t2 (0.50). Missing critical: t1."
    ranked = scoring.ranked(spark.createDataFrame([(1, 1, 0.5), (1, 2, None), (1, 3, 0.5)], "jd_id long, pool_ord long, overall_score double"))
    assert {r.pool_ord: r["rank"] for r in ranked.collect()} == {1: 1, 3: 2, 2: None}


def test_operations(spark):
    batch = spark.createDataFrame([(0, "a", "application/pdf", bytearray(b"%PDF-1")), (1, "b", "application/pdf", bytearray(b"%PDF-1")), (2, "c", "text/plain", bytearray(b"x")), (3, "d", "application/pdf", bytearray(b""))], "ord int, name string, content_type string, content binary")
    none = spark.createDataFrame([], "content_hash string")
    assert [(r.status, r.reject_reason) for r in operations.upload(batch, none).orderBy("ord").collect()] == [("created", None), ("duplicate", None), ("rejected", "TYPE"), ("rejected", "EMPTY")]
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, v long, x string")
    new = spark.createDataFrame([(2, 2, "B"), (3, 1, "c")], "id long, v long, x string")
    assert sorted((r.id, r.x) for r in operations.upserted(old, new, ["id"], "v").collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_preparation(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "child string, parent string")
    top = spark.createDataFrame([("c",)], "node string")
    assert sorted((r.node, r.depth) for r in preparation.ancestors(edges, top).collect()) == [("a", 2), ("b", 1)]
    rows = spark.createDataFrame([(k, "c1" if k < 10 else "c2") for k in range(11)], "id long, cat string")
    split = preparation.stratified_split(rows, "id", "cat", 0.3).groupBy("cat", "split").count().collect()
    assert {(r.cat, r.split): r["count"] for r in split} == {("c1", "val"): 3, ("c1", "train"): 7, ("c2", "train"): 1}
    concepts = spark.createDataFrame([(f"u{k}", "a") for k in range(5)] + [("z", "b")], "uri string, category string")
    pos = spark.createDataFrame([(1, "u2"), (2, "z")], "pair_id long, uri string")
    neg = preparation.hard_negatives(pos, concepts, 3).collect()
    assert len({r.negative for r in neg if r.pair_id == 1}) == 3 and all(r.strategy == "sibling" and r.negative != "u2" for r in neg if r.pair_id == 1)
    assert len({r.negative for r in neg if r.pair_id == 2}) == 3 and all(r.strategy == "any" for r in neg if r.pair_id == 2)
    known = spark.createDataFrame([(1, "z"), (2, "z")], "pair_id long, negative string")
    neg = preparation.hard_negatives(pos, concepts.union(spark.createDataFrame([("n", None)], concepts.schema)), 9, known=known).collect()
    assert [(r.negative, r.strategy) for r in neg if r.pair_id == 1 and r["rank"] == 1] == [("z", "known")]
    assert sorted(r.negative for r in neg if r.pair_id == 1) == ["n", "u0", "u1", "u3", "u4", "z"] and len([r for r in neg if r.pair_id == 2]) == 6
    assert preparation.hard_negatives(pos, concepts.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('conceptUri,skillType,preferredLabel,altLabels,description,reuseLevel\nu1,knowledge,Old,,d,\nu1,KNOWLEDGE,Alpha,"alpha\nBeta|beta",d,x\n,a,b,,,\nu2,odd,Gamma,,,\n')
    q = tmp_path / "l.csv"
    q.write_text("conceptUri,preferredLabel,altLabels\nu2,Gamma,\nu3,Delta,\n")
    got = {r.concept_uri: r for r in taxonomy.concepts(spark, str(p), str(q)).collect()}
    assert got["u1"].preferred_label == "Alpha" and got["u1"].alt_labels == ["Beta"] and got["u2"].skill_type == got["u3"].skill_type == "language"
    with pytest.raises(ValueError, match="missing columns: altLabels"):
        taxonomy.require_columns(spark.createDataFrame([(1,)], "a int"), ["altLabels"])
    j = tmp_path / "c.json"
    j.write_text(json.dumps({"concepts": [{"id": "CUST:1", "preferred_label": "X", "alt_labels": [], "skill_type": "knowledge", "description": "", "source_url": "u"}]}))
    custom = taxonomy.custom_concepts(spark, str(j))
    assert taxonomy.appended(taxonomy.concepts(spark, str(p)), custom).count() == 3
    rows = spark.createDataFrame([("p2", "b", "positive", "t", 0, 1, "u", "s", "en", 1.0), ("p1", "a", "positive", "t", 0, 1, "u", "s", "en", 1.0)], "pair_id string, cv_id string, pair_type string, text_span string, span_start int, span_end int, concept_uri string, section string, language string, module2_confidence double")
    out = str(tmp_path / "pairs")
    taxonomy.write_pairs(rows, {"pair_count": 2}, out)
    assert sorted(r.pair_id for r in taxonomy.read_pairs(spark, out).collect()) == ["p1", "p2"]
    wide = spark.createDataFrame([("c1", " Strong", "", "maybe")], "cv_id string, j1 string, j2 string, j3 string")
    assert [(r.jd_id, r.fit) for r in taxonomy.fit_matrix(wide).collect()] == [("j1", "strong")]
    f = tmp_path / "files"
    f.mkdir()
    (f / "a.bin").write_bytes(b"ok")
    (f / "b.bin").write_bytes(b"\xff")
    docs = {r.path[-5:]: r for r in taxonomy.documents_from_files(spark, str(f), lambda b: b.decode()).collect()}
    assert docs["a.bin"].text == "ok" and docs["b.bin"].error.startswith("UnicodeDecodeError")


def test_streaming_limits(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:00:{k:02d}", "ip", "GET", k) for k in range(3)] + [("2024-01-01 00:01:00", "ip", "GET", 9)], "t string, client string, method string, ord int").withColumn("ts", F.to_timestamp("t"))
    few = {"GET": (2, "1 minute")}
    assert [r.rejected for r in limits.limited(rows, few).orderBy("ts").collect()] == [False, False, True, False]
    source = str(tmp_path / "in")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    q = limits.rejected_counts(stream, "GET", few).writeStream.outputMode("complete").format("memory").queryName("limits").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.rejected_n) for r in spark.table("limits").collect()) == [(1, 0), (3, 1)]
    folder = str(tmp_path / "out")
    merge = limits.merge_batch(folder, ["id"], "v", 4)
    table = lambda: sorted(tuple(r) for r in versions.merged(spark, folder, "id long, v long").collect())
    assert table() == []
    merge(spark.createDataFrame([(i, 1) for i in range(20)], "id long, v long"), 3)
    merge(spark.createDataFrame([(1, 2), (30, 1), (1, 0)], "id long, v long"), 4)
    want = sorted([(i, 1) for i in range(20) if i != 1] + [(1, 2), (30, 1)])
    assert table() == want
    merge(spark.createDataFrame([(1, 9)], "id long, v long"), 4)  # the same batch again
    assert table() == want
    merge(spark.createDataFrame([(i, 7) for i in range(40)], "id long, v long"), 5)
    assert versions.clean(spark, folder) and table() == [(i, 7) for i in range(40)]


def test_overlays(spark, tmp_path):
    pytest.importorskip("yaml")
    a = tmp_path / "a.yaml"
    a.write_text("aliases:\n  - target_uri: u1\n    surfaces: [pg, Postgres]\n  - target_uri: gone\n    surfaces: [x]\n")
    base = spark.createDataFrame([("u1", "PostgreSQL", ["postgres"])], "concept_uri string, preferred_label string, alt_labels array<string>")
    both, unknown = taxonomy.with_surfaces(base, overlays.aliases(spark, str(a)))
    assert both.first().alt_labels == ["postgres", "pg"] and [r.concept_uri for r in unknown.collect()] == ["gone"]
    r = tmp_path / "r.yaml"
    r.write_text("rules:\n  - surface_pattern: It\n    target_concept_uri: u\n    case_sensitive: true\n    context_required: {forbidden_sections: [skills]}\n")
    row = overlays.suppression_rules(spark, str(r)).first()
    assert row.case_sensitive and row.window_chars == 60 and row.forbidden_sections == ["skills"] and row.allowed_sections is None
    r.write_text("rules:\n  - surface_pattern: It\n")
    with pytest.raises(ValueError):
        overlays.suppression_rules(spark, str(r))


def test_nearest_in_blocks(spark):
    """Blocks of any size give what one product gives, within groups too; ties go to the smaller id."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(g, i, [float(v) for v in rng.integers(-2, 3, 4)]) for g in (0, 1) for i in range(60)] + [(2, 0, None), (0, 90, None)]
    index = spark.createDataFrame(rows, "g int, id int, vec array<double>")
    queries = index.filter("id % 3 = 0").withColumnRenamed("id", "query")
    whole = {g: [(i, np.array(v)) for h, i, v in rows if h == g and v] for g in (0, 1)}
    for by, size in (((), 1000), ((), 7), (("g",), 9)):
        asked = queries if by else queries.filter("g = 0")
        got = linking.top_k(asked, index if by else index.filter("g = 0"), 4, by=by, block=size, part=size + 2).collect()
        want = set()
        for g in (0, 1) if by else (0,):
            for i, v in whole[g]:
                if i % 3 == 0:
                    best = sorted((-float(v @ u), j) for j, u in whole[g])[:4]
                    want |= {(g, i, j, -s, k + 1) for k, (s, j) in enumerate(best)}
        assert {(r["g"] if by else 0, r["query"], r["id"], r["similarity"], r["rank"]) for r in got} == want and len(got) == len(want)
    assert linking.top_k(queries.limit(0).drop("g"), index.drop("g"), 3).count() == 0
    assert linking.top_k(queries.drop("g"), index.limit(0).drop("g"), 3).count() == 0


def test_resolution(spark):
    concepts = spark.createDataFrame([("c1", "One", [1.0, 0.0]), ("c2", "Two", [0.0, 1.0])], "skill_uri string, label string, vec array<double>")
    vectors = spark.createDataFrame([("a", [0.6, 0.8]), ("b", [1.0, 0.0]), ("d", None)], "text string, vec array<double>")
    rows = spark.createDataFrame([(1, "a", None, 0.0), (2, "a", None, 0.5), (3, "b", "c2", 0.0), (4, "d", None, 0.0), (5, None, None, None), (6, "b", "c9", 0.1)], "ord int, text string, skill_uri string, req_conf double")
    got = {r["ord"]: tuple(r)[1:] for r in linking.resolved(rows, concepts, vectors).collect()}
    assert got == {1: ("a", "c2", 0.8, "Two", True), 2: ("a", "c2", 0.5, "Two", True), 3: ("b", "c2", 0.0, "Two", False), 4: ("d", None, 0.0, None, False), 5: (None, None, None, None, False), 6: ("b", "c9", 0.1, None, False)}
