"""Languages and levels, slash-joined names, job texts: planted forms and hard cases."""

import pytest
from pyspark.sql import functions as F

from rolecall.operators import sections

LANGUAGES = [
    ("English (B2)", [("English", "B2")]),
    ("english - fluent; Franceză: native", [("English", "fluent"), ("French", "native")]),
    ("Cambridge English: Advanced (CAE), C1", [("English", "C1")]),
    ("English, Cambridge FCE 2012", [("English", "B2")]),
    ("English\nCertificate: C2 Proficiency", [("English", "C2")]),
    ("German (very good, b1 at least)", [("German", "B1")]),
    ("Deutsch – upper intermediate\nGerman (A1)", [("German", "B2")]),
    ("Java (8 years), fluent, Englishman", []),
    ("Romanian (mother tongue), Italian", [("Romanian", "native"), ("Italian", None)]),
    ("", []),
]


def test_languages(spark):
    pad = "Skills\nFrench (C2)\n"
    rows = [(i, pad + t + "\nend", len(pad), len(pad + t)) for i, (t, _) in enumerate(LANGUAGES)] + [(99, None, 0, 10)]
    parts = spark.createDataFrame(rows, "doc_id int, text string, start int, end int")
    got = {}
    for r in sections.language_levels(parts).collect():
        text = rows[r["doc_id"]][1]
        assert text[r["start"] : r["end"]] == r["surface"]
        got.setdefault(r["doc_id"], []).append((r["start"], r["language"], r["level"]))
    assert {i: [x[1:] for x in sorted(v)] for i, v in got.items()} == {i: want for i, (_, want) in enumerate(LANGUAGES) if want}


SLASHES = [
    ("C/C++ and C#/F#/X", "C / C++ and C#/F#/X"),
    ("client/server, and/or", "client/server, and/or"),
    ("python/c/C++.", "python/c/C++."),
    ("(python/c/C++), a/b", "(python / c / C++), a/b"),
    ("/c/c++/", "/c / c++/"),
    ("no slash", "no slash"),
    ("É/é c/É", "É / é c / É"),
    ("", ""),
    (None, None),
]


def test_slashes(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SLASHES)], "doc_id int, text string")
    names = spark.createDataFrame([("C",), ("c++",), (" Python ",), ("C#",), ("é",), (None,), ("",)], "surface string")
    for r in sections.slash_segmented(docs, names).collect():
        old, want = SLASHES[r["doc_id"]]
        assert r["text"] == want
        if want:
            places = spark.range(len(want)).select(sections.original_place(F.col("id").cast("int"), F.array(*map(F.lit, r["slashes"])).cast("array<int>")).alias("p")).collect()
            assert all(old[p["p"]] == c or (c == " " and old[p["p"]] == "/") for p, c in zip(places, want))
            assert [p["p"] for p, c in zip(places, want) if c != " " or old[p["p"]] == " "] == list(range(len(old)))


JOB = "\n\n  Data Engineer \nintro\n🧩 Must Know (core):\n• SQL\n- x\n* Spark\n\nGood to know & more\n- Kafka\nabout us\n- fun\nmust know\n- never\n"


def test_job_texts(spark):
    rows = [(1, JOB), (2, "Title\nmust know things are here\n- SQL"), (3, None), (4, ""), (5, "must know:\r\n- aaa\r\n" + "b" * 241 + "\r\n" + "c" * 240), (6, "T\ngood to know\none two\nmust know\nthree")]
    jobs = spark.createDataFrame(rows, "jd_id int, text string")
    got = {r[0]: tuple(r)[1:] for r in sections.job_rows(jobs, ["must know"], ["good to know"], ["about us"]).collect()}
    assert got == {
        1: ("Data Engineer", ["SQL", "Spark"], ["Kafka"]),
        2: ("Title", [], []),
        3: (None, [], []),
        4: (None, [], []),
        5: ("must know:", ["aaa", "c" * 240], []),
        6: ("T", ["three"], ["one two"]),
    }


@pytest.mark.parametrize("line, want", [("must know", True), ("  -- Must  KNOW -", True), ("must know & love it:", True), ("must know this", False), ("must knows", False)])
def test_headers(spark, line, want):
    assert spark.range(1).select(F.lit(line).rlike(sections.header_pattern(["must know"])).alias("x")).first()[0] is want
