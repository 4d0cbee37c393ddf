"""Report tables, JSON leaves, versions of an index, and the language of held-out texts."""

import pytest
from pyspark.sql import functions as F

from rolecall.operators import language
from rolecall.sources import reports, versions

REPORT = """# Run
- **Model**: abc: def
* seed: 42
- Model: later
no table | here

| Metric | Value |
|--------|:-----:|
| F1 — macro | 0.5 |
|  | x |
| a | b | c |

after | the table
Name | N
--- | ---
one | 1
"""


def test_report_tables(spark):
    texts = spark.createDataFrame([("r", REPORT), ("n", None), ("e", "")], "path string, text string")
    got = sorted((tuple(r) for r in reports.pipe_tables(texts).collect()), key=lambda r: (r[1], r[2], str(r[3])))
    assert [r[1:] for r in got if r[1] == 1] == [(1, 0, "Metric", "F1 - macro"), (1, 0, "Value", "0.5"), (1, 1, "Metric", None), (1, 1, "Value", "x"), (1, 2, "Metric", "a"), (1, 2, None, "c"), (1, 2, "Value", "b")]
    assert [r[1:] for r in got if r[1] == 2] == [(2, 0, "N", "1"), (2, 0, "Name", "one")]
    assert {tuple(r)[1:] for r in reports.bullet_keys(texts).collect()} == {("Model", "abc: def"), ("seed", "42")}


def test_json_leaves(spark):
    rows = spark.createDataFrame([("a", '{"x": {"y": [1, {"z": null}], "e": {}}, "t": "s"}'), ("b", "7"), ("c", "{bad"), ("d", None), ("e", "[]")], "path string, text string")
    got = {tuple(r) for r in reports.json_leaves(rows).collect()}
    assert got == {("a", "x.y[0]", "1"), ("a", "x.y[1].z", None), ("a", "t", "s"), ("b", "", "7")}
    leaves = spark.createDataFrame([("a", "x.y[0]", "1"), ("a", "x.yy", "2"), ("a", "x.y[1].z", "3"), ("b", "x.y[0]", "1")], "path string, leaf string, value string")
    sources = spark.createDataFrame([("a", "x.y"), ("a", "q")], "path string, leaf string")
    assert {tuple(r)[:2] for r in reports.unsourced(leaves, sources).collect()} == {("a", "x.yy"), ("b", "x.y[0]")}


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = spark.range(10)
    assert versions.current(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        versions.load(spark, folder)
    one = versions.get_or_build(spark, folder, {"model": "a"}, lambda: rows)
    assert one.count() == 10 and versions.current(spark, folder)["rows"] == 10

    def fail():
        raise AssertionError("built again")

    assert versions.get_or_build(spark, folder, {"model": "a"}, fail).count() == 10

    def while_writing():
        # another writer is refused, and readers see the old version
        (tmp_path / "index" / "writer").touch()
        with pytest.raises(versions.Busy):
            versions.publish(rows, folder, {"model": "c"})
        assert versions.load(spark, folder).count() == 10
        (tmp_path / "index" / "writer").unlink()
        return rows.limit(3)

    two = versions.get_or_build(spark, folder, {"model": "b"}, while_writing)
    assert two.count() == 3 and one.count() == 10
    broken = rows.select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        versions.publish(broken, folder, {"model": "d"})
    assert versions.load(spark, folder).count() == 3 and not (tmp_path / "index" / "writer").exists()
    gone = versions.clean(spark, folder)
    assert gone and versions.load(spark, folder).count() == 3


def test_language_of_held_out_texts(spark, sf_dir):
    """Profiles of half of the documents tell the language of the other half, where they tell one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").filter("length(text) >= 200")
    odd, even = docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0")
    got = language.detected(even, language.profiles(odd)).join(even, "doc_id").filter("language is not null")
    right, all_ = got.filter("language = lang").count(), got.count()
    assert all_ > 0.5 * even.count() and right > 0.8 * all_
    short = spark.createDataFrame([(1, "abc"), (2, None), (3, "1234567890 " * 10)], "doc_id long, text string")
    assert {tuple(r)[:2] for r in language.detected(short, language.profiles(odd)).collect()} == {(1, None), (2, None), (3, None)}
