"""The registered queries over the smallest tables, and the pipeline stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from rolecall.llm import decontaminate, neardup, pieces, pii, quality
from rolecall.llm.queries import ORACLES, QUERIES


def test_every_query_runs(spark, sf_dir):
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    for name, query in QUERIES.items():
        rows = query(spark, sf_dir)
        assert rows.count() > 0 or name == "op2_license_patience", name


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = docs.count()
        if name != "sentencepiece_encoding":
            assert docs.columns == before.columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "quality_classifier":
            network = quality.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert kept[name] == quality.scores(before, network).filter("predicted = 1").count()
        if name == "minhash_near_dedup":
            assert kept[name] == neardup.near_duplicates(before).filter("kept").count()
        if name == "benchmark_decontamination":
            assert decontaminate.contamination(docs, benchmark).filter("contaminated").count() == 0
            assert kept[name] == decontaminate.contamination(before, benchmark).filter("not contaminated").count()
        if name == "pii_sanitisation":
            assert kept[name] == before.count()
            assert pii.personal_data(docs).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
            assert docs.filter("n_chars <> length(text)").count() == 0
        if name == "sentencepiece_encoding":
            assert docs.filter("not exact").count() == 0 and kept[name] == before.count()
    assert pieces.MODEL.endswith(".model")
    assert corpus_pipeline.run(spark, sf_dir).count() == kept["sentencepiece_encoding"]


def test_pipeline_of_hard_rows(spark, sf_dir, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns of clashing names through all stages."""
    good = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = [(None, None), (9001, None), (9002, ""), (9003, " "), (9004, "x" * 200_000), (9005, "a b c d@e.org " * 3000), (9005, "a b c d@e.org " * 3000)]
    rows = good.select("doc_id", "text").union(good.select("doc_id", "text").limit(5)).union(spark.createDataFrame(odd, "doc_id long, text string"))
    names = ["th", "row", "spans", "x.y", "new", "rep", "component", "label", "n_words", "__text"]
    docs = rows.select("doc_id", "text", *(F.lit(n).alias(n) for n in names))
    for table in (docs, docs.limit(0)):
        path = str(tmp_path / f"t{table.count()}")
        table.write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
        now = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, path).cache()
            assert now.columns == docs.columns
            assert now.select("doc_id").subtract(docs.select("doc_id")).count() == 0
            assert now.filter(" or ".join(f"not (`{n}` <=> '{n}')" for n in names)).count() == 0
        last = corpus_pipeline.run(spark, path)
        assert last.count() == now.count() and last.filter("not exact").count() == 0
