"""Taxonomy, overlay and corpus readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

KINDS = ("skill/competence", "knowledge", "language")


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _csv(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    return require_columns(spark.read.csv(path, header=True, multiLine=True, escape='"'), needed)


def concepts(spark: SparkSession, path: str, languages: str | None = None) -> DataFrame:
    """A taxonomy CSV: rows without id or label are skipped, the last row of an id wins,
    alternatives are split and cleaned, unknown kinds become skills.  ``languages``
    is an optional second file whose concepts are languages, there or added."""
    raw = _csv(spark, path, ["conceptUri", "skillType", "preferredLabel", "altLabels", "description", "reuseLevel"])
    rows = _concepts(raw)
    if languages is None:
        return rows
    extra = _csv(spark, languages, ["conceptUri", "preferredLabel", "altLabels"])
    for c in ("skillType", "description", "reuseLevel"):
        if c not in extra.columns:
            extra = extra.withColumn(c, F.lit(None).cast("string"))
    extra = _concepts(extra).withColumn("skill_type", F.lit("language"))
    both = rows.alias("a").join(extra.alias("b"), "concept_uri", "full_outer")
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    kind = F.when(F.col("b.preferred_label").isNotNull(), "language").otherwise(F.col("a.skill_type"))
    return both.select("concept_uri", pick("preferred_label"), pick("alt_labels"), kind.alias("skill_type"), pick("description"), pick("reuse_level"), pick("is_custom"))


def _concepts(raw: DataFrame) -> DataFrame:
    rows = raw.withColumn("ord", F.monotonically_increasing_id()).select(
        F.trim("conceptUri").alias("concept_uri"),
        F.trim("preferredLabel").alias("preferred_label"),
        text.first_wins(text.alternative_labels(F.col("altLabels")), F.trim("preferredLabel")).alias("alt_labels"),
        F.when(F.lower(F.trim("skillType")).isin(*KINDS), F.lower(F.trim("skillType"))).otherwise(KINDS[0]).alias("skill_type"),
        F.coalesce(F.trim("description"), F.lit("")).alias("description"),
        F.coalesce(F.trim("reuseLevel"), F.lit("")).alias("reuse_level"),
        "ord",
    )
    rows = rows.filter("concept_uri <> '' and preferred_label <> ''")
    w = Window.partitionBy("concept_uri").orderBy(F.desc("ord"))
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "ord").withColumn("is_custom", F.lit(False))


def second_labels(spark: SparkSession, path: str) -> DataFrame:
    """(concept_uri, surfaces): labels of another language and their forms without marks, junk off, each
    once; those of a concept that stands several times in file order."""
    raw = _csv(spark, path, ["conceptUri", "preferredLabel", "altLabels"])
    labels = F.concat(F.array(F.coalesce("preferredLabel", F.lit(""))), text.alternative_labels(F.col("altLabels")))
    surfaces = F.array_distinct(F.filter(F.flatten(F.transform(labels, text.surface_variants)), lambda s: ~text.junk_surface(s)))
    rows = raw.withColumn("ord", F.monotonically_increasing_id()).select(F.trim("conceptUri").alias("concept_uri"), "ord", surfaces.alias("s")).filter("concept_uri <> ''")
    lists = rows.groupBy("concept_uri").agg(F.array_sort(F.collect_list(F.struct("ord", "s"))).alias("l"))
    return lists.select("concept_uri", F.array_distinct(F.flatten(F.transform("l", lambda x: x["s"]))).alias("surfaces"))


def with_surfaces(base: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concepts with the extra surfaces folded into alt_labels, extra rows of unknown concepts)."""
    joined = base.join(extra, "concept_uri", "left")
    labels = text.first_wins(F.concat("alt_labels", F.coalesce("surfaces", F.array().cast("array<string>"))), F.col("preferred_label"))
    return joined.withColumn("alt_labels", labels).drop("surfaces"), extra.join(base, "concept_uri", "left_anti")


def custom_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Own concepts from JSON; a wrong prefix or a repeated id is an error."""
    rows = spark.read.schema("concepts array<struct<id:string,preferred_label:string,alt_labels:array<string>,skill_type:string,description:string,source_url:string>>").json(path, multiLine=True).selectExpr("inline(concepts)")
    bad = rows.groupBy("id").count().filter("count > 1 or not startswith(id, 'CUST:')").limit(1).collect()
    if bad:
        raise ValueError(f"bad custom concept id {bad[0]['id']}")
    return rows.select(F.col("id").alias("concept_uri"), "preferred_label", "alt_labels", "skill_type", "description", F.col("source_url").alias("reuse_level"), F.lit(True).alias("is_custom"))


def appended(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Both tables; an id in both is an error."""
    clash = extra.join(base, "concept_uri", "left_semi").limit(1).collect()
    if clash:
        raise ValueError(f"concept {clash[0]['concept_uri']} exists")
    return base.unionByName(extra)


def known_uris(*tables: DataFrame) -> DataFrame:
    """(concept_uri): every concept of any of the tables, once."""
    return reduce(DataFrame.union, (t.select("concept_uri") for t in tables)).filter("concept_uri is not null").distinct()


def hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """(level_0 .. level_3): the rows of a hierarchy CSV; blank levels are null, a missing column is an error."""
    raw = _csv(spark, path, [f"Level {k} URI" for k in range(4)])
    return raw.select(*(F.nullif(F.trim(f"Level {k} URI"), F.lit("")).alias(f"level_{k}") for k in range(4)))


def hierarchy_edges(levels: DataFrame) -> DataFrame:
    """(child, parent) between neighbouring levels of ``hierarchy``."""
    pairs = F.array(*(F.struct(F.col(f"level_{k + 1}").alias("child"), F.col(f"level_{k}").alias("parent")) for k in range(3)))
    return levels.select(F.inline(pairs)).filter("child is not null and parent is not null").distinct()


def broader_edges(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent, ord): the rows of a relations CSV in file order; ``closure`` takes the first parent of each."""
    raw = _csv(spark, path, ["conceptUri", "broaderUri"]).withColumn("ord", F.monotonically_increasing_id())
    return raw.select(F.trim("conceptUri").alias("child"), F.trim("broaderUri").alias("parent"), "ord").filter("child <> '' and parent <> ''")


def patterns(rows: DataFrame) -> DataFrame:
    """Concepts to (concept_uri, label, label_kind, surface), one row for each label."""
    first = rows.select("concept_uri", F.col("preferred_label").alias("label"), F.lit("preferred").alias("label_kind"), F.col("preferred_label").alias("surface"))
    other = rows.select("concept_uri", F.col("preferred_label").alias("label"), F.lit("alt").alias("label_kind"), F.explode("alt_labels").alias("surface"))
    return first.unionByName(other)


def fit_matrix(wide: DataFrame) -> DataFrame:
    """A wide judgment matrix to (cv_id, jd_id, fit); blank and unknown judgments are none."""
    long = wide.unpivot(["cv_id"], [c for c in wide.columns if c != "cv_id"], "jd_id", "fit")
    return long.withColumn("fit", F.lower(F.trim("fit"))).filter(F.col("fit").isin("strong", "possible", "no"))


def wide_matrix(long: DataFrame, positions: list[str]) -> DataFrame:
    return long.groupBy("cv_id").pivot("jd_id", positions).agg(F.first("fit"))


PAIRS = "pair_id string, cv_id string, pair_type string, text_span string, span_start int, span_end int, concept_uri string, section string, language string, module2_confidence double, _bad string"


def read_pairs(spark: SparkSession, path: str, most_bad: float = 0.05) -> DataFrame:
    """JSON lines of training pairs after a header line; too many unreadable lines are an error."""
    lines = spark.read.text(path)
    header = lines.filter("get_json_object(value, '$.pair_count') is not null").limit(1).count()
    if not header:
        raise ValueError("no header line")
    rows = lines.filter("get_json_object(value, '$.pair_count') is null").select(F.from_json("value", PAIRS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    n, bad = rows.agg(F.count("*"), F.count(F.when(F.col("pair_id").isNull(), 1))).first()
    if n and bad / n > most_bad:
        raise ValueError(f"{bad} of {n} lines are unreadable")
    return rows.filter("pair_id is not null").drop("_bad")


def write_pairs(rows: DataFrame, header: dict, path: str) -> None:
    """Header first, then pairs in (cv_id, span_start, span_end, pair_type, concept_uri) order, keys
    sorted; range-partitioned, so part files in name order are the file."""
    import json

    order = ["cv_id", "span_start", "span_end", "pair_type", "concept_uri"]
    spark = rows.sparkSession
    none = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
    first = spark.createDataFrame([(json.dumps(header, sort_keys=True),)], "_head string").select(F.lit(0).alias("_k"), *none, "_head")
    body = rows.select(F.lit(1).alias("_k"), "*", F.lit(None).cast("string").alias("_head"))
    line = F.coalesce("_head", F.to_json(F.struct(*sorted(rows.columns))))  # made after the sort, which moves the values alone
    first.unionByName(body).orderBy("_k", *order).select(line.alias("value")).write.text(path)


def concept_digest(rows: DataFrame) -> DataFrame:
    """One SHA-256 over all concepts in id order: hashes of ranges of ids, then of those."""
    rec = F.sha2(F.concat_ws("|", "concept_uri", "preferred_label", F.array_join(F.sort_array("alt_labels"), ";"), F.coalesce("description", F.lit(""))), 256)
    parts = rows.select(F.substring(F.sha2("concept_uri", 256), 1, 3).alias("range"), "concept_uri", rec.alias("rec"))
    each = parts.groupBy("range").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("concept_uri", "rec"))), lambda x: x["rec"]), ""), 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))


def save_index(rows: DataFrame, meta: dict[str, str], path: str) -> None:
    """Vectors (uri, vec) and one row of metadata."""
    rows.write.mode("overwrite").parquet(f"{path}/vectors")
    rows.sparkSession.createDataFrame([tuple(meta.values())], ", ".join(f"{k} string" for k in meta)).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, meta: dict[str, str], path: str) -> DataFrame:
    """The vectors, if every field of the metadata is as expected."""
    have = spark.read.parquet(f"{path}/meta").first().asDict()
    wrong = sorted(k for k in meta if have.get(k) != meta[k])
    if wrong:
        raise ValueError(f"index differs in {', '.join(wrong)}")
    return spark.read.parquet(f"{path}/vectors")


def documents_from_files(spark: SparkSession, path: str, extract) -> DataFrame:
    """(path, text, error): files read as binary and given to ``extract(bytes) -> str``; a file
    that fails gives an error and not a failed job.  Document parsers plug in here."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            texts, errors = [], []
            for content in pdf["content"]:
                try:
                    texts.append(extract(bytes(content)))
                    errors.append(None)
                except Exception as e:  # one bad file is a row, not a failure
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:4000])
            yield pd.DataFrame({"path": pdf["path"], "text": texts, "error": errors})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")


def cascade(attempts: DataFrame, enough: float = 0.5) -> DataFrame:
    """Of extraction attempts (doc_id, method_ord, method, text, score): the first that is
    sufficient, else the best."""
    key = F.struct(F.when(F.col("score") >= enough, -F.col("method_ord").cast("double")).otherwise(F.lit(float("-inf"))), F.col("score"), -F.col("method_ord"))
    return attempts.groupBy("doc_id").agg(F.max_by(F.struct("method", "text", "score"), key).alias("r")).select("doc_id", "r.*")
