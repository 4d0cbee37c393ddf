"""Pools, applications, dashboards, uploads, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import effective_email


def first_of(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key in an order; aggregated, so a hot key is combined before the shuffle."""
    names = [f"k{i}" for i in range(len(key))]
    every = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[(k if isinstance(k, Column) else F.col(k)).alias(n) for k, n in zip(key, names)]).agg(F.min_by(every, F.struct(*order)).alias("r")).select("r.*")


def latest(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The last row of each key in an order."""
    every = F.struct(*[F.col(c) for c in rows.columns])
    names = [f"k{i}" for i in range(len(key))]
    return rows.groupBy(*[(k if isinstance(k, Column) else F.col(k)).alias(n) for k, n in zip(key, names)]).agg(F.max_by(every, F.struct(*order)).alias("r")).select("r.*")


def pool(applications: DataFrame, cvs: DataFrame, jd_id, sources: list) -> DataFrame:
    """Candidates of a position: its own applications, then those of other positions, one for
    each content hash (or id where there is none); direct ones win, then the earliest."""
    a = applications.filter(F.col("jd_id").isin([jd_id, *sources])).join(cvs.select(F.col("id").alias("cv_id"), "content_hash"), "cv_id")
    a = a.withColumn("priority", F.when(F.col("jd_id") == jd_id, 0).otherwise(1)).withColumn("origin", F.when(F.col("jd_id") == jd_id, "DIRECT").otherwise("OTHER_JD"))
    return first_of(a, [F.coalesce(F.col("content_hash"), F.col("cv_id").cast("string"))], ["priority", "created_at", "id"])


def application_list(applications: DataFrame, cvs: DataFrame) -> DataFrame:
    c = cvs.select(F.col("id").alias("cv_id"), "original_filename", "manual_email", "extracted_email")
    rows = applications.join(c, "cv_id", "left").withColumn("e", effective_email(F.col("candidate_email"), F.col("manual_email"), F.col("extracted_email")))
    return rows.select("id", "jd_id", "cv_id", "original_filename", F.col("e.email").alias("email"), F.col("e.source").alias("email_source"))


def dashboard(positions: DataFrame, applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """Positions with their application count and the latest job of each; newest first by caller's sort."""
    counts = applications.groupBy("jd_id").agg(F.count("*").alias("applications"))
    last = latest(jobs, ["jd_id"], ["created_at", "id"]).select("jd_id", "status", "top_score", "candidate_count")
    good = latest(jobs.filter("status = 'SUCCEEDED'"), ["jd_id"], ["finished_at", "id"]).select("jd_id", F.col("finished_at").alias("last_success"))
    return positions.join(counts, "jd_id", "left").join(last, "jd_id", "left").join(good, "jd_id", "left").withColumn("applications", F.coalesce("applications", F.lit(0)))


def kpis(positions: DataFrame, applications: DataFrame, cvs: DataFrame, jobs: DataFrame) -> DataFrame:
    a = positions.agg(F.count("*").alias("open_positions"))
    b = applications.agg(F.count_distinct("cv_id").alias("unique_candidates"))
    c = cvs.agg(F.count(F.when(F.col("processing_status").isin("PENDING", "PROCESSING"), 1)).alias("processing"))
    d = jobs.filter("status = 'SUCCEEDED'").agg(F.max("finished_at").alias("last_match"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # four rows of one


def attached(requested: DataFrame, owned: DataFrame, linked: DataFrame) -> DataFrame:
    """Distinct requested ids as CREATED, ALREADY or NOT_FOUND."""
    r = requested.select("cv_id").distinct()
    o = owned.select("cv_id", F.lit(True).alias("owned")).distinct()
    k = linked.select("cv_id", F.lit(True).alias("linked")).distinct()
    status = F.when(F.col("owned").isNull(), "NOT_FOUND").when(F.col("linked"), "ALREADY").otherwise("CREATED")
    return r.join(o, "cv_id", "left").join(k, "cv_id", "left").select("cv_id", status.alias("status"))


def valid_sources(requested: DataFrame, owned: DataFrame, jd_id) -> DataFrame:
    """Requested source positions, each once in first order, with a reason where one is rejected."""
    r = requested.groupBy("source_id").agg(F.min("ord").alias("ord"))
    o = owned.select(F.col("jd_id").alias("source_id"), F.lit(True).alias("owned")).distinct()
    reason = F.when(F.col("source_id") == jd_id, "SELF").when(F.col("owned").isNull(), "FOREIGN")
    return r.join(o, "source_id", "left").select("source_id", "ord", reason.alias("reject_reason"))


def orphans(documents: DataFrame, applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with no application and no job."""
    return documents.join(applications, "cv_id", "left_anti").join(jobs, "cv_id", "left_anti")


def upload(batch: DataFrame, existing: DataFrame, most_bytes: int = 10 * 2**20) -> DataFrame:
    """Files (ord, name, content_type, content) as created, duplicate (of the library or earlier in
    the batch) or rejected with a reason; one bad file does not stop the rest."""
    reason = F.when(F.length("content") == 0, "EMPTY").when(F.col("content_type") != "application/pdf", "TYPE").when(F.length("content") > most_bytes, "SIZE").when(F.substring("content", 1, 5) != F.lit("%PDF-").cast("binary"), "MAGIC")
    rows = batch.select("ord", "name", reason.alias("reject_reason"), F.sha2("content", 256).alias("content_hash"))
    w = Window.partitionBy("content_hash", F.col("reject_reason").isNull()).orderBy("ord")
    e = existing.select("content_hash", F.lit(True).alias("known")).distinct()
    status = F.when(F.col("reject_reason").isNotNull(), "rejected").when(F.col("known") | (F.col("r") > 1), "duplicate").otherwise("created")
    return rows.withColumn("r", F.row_number().over(w)).join(e, "content_hash", "left").select("ord", "name", "content_hash", status.alias("status"), "reject_reason")


def valid_application(name: Column, email: Column, phone: Column) -> Column:
    """A reject reason, or null."""
    return (
        F.when(F.coalesce(F.length(F.trim(name)), F.lit(0)) == 0, "NAME")
        .when(~F.coalesce(email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False)), "EMAIL")
        .when(phone.isNotNull() & ~phone.rlike(r"^[+0-9 ().-]{6,20}$"), "PHONE")
    )


def history(jobs: DataFrame, owner, jd_id=None, status=None) -> DataFrame:
    rows = jobs.filter(F.col("owner_id") == owner)
    if jd_id is not None:
        rows = rows.filter(F.col("jd_id") == jd_id)
    return rows if status is None else rows.filter(F.col("status") == status)


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page in an order, with the totals; Spark keeps the best rows of each task only."""
    total = rows.agg(F.count("*").alias("total_elements")).withColumn("total_pages", F.ceil(F.col("total_elements") / size))
    part = rows.orderBy(*order).offset(number * size).limit(size)
    return part.crossJoin(F.broadcast(total))


def upserted(current: DataFrame, changes: DataFrame, key: list, order: str) -> DataFrame:
    """Rows by key, the latest of both tables."""
    return latest(current.unionByName(changes), key, [order])


def reapplied(current: DataFrame, changes: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applications, orphans) after changes (id, jd_id, email, cv_id, at, ...): the latest application of each position
    and address, in any case, stays, and documents (cv_id) that only replaced ones held are orphans."""
    kept = latest(current.unionByName(changes), ["jd_id", F.lower(F.trim("email"))], ["at", "id"])
    held = current.unionByName(changes).select("cv_id").distinct()
    return kept, documents.join(held, "cv_id", "left_semi").join(kept.select("cv_id").distinct(), "cv_id", "left_anti")


def merged_labels(labels: DataFrame, updates: DataFrame) -> DataFrame:
    """Labels (cv_id, label, level) with updates of the same shape: promoted, or added if absent."""
    u = updates.select("cv_id", "label", F.col("level").alias("new_level"))
    return labels.join(u, ["cv_id", "label"], "full_outer").select("cv_id", "label", F.coalesce("new_level", "level").alias("level"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule; a null outcome breaks it."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), (~F.coalesce(c, F.lit(False))).cast("int").alias("bad")) for k, c in rules.items()))).alias("x")
    return rows.select(each).groupBy("x.rule").agg(F.sum("x.bad").cast("long").alias("n"))
