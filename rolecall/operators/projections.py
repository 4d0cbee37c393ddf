"""What callers read and write: defaults, views of stored rows, summaries of runs and of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# ---- values ------------------------------------------------------------------


def training_anchor(query_text: Column, before: Column, span: Column, after: Column, most: int = 256) -> Column:
    """The text a pair is trained on: the window it was found in, else the span with its surroundings."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    around = F.trim(F.concat(*(F.coalesce(c, F.lit("")) for c in (before, span, after))))
    return F.left(F.coalesce(blank(query_text), around), F.lit(most))


def version_tag(name: str, version: str, encoder: Column) -> Column:
    """name@v<version>+encoder=<last part of the encoder's path>; ``default`` without one."""
    last = F.element_at(F.split(F.regexp_replace(encoder, r"[/\\]+$", ""), r"[/\\]"), -1)
    return F.concat(F.lit(f"{name}@v{version}+encoder="), F.coalesce(F.nullif(last, F.lit("")), F.lit("default")))


def short_key(*parts: Column) -> Column:
    """The first twelve digits of the SHA-256 of some values."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(12))


def user_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def text_profile(t: Column) -> Column:
    """(marked, broken_marks, phones, controls): letters with marks, replacement characters, numbers that look like phones, control characters."""
    n = lambda p: F.regexp_count(F.coalesce(t, F.lit("")), F.lit(p)).cast("int")
    return F.struct(n(f"[{text.MARKED}]").alias("marked"), n("�").alias("broken"), n(r"(?<![0-9])\+?[0-9](?:[ .()-]{0,2}[0-9]){8,13}(?![0-9])").alias("phones"), n(r"[\x00-\x08\x0B\x0C\x0E-\x1F]").alias("controls"))


# ---- rows in and out -----------------------------------------------------------


def requirement_inputs(rows: DataFrame) -> DataFrame:
    """Requirements as callers send them, with defaults: 0.5 sure, ``required``, MANUAL unless extracted; blank texts go."""
    kind = F.when(F.lower(F.trim("importance")) == "nice_to_have", "nice_to_have").otherwise("required")
    source = F.when(F.upper(F.trim("source")) == "EXTRACTED", "EXTRACTED").otherwise("MANUAL")
    new = {"text": F.trim("text"), "importance": kind, "req_conf": F.coalesce("req_conf", F.lit(0.5)), "source": source}
    return rows.withColumns(new).filter("text <> ''")


_WIRE = ("cv_id", "skill_uri", "label", "confidence", "source", "similarity")


def to_wire(candidates: DataFrame) -> DataFrame:
    """(cv_id, candidates): what a caller gets of the candidates of a document, best first, as JSON."""
    each = F.struct(*(c for c in _WIRE if c != "cv_id"))
    rows = candidates.groupBy("cv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), F.col("skill_uri").alias("u"), each.alias("c")))).alias("list"))
    return rows.select("cv_id", F.to_json(F.transform("list", lambda x: x["c"])).alias("candidates"))


def from_wire(rows: DataFrame) -> DataFrame:
    """Candidates as they come back: places and lexical confidence are not sent, so they are null."""
    kind = "array<struct<skill_uri:string,label:string,confidence:double,source:string,similarity:double>>"
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    return rows.select("cv_id", F.inline(F.from_json("candidates", kind))).select(*_WIRE, none("start", "int"), none("end", "int"), none("lexical_confidence", "double"))


def document_views(documents: DataFrame) -> DataFrame:
    """Stored documents (id, file_name, extracted, form_email, manual_email, extracted_email) as callers see them."""
    email = text.effective_email(F.col("form_email"), F.col("manual_email"), F.col("extracted_email"))
    return documents.select("id", "file_name", F.col("extracted").isNotNull().alias("extraction_cached"), email["email"].alias("email"), email["source"].alias("email_source"))


def position_views(positions: DataFrame, requirements: DataFrame) -> DataFrame:
    """Positions (jd_id, title) with their requirements (jd_id, sort_order, text, importance) as one ordered list."""
    lists = requirements.groupBy("jd_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "text", "importance"))).alias("requirements"))
    none = F.array().cast(lists.schema["requirements"].dataType)
    return positions.join(lists, "jd_id", "left").select("jd_id", "title", F.coalesce("requirements", none).alias("requirements"))


def job_views(jobs: DataFrame) -> DataFrame:
    """Match jobs (id, status, report) with the leading figures of their report; a report that is no JSON object is null, not an error."""
    report = F.try_parse_json("report")
    figure = lambda p, t: F.try_variant_get(report, p, t)
    whole = F.when(F.coalesce(F.startswith(F.schema_of_variant(report), F.lit("OBJECT")), F.lit(False)), F.col("report"))
    return jobs.select("id", "status", whole.alias("report"), figure("$.top_score", "double").alias("top_score"), figure("$.candidates", "int").alias("candidates"))


def contact_rows(reports: DataFrame, overrides: DataFrame) -> DataFrame:
    """(cv_id, name, email): contacts of chosen candidates; the name falls back to the file name
    without its ending, the address to an override of the caller, but one from the form wins."""
    local = overrides.select("cv_id", user_email(F.col("email")).alias("own"))
    form = F.when(F.col("email_source") == "FORM", F.col("email"))
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.regexp_replace("file_name", r"\.[A-Za-z0-9]{1,5}$", ""))
    return reports.join(local, "cv_id", "left").select("cv_id", name.alias("name"), F.coalesce(form, F.nullif("own", F.lit("")), F.col("email")).alias("email"))


def active_links(positions: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, jd_id) for tokens of positions (jd_id, token, enabled) whose link is on; others are not found (null)."""
    on = positions.filter("enabled").select("token", "jd_id")
    return tokens.select("token").join(on, "token", "left").select("token", "jd_id")


def ordered_examples(examples: DataFrame) -> DataFrame:
    """Training examples in (cv, kind, positive, negative or blank) order."""
    return examples.orderBy("cv_id", "kind", "positive", F.coalesce("negative", F.lit("")))


def label_changes(labels: DataFrame, updates: DataFrame) -> DataFrame:
    """Labels (cv_id, label, level) after curation (cv_id, label, level or null, reject): a rejected label becomes
    ``negative``, a named level replaces the old one, an absent label is added; the rest stays."""
    u = updates.groupBy("cv_id", "label").agg(F.bool_or("reject").alias("reject"), F.max("level").alias("new"))
    level = F.when(F.col("reject"), "negative").otherwise(F.coalesce("new", "level"))
    return labels.join(u, ["cv_id", "label"], "full_outer").select("cv_id", "label", level.alias("level")).filter("level is not null")


# ---- runs and models -------------------------------------------------------------


def run_summary(attempts: DataFrame, skills: DataFrame) -> DataFrame:
    """One row for each document of a run (doc_id, error, supported): status (ok, refused, failed), number of
    skills (doc_id, section, confidence), their mean confidence, and how many each section has."""
    part = skills.groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"))
    g = part.groupBy("doc_id").agg(F.sum("n").alias("skills"), (F.sum("s") / F.sum("n")).alias("mean_confidence"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "n")))).alias("sections"))
    status = F.when(F.col("error").isNotNull(), "failed").when(~F.col("supported"), "refused").otherwise("ok")
    return attempts.join(g, "doc_id", "left").select("doc_id", status.alias("status"), F.coalesce("skills", F.lit(0)).alias("skills"), "mean_confidence", "sections")


def alignment(samples: DataFrame, a: str, b: str) -> DataFrame:
    """(sampled, differs, verdict): do two renderings of the same things agree?"""
    n = F.count(F.when(~F.col(a).eqNullSafe(F.col(b)), 1))
    return samples.agg(F.count("*").alias("sampled"), n.alias("differs"), F.when(n > 0, "drifted").otherwise("aligned").alias("verdict"))


def ablation(figures: DataFrame, by: list[str], value: str = "f1") -> DataFrame:
    """Mean figure of each cell of a grid, whether its cell is the first best one (rounded to nine places)."""
    cells = figures.groupBy(*by).agg(F.avg(value).alias(value))
    best = cells.agg(F.min(F.struct(-F.round(value, 9), *by)).alias("best"))
    return cells.join(F.broadcast(best)).select(*by, value, (F.struct(-F.round(value, 9), *by) == F.col("best")).alias("winner"))


def latency_projection(stages: DataFrame, total: str, count: int) -> DataFrame:
    """(stage, mean_ms, share, projected_s): the mean time of each stage (run, stage, ms), its part of that of
    stage ``total``, and the seconds that ``count`` runs would take."""
    means = stages.groupBy("stage").agg(F.avg("ms").alias("mean_ms"))
    whole = F.broadcast(means.filter(F.col("stage") == total).select(F.col("mean_ms").alias("whole")))
    return means.join(whole).select("stage", "mean_ms", F.when(F.col("whole") > 0, F.col("mean_ms") / F.col("whole")).alias("share"), (F.col("mean_ms") * count / 1000).alias("projected_s"))


def headline(before: DataFrame, after: DataFrame, figures: list[str]) -> DataFrame:
    """(predictor, view, figure, before, after, delta) of two runs (predictor, view, figures...)."""
    long = lambda rows, name: rows.unpivot(["predictor", "view"], figures, "figure", name)
    both = long(before, "before").join(long(after, "after"), ["predictor", "view", "figure"], "full_outer")
    return both.select("predictor", "view", "figure", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def training_curve(rows: DataFrame) -> DataFrame:
    """(epoch, value) of the rows of a curve file (epoch, value as text) in which both are numbers."""
    return rows.select(F.expr("try_cast(trim(epoch) as double)").alias("epoch"), F.expr("try_cast(trim(value) as double)").alias("value")).filter("epoch is not null and value is not null and not isnan(epoch) and not isnan(value)")


def manifests(rows: DataFrame, needed: list[str]) -> DataFrame:
    """(path, manifest, missing): JSON manifests of runs (path, text) with the required fields that they lack; all, if it is no object."""
    v = F.try_parse_json("text")
    lacks = F.array_compact(F.array(*(F.when(F.try_variant_get(v, f"$.{k}", "string").isNull(), k) for k in needed)))
    return rows.select("path", F.when(F.size(lacks) == 0, F.col("text")).alias("manifest"), lacks.alias("missing"))
