"""Further registered queries: values and views that callers read, summaries, readers and writers of files."""

from __future__ import annotations

import importlib.util
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.lineage import cut, shared_folder
from ..operators import operations, preparation, projections, scoring
from ..sources import bundle, overlays, taxonomy
from .queries import T, query, r6

# ---- values ------------------------------------------------------------------


@query(
    r"""
WITH b AS (SELECT doc_id, text, source, length(text) // 3 AS s, least(length(text) // 3 + 12, length(text)) AS e FROM documents WHERE length(text) > 0),
c AS (SELECT *, substr(text, greatest(s - 50, 0) + 1, least(s, 50)) AS l, substr(text, e + 1, 50) AS r, substr(text, s + 1, e - s) AS span FROM b)
SELECT doc_id, regexp_replace(l, '(?s)^.*[.!?\n]\s*', '') AS "before", regexp_extract(r, '(?s)^[^.!?\n]*') AS "after", coalesce(nullif(left(trim(substr(text, greatest(s - 50, 0) + 1, e + 50 - greatest(s - 50, 0)), ' '), 256), ''), nullif(trim(span, ' '), ''), '?') AS anchor,
  CASE WHEN coalesce(trim(source, ' '), '') IN ('', 'other', 'unknown') THEN span ELSE span || ' (' || source || ')' END AS evidence,
  left(CASE WHEN doc_id % 3 > 0 AND trim(l, ' ') <> '' THEN trim(l, ' ') ELSE trim(l || span || r, ' ') END, 256) AS training_anchor FROM c"""
)
def text_anchors(spark, d):
    """PRJ10 to PRJ13: sentence-aware context, anchor, training anchor and evidence of a span of every text."""
    s = F.floor(F.length("text") / 3).cast("int")
    e = F.least(s + 12, F.length("text"))
    rows = T(spark, d, "documents").filter("length(text) > 0").withColumns({"s": s, "e": e}).withColumns({
        "l": F.substring("text", F.greatest(F.col("s") - 50, F.lit(0)) + 1, F.least("s", F.lit(50))), "span": F.substring("text", F.col("s") + 1, F.col("e") - F.col("s")), "r": F.substring("text", F.col("e") + 1, F.lit(50)),
    })
    near = text.context(F.col("text"), F.col("s"), F.col("e"))
    window = F.when(F.col("doc_id") % 3 > 0, F.col("l"))
    return rows.select(
        "doc_id", near["before"].alias("before"), near["after"].alias("after"), text.anchor(F.col("text"), F.col("s"), F.col("e")).alias("anchor"), text.evidence(F.col("span"), F.col("source")).alias("evidence"),
        projections.training_anchor(window, F.col("l"), F.col("span"), F.col("r")).alias("training_anchor"),
    )


@query(
    r"""
SELECT doc_id, CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[MARKED]', '', 'g')) AS INT) AS marked, CAST(length(regexp_replace(coalesce(text, ''), '[^\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS INT) AS controls,
  'engine@v1.2+encoder=' || coalesce(nullif(source, ''), 'default') AS tag, left(sha256(concat_ws('|', source, lang)), 12) AS key, lower(trim(lang || ' ', ' ')) AS email FROM documents""".replace("MARKED", text.MARKED)
)
def text_profiles(spark, d):
    """SCL25, PRJ18, SCL11, SCL28: profile of each text, version tag, short key, address in its stored form."""
    p = projections.text_profile(F.col("text"))
    tag = projections.version_tag("engine", "1.2", F.concat(F.lit("/models/x/"), "source", F.lit("/")))
    return T(spark, d, "documents").select("doc_id", p["marked"].alias("marked"), p["controls"].alias("controls"), tag.alias("tag"), projections.short_key(F.col("source"), F.col("lang")).alias("key"), projections.user_email(F.concat("lang", F.lit(" "))).alias("email"))


@query(
    """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e)
SELECT vec_id, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 6) AS first, round(CASE WHEN n > 0 THEN list_sum(v) / n ELSE 0 END, 6) AS total FROM n"""
)
def unit_vectors(spark, d):
    """SCL14: vectors at length one."""
    v = scores.normalised(F.col("embedding").cast("array<double>"))
    return T(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", r6(F.col("v")[0], "first"), r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), "total"))


# ---- rows in and out -----------------------------------------------------------


@query(
    """
SELECT l_orderkey AS jd_id, l_linenumber AS req_ord, 'part ' || l_partkey AS text, CASE WHEN l_returnflag = 'N' THEN 'nice_to_have' ELSE 'required' END AS importance,
  round(CASE WHEN l_linestatus = 'O' THEN 0.5 ELSE l_discount END, 6) AS confidence, CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' ELSE 'MANUAL' END AS source FROM lineitem WHERE l_tax > 0"""
)
def requirement_inputs(spark, d):
    """PRJ25, PRJ30: requirements with defaults for what the caller left out; blank texts go."""
    li = T(spark, d, "lineitem")
    rows = li.select(
        F.col("l_orderkey").alias("jd_id"), F.col("l_linenumber").alias("req_ord"), F.when(F.col("l_tax") > 0, F.concat(F.lit(" part "), F.col("l_partkey").cast("string"))).otherwise("  ").alias("text"),
        F.when(F.col("l_returnflag") == "N", " NICE_to_have").when(F.col("l_returnflag") == "A", "other").alias("importance"), F.when(F.col("l_linestatus") != "O", F.col("l_discount").cast("double")).alias("req_conf"), F.when(F.col("l_returnflag") == "A", "extracted").alias("source"),
    )
    return projections.requirement_inputs(rows).select("jd_id", "req_ord", "text", "importance", r6(F.col("req_conf"), "confidence"), "source")


@query(
    """
WITH l AS (SELECT l_orderkey AS jd_id, list('p' || l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag <> 'N') AS req, list('p' || l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'N') AS nice FROM lineitem GROUP BY 1),
a AS (SELECT jd_id, unnest(req) AS text, 'required' AS importance, unnest(range(len(req))) AS req_ord FROM l UNION ALL SELECT jd_id, unnest(nice), 'nice_to_have', coalesce(len(req), 0) + unnest(range(len(nice))) FROM l)
SELECT jd_id, CAST(req_ord AS INT) AS req_ord, text, importance, 0.5 AS req_conf FROM a"""
)
def requirement_rows(spark, d):
    """PRJ15: lists of a position's skills to requirement rows, required ones first."""
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("l_linenumber", "l_partkey")))), lambda s: F.concat(F.lit("p"), s["l_partkey"].cast("string")))
    rows = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("jd_id")).agg(part(F.col("l_returnflag") != "N").alias("required_skills"), part(F.col("l_returnflag") == "N").alias("nice_to_have_skills"))
    return scoring.requirement_rows(rows).select("jd_id", "req_ord", "text", "importance", "req_conf")


@query(
    """
WITH c AS (SELECT l_suppkey AS cv_id, CAST(l_partkey AS VARCHAR) AS skill_uri, max(round(l_quantity / 50, 6)) AS confidence FROM lineitem GROUP BY 1, 2)
SELECT cv_id, skill_uri, 'p' || skill_uri AS label, confidence, 'lexical_kept' AS source, NULL AS similarity, true AS lost FROM c"""
)
def wire_round_trip(spark, d):
    """PRJ16: candidates as a caller gets them and sends them back; places do not travel."""
    c = T(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cv_id"), F.col("l_partkey").cast("string").alias("skill_uri")).agg(F.max(F.round(F.col("l_quantity") / 50, 6)).alias("confidence"))
    c = c.select("cv_id", "skill_uri", F.concat(F.lit("p"), "skill_uri").alias("label"), F.col("confidence").cast("double").alias("confidence"), F.lit("lexical_kept").alias("source"), F.lit(None).cast("double").alias("similarity"), F.lit(1).alias("start"))
    back = projections.from_wire(projections.to_wire(c))
    return back.select("cv_id", "skill_uri", "label", "confidence", "source", "similarity", (F.col("start").isNull() & F.col("end").isNull() & F.col("lexical_confidence").isNull()).alias("lost"))


@query(
    """
SELECT c_custkey AS id, c_name || '.pdf' AS file_name, c_acctbal > 0 AS extraction_cached, CASE WHEN c_nationkey % 3 = 0 THEN 'form@x.org' WHEN c_nationkey % 3 = 1 AND c_nationkey > 5 THEN 'manual@x.org' WHEN c_acctbal > 0 THEN 'text@x.org' END AS email,
  CASE WHEN c_nationkey % 3 = 0 THEN 'FORM' WHEN c_nationkey % 3 = 1 AND c_nationkey > 5 THEN 'MANUAL' WHEN c_acctbal > 0 THEN 'EXTRACTED' ELSE 'NONE' END AS email_source,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Name' ELSE c_name END AS contact, CASE WHEN c_nationkey % 3 = 0 THEN 'form@x.org' WHEN c_custkey % 4 = 1 THEN 'own@x.org' WHEN c_nationkey % 3 = 1 AND c_nationkey > 5 THEN 'manual@x.org' WHEN c_acctbal > 0 THEN 'text@x.org' END AS contact_email FROM customer"""
)
def document_views(spark, d):
    """PRJ27, PRJ33: stored documents as callers see them, and the contacts chosen from them."""
    n, c = F.col("c_nationkey"), T(spark, d, "customer")
    got = F.when(F.col("c_acctbal") > 0, "Text@x.org")
    rows = c.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(".pdf")).alias("file_name"), got.alias("extracted"), F.when(n % 3 == 0, "FORM@x.org ").alias("form_email"), F.when((n % 3 == 1) & (n > 5), "manual@x.org").otherwise(" ").alias("manual_email"), got.alias("extracted_email"))
    views = projections.document_views(rows)
    chosen = views.join(c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "Name ").otherwise(" ").alias("name")), "id").withColumnRenamed("id", "cv_id")
    own = c.filter("c_custkey % 4 = 1").select(F.col("c_custkey").alias("cv_id"), F.lit(" OWN@x.org").alias("email"))
    contacts = projections.contact_rows(chosen, own).select(F.col("cv_id").alias("id"), F.col("name").alias("contact"), F.col("email").alias("contact_email"))
    return views.join(contacts, "id")


@query(
    """
WITH r AS (SELECT l_orderkey AS jd_id, string_agg(l_linenumber || ':p' || l_partkey || ':' || CASE WHEN l_returnflag = 'N' THEN 'nice_to_have' ELSE 'required' END, ';' ORDER BY l_linenumber, 'p' || l_partkey, CASE WHEN l_returnflag = 'N' THEN 'nice_to_have' ELSE 'required' END) AS list FROM lineitem GROUP BY 1)
SELECT o_orderkey AS jd_id, o_orderpriority AS title, coalesce(list, '') AS requirements FROM orders LEFT JOIN r ON jd_id = o_orderkey"""
)
def position_views(spark, d):
    """PRJ28: positions with their requirements as one ordered list."""
    req = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("jd_id"), F.col("l_linenumber").alias("sort_order"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"), F.when(F.col("l_returnflag") == "N", "nice_to_have").otherwise("required").alias("importance"))
    v = projections.position_views(T(spark, d, "orders").select(F.col("o_orderkey").alias("jd_id"), F.col("o_orderpriority").alias("title")), req)
    return v.select("jd_id", "title", F.array_join(F.transform("requirements", lambda r: F.concat_ws(":", r["sort_order"].cast("string"), r["text"], r["importance"])), ";").alias("requirements"))


@query(
    """
SELECT event_id AS id, event_type AS status, CASE WHEN event_type <> 'click' AND value IS NOT NULL THEN '{"top_score": ' || CAST(event_id % 7 AS VARCHAR) || '.5, "k": ' || props || '}' END AS report, CASE WHEN event_type <> 'click' AND value IS NOT NULL THEN event_id % 7 + 0.5 END AS top_score, NULL AS candidates FROM events"""
)
def job_views(spark, d):
    """PRJ29, SCL21: match jobs with the figures of their stored report; one that cannot be read is null."""
    e = T(spark, d, "events")
    report = F.when(F.col("value").isNull(), F.lit("[1]")).when(F.col("event_type") == "click", F.lit("{broken")).otherwise(F.concat(F.lit('{"top_score": '), (F.col("event_id") % 7).cast("string"), F.lit('.5, "k": '), "props", F.lit("}")))
    return projections.job_views(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), report.alias("report")))


@query("SELECT 't' || c_custkey AS token, o.jd_id FROM customer LEFT JOIN (SELECT DISTINCT 't' || o_orderkey AS token, o_orderkey AS jd_id FROM orders WHERE o_orderstatus <> 'F') o ON o.token = 't' || c_custkey")
def active_links(spark, d):
    """FLT18: the position of each token whose link is on."""
    positions = T(spark, d, "orders").select(F.col("o_orderkey").alias("jd_id"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("token"), (F.col("o_orderstatus") != "F").alias("enabled")).distinct()
    return projections.active_links(positions, T(spark, d, "customer").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token")))


@query(
    """
WITH l AS (SELECT DISTINCT l_suppkey AS cv_id, l_partkey AS label FROM lineitem WHERE l_returnflag <> 'N'), u AS (SELECT l_suppkey AS cv_id, l_partkey AS label, bool_or(l_linestatus = 'O') AS reject, max(CASE WHEN l_linestatus <> 'O' THEN 'high' END) AS new FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2),
x AS (SELECT cv_id, label, CASE WHEN reject THEN 'negative' ELSE coalesce(new, CASE WHEN l.cv_id IS NOT NULL THEN 'medium' END) END AS level FROM l FULL JOIN u USING (cv_id, label))
SELECT cv_id, label, level FROM x WHERE level IS NOT NULL"""
)
def label_curation(spark, d):
    """JON31: labels after curation; rejected ones become negatives."""
    li = T(spark, d, "lineitem").withColumnsRenamed({"l_suppkey": "cv_id", "l_partkey": "label"})
    labels = li.filter("l_returnflag <> 'N'").select("cv_id", "label", F.lit("medium").alias("level")).distinct()
    updates = li.filter("l_returnflag = 'N'").select("cv_id", "label", F.when(F.col("l_linestatus") != "O", "high").alias("level"), (F.col("l_linestatus") == "O").alias("reject"))
    return projections.label_changes(labels, updates)


# ---- runs and models -------------------------------------------------------------


@query(
    """
WITH s AS (SELECT l_orderkey AS doc_id, l_returnflag AS section, count(*) AS n, sum(l_discount) AS c FROM lineitem GROUP BY 1, 2), g AS (SELECT doc_id, sum(n) AS skills, sum(c) / sum(n) AS m, string_agg(section || '=' || n, ',' ORDER BY section) AS sections FROM s GROUP BY 1)
SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' WHEN o_orderstatus = 'P' THEN 'refused' ELSE 'ok' END AS status, CAST(coalesce(skills, 0) AS BIGINT) AS skills, round(m, 6) AS mean_confidence, coalesce(sections, '') AS sections FROM orders LEFT JOIN g ON doc_id = o_orderkey"""
)
def run_summaries(spark, d):
    """PRJ32: status, number and mean confidence of skills, and their sections, for each document of a run."""
    attempts = T(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderpriority") == "5-LOW", "bad").alias("error"), (F.col("o_orderstatus") != "P").alias("supported"))
    skills = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("section"), F.col("l_discount").alias("confidence"))
    s = projections.run_summary(attempts, skills)
    return s.select("doc_id", "status", "skills", r6(F.col("mean_confidence"), "mean_confidence"), F.coalesce(F.array_join(F.transform(F.map_entries("sections"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","), F.lit("")).alias("sections"))


@query(
    """
WITH a AS (SELECT l_returnflag AS form, l_linenumber AS stride, avg(l_discount) AS f1 FROM lineitem GROUP BY 1, 2)
SELECT form, stride, round(f1, 6) AS f1, row_number() OVER (ORDER BY round(f1, 9) DESC, form, stride) = 1 AS winner FROM a"""
)
def ablation_grid(spark, d):
    """AGG42: the mean figure of each cell of a grid; the first best one wins."""
    rows = T(spark, d, "lineitem").select(F.col("l_returnflag").alias("form"), F.col("l_linenumber").alias("stride"), F.col("l_discount").alias("f1"))
    return projections.ablation(rows, ["form", "stride"]).select("form", "stride", r6(F.col("f1"), "f1"), "winner")


@query(
    """
WITH m AS (SELECT event_type AS stage, avg(value) AS mean_ms FROM events GROUP BY 1 UNION ALL SELECT 'all', avg(value) FROM events), w AS (SELECT mean_ms AS whole FROM m WHERE stage = 'all')
SELECT stage, round(mean_ms, 6) AS mean_ms, round(mean_ms / whole, 6) AS share, round(mean_ms * 500 / 1000, 6) AS projected_s FROM m, w"""
)
def latency_projection(spark, d):
    """AGG44: mean time of each stage, its share, and what 500 runs would take."""
    e = T(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return projections.latency_projection(e.union(e.select(F.lit("all"), "ms")), "all", 500).select("stage", *(r6(F.col(c), c) for c in ("mean_ms", "share", "projected_s")))


@query(
    """
WITH a AS (SELECT l_returnflag AS predictor, l_linestatus AS view, avg(l_discount) AS p, max(l_tax) AS r FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), b AS (SELECT l_returnflag AS predictor, l_linestatus AS view, avg(l_discount) AS p, max(l_tax) AS r FROM lineitem WHERE l_linenumber > 3 AND l_returnflag <> 'A' GROUP BY 1, 2),
x AS (SELECT predictor, view, 'p' AS figure, p AS v FROM a UNION ALL SELECT predictor, view, 'r', r FROM a), y AS (SELECT predictor, view, 'p' AS figure, p AS v FROM b UNION ALL SELECT predictor, view, 'r', r FROM b)
SELECT predictor, view, figure, round(x.v, 6) AS "before", round(y.v, 6) AS "after", round(y.v - x.v, 6) AS delta FROM x FULL JOIN y USING (predictor, view, figure)"""
)
def model_headline(spark, d):
    """AGG45: the figures of two runs side by side, with their differences."""
    run = lambda c: T(spark, d, "lineitem").filter(c).groupBy(F.col("l_returnflag").alias("predictor"), F.col("l_linestatus").alias("view")).agg(F.avg("l_discount").alias("p"), F.max("l_tax").alias("r"))
    h = projections.headline(run("l_linenumber <= 3"), run("l_linenumber > 3 and l_returnflag <> 'A'"), ["p", "r"])
    return h.select("predictor", "view", "figure", *(r6(F.col(c), c) for c in ("before", "after", "delta")))


@query("SELECT count(*) AS sampled, count(*) FILTER (p_name || '. ' || p_type <> p_name || '. ' || CASE WHEN p_size > 40 THEN lower(p_type) ELSE p_type END) AS differs, CASE WHEN count(*) FILTER (p_size > 40 AND lower(p_type) <> p_type) > 0 THEN 'drifted' ELSE 'aligned' END AS verdict FROM part")
def alignment_audit(spark, d):
    """AGG35: do two renderings of each concept agree?"""
    form = lambda c: text.concept_text(F.col("p_name"), F.array().cast("array<string>"), c)
    rows = T(spark, d, "part").select(form(F.col("p_type")).alias("a"), form(F.when(F.col("p_size") > 40, F.lower("p_type")).otherwise(F.col("p_type"))).alias("b"))
    return projections.alignment(rows, "a", "b")


@query("SELECT CAST(event_id AS DOUBLE) AS epoch, round(value, 6) AS value FROM events WHERE value IS NOT NULL AND event_type <> 'click'")
def training_curves(spark, d):
    """SRC22: rows of a curve file in which both fields are numbers."""
    e = T(spark, d, "events")
    rows = e.select(F.concat(F.lit(" "), F.col("event_id").cast("string")).alias("epoch"), F.when(F.col("event_type") == "click", "n/a").otherwise(F.round("value", 6).cast("string")).alias("value"))
    return projections.training_curve(rows).select("epoch", r6(F.col("value"), "value"))


@query("SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_type = 'click' THEN 'k,seed' WHEN event_type = 'view' THEN 'seed' ELSE '' END AS missing, event_type NOT IN ('click', 'view') AS valid FROM events")
def run_manifests(spark, d):
    """SRC23: manifests of runs with the fields they lack."""
    seed = F.when(F.col("event_type") == "view", F.lit("}")).otherwise(F.lit(', "seed": 1}'))
    body = F.when(F.col("event_type") == "click", F.lit("no json")).otherwise(F.concat(F.regexp_replace("props", r"\}$", ""), seed))
    m = projections.manifests(T(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), body.alias("text")), ["k", "seed"])
    return m.select("path", F.array_join("missing", ",").alias("missing"), F.col("manifest").isNotNull().alias("valid"))


# ---- files -------------------------------------------------------------------------


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(
    """
SELECT 'u' || p_partkey AS concept_uri, p_name AS preferred_label, p_brand || CASE WHEN p_size > 25 THEN '|' || p_type ELSE '' END AS alt_labels, CASE WHEN p_size > 40 THEN 'knowledge' ELSE 'skill/competence' END AS skill_type, 'Says "' || p_type || '", yes' AS description FROM part
UNION ALL SELECT 'l' || s_suppkey, s_name, '', 'language', '' FROM supplier"""
)
def taxonomy_files(spark, d):
    """SRC1 to SRC4, SCL2: a taxonomy that is written as CSV, with languages beside it, and read back."""
    path = _folder(spark)
    part = T(spark, d, "part")
    uri = F.concat(F.lit(" u"), F.col("p_partkey").cast("string"))
    kind = F.when(F.col("p_size") > 40, " Knowledge ").when(F.col("p_size") > 20, "odd")
    rows = part.select(uri.alias("conceptUri"), kind.alias("skillType"), "p_name", F.concat("p_brand", F.lit("\n"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(""), F.lit("|"), F.lower("p_brand")).alias("altLabels"), F.concat(F.lit('Says "'), "p_type", F.lit('", yes')).alias("description"), F.lit("x").alias("reuseLevel"))
    rows.withColumnRenamed("p_name", "preferredLabel").union(rows.limit(1).withColumn("conceptUri", F.lit(""))).write.csv(f"{path}/concepts", header=True, escape='"', quoteAll=True)
    T(spark, d, "supplier").select(F.concat(F.lit("l"), F.col("s_suppkey").cast("string")).alias("conceptUri"), F.col("s_name").alias("preferredLabel"), F.lit("").alias("altLabels")).write.csv(f"{path}/languages", header=True)
    c = taxonomy.concepts(spark, f"{path}/concepts", f"{path}/languages")
    return c.select("concept_uri", "preferred_label", F.array_join("alt_labels", "|").alias("alt_labels"), "skill_type", "description")


@query(
    """
WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS k, min(l_suppkey) AS cv, min(l_partkey) AS uri FROM lineitem GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS pair_id, 'cv' || cv AS cv_id, 'p' || uri AS concept_uri, CAST(k % 1000 AS INT) AS span_start FROM r"""
)
def pair_files(spark, d):
    """SNK1, SRC19: training pairs written as JSON lines under a header, and read back."""
    path = _folder(spark)
    k = F.col("k").cast("int")
    rows = T(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).agg(F.min("l_suppkey").alias("cv"), F.min("l_partkey").alias("uri"))
    rows = cut(rows)  # counted, sampled by the sort, and written
    rows = rows.select(F.col("k").cast("string").alias("pair_id"), F.concat(F.lit("cv"), F.col("cv").cast("string")).alias("cv_id"), F.lit("positive").alias("pair_type"), F.lit("x").alias("text_span"), (k % 1000).alias("span_start"), (k % 1000 + 1).alias("span_end"), F.concat(F.lit("p"), F.col("uri").cast("string")).alias("concept_uri"))
    taxonomy.write_pairs(rows, {"pair_count": rows.count()}, path)
    return taxonomy.read_pairs(spark, path).select("pair_id", "cv_id", "concept_uri", "span_start")


@query(
    """
WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS o, l_linestatus || l_returnflag AS method, l_quantity / 50 AS s FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)
SELECT doc_id, CAST(o AS INT) AS method_ord, round(s, 6) AS score FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN s >= 0.5 THEN o ELSE 1000 END, s DESC, o) = 1"""
)
def extraction_cascade(spark, d):
    """UDF4: of several extraction attempts the first that is good enough, else the best."""
    w = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    li = T(spark, d, "lineitem").withColumn("r", w).filter("r = 1")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("method_ord"), F.col("l_linenumber").cast("string").alias("method"), F.lit("t").alias("text"), (F.col("l_quantity") / 50).alias("score"))
    out = taxonomy.cascade(rows)
    return out.select("doc_id", F.col("method").cast("int").alias("method_ord"), r6(F.col("score"), "score"))


@query(
    """
WITH r AS (SELECT p_partkey, '{"p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_type":"' || p_type || '"}' AS line FROM part), n AS (SELECT line, (row_number() OVER (ORDER BY p_partkey, line) - 1) AS place FROM r),
p AS (SELECT place // 70 AS part, count(*) AS rows, sha256(string_agg(line, chr(10) ORDER BY place) || chr(10)) AS h FROM n GROUP BY 1)
SELECT count(*) AS parts, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(part || ':' || rows || ':' || h, ';' ORDER BY part)) AS sha256, true AS same FROM p"""
)
def bundle_digest(spark, d):
    """SNK8: the digest of a bundle, the same from three partitions and from eleven, and of what was written."""
    rows = T(spark, d, "part").select("p_partkey", "p_name", "p_type")
    path = _folder(spark)
    written = bundle.write_bundle(rows.repartition(11), ["p_partkey"], path, 70)
    parts = bundle.bundled(rows.repartition(3), ["p_partkey"], 70)
    on_disk = bundle.verify_bundle(spark, path).withColumnRenamed("sha256", "disk")
    same = parts.join(on_disk, "part").agg(F.bool_and(F.col("sha256") == F.col("disk")).alias("ok")).first()["ok"]
    return bundle.manifest(parts).withColumn("same", (F.col("sha256") == written) & F.lit(same))


@query(
    """
SELECT 'u' || p_partkey AS concept_uri, p_name || CASE WHEN p_size > 25 THEN '|é ' || p_type || '|e ' || p_type ELSE '' END || CASE WHEN p_size > 40 THEN '|' || p_brand ELSE '' END AS surfaces FROM part"""
)
def second_label_files(spark, d):
    """SRC5: labels of another language, written as CSV and read back in file order; junk is left out."""
    path = _folder(spark)
    part = T(spark, d, "part")
    uri = F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("conceptUri")
    first = part.select(uri, F.col("p_name").alias("preferredLabel"), F.when(F.col("p_size") > 25, F.concat(F.lit("é "), "p_type", F.lit("; 7|x"))).alias("altLabels"))
    first.union(part.filter("p_size > 40").select(uri, F.col("p_brand"), F.col("p_name"))).coalesce(1).write.csv(path, header=True, quoteAll=True)
    s = taxonomy.second_labels(spark, path)
    return s.select("concept_uri", F.array_join("surfaces", "|").alias("surfaces"))


# ---- runs over documents, applications, reports ---------------------------------------


@query(
    """
WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE lang <> 'de'), b AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN n_chars > 2000 THEN 'x' ELSE '' END) AS h FROM documents WHERE lang <> 'fr')
SELECT doc_id, CASE WHEN a.doc_id IS NULL THEN 'drop' WHEN b.doc_id IS NULL THEN 'new' WHEN a.h = b.h THEN 'skip' ELSE 'redo' END AS action FROM a FULL JOIN b USING (doc_id)"""
)
def resumed_run(spark, d):
    """TRN1, TRN2: what a second run over documents skips, does again, adds and drops."""
    docs = T(spark, d, "documents")
    digest = preparation.content_hash(F.col("text"))
    changed = preparation.content_hash(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("n_chars") > 2000, "x").otherwise("")))
    return preparation.resumed(docs.filter("lang <> 'de'").select("doc_id", digest.alias("h")), docs.filter("lang <> 'fr'").select("doc_id", changed.alias("h")), "doc_id", "h")


@query(
    """
WITH n AS (SELECT c_custkey, md5('3|' || c_custkey) AS h, c_mktsegment FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS c FROM n)
SELECT o_orderkey AS id, coalesce(CASE WHEN c >= 2 AND rn <= greatest(1, floor(c * 0.1)) THEN 'val' ELSE 'train' END, 'train') AS split FROM orders LEFT JOIN r ON c_custkey = o_custkey"""
)
def split_by_document(spark, d):
    """TRN7: rows get the split of their document."""
    docs = T(spark, d, "customer").select(F.col("c_custkey").alias("cv_id"), "c_mktsegment")
    return preparation.split_rows(T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cv_id")), docs, "cv_id", "c_mktsegment", 0.1, 3).select("id", "split")


@query(
    """
WITH a AS (SELECT o_orderkey AS id, o_orderkey % 40 AS jd_id, o_custkey % 50 AS who, o_custkey AS cv_id, o_orderdate AS made FROM orders), k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY jd_id, who ORDER BY made DESC, id DESC) = 1)
SELECT 'kept' AS kind, id FROM k UNION ALL SELECT DISTINCT 'orphan', cv_id FROM a WHERE cv_id IN (SELECT c_custkey FROM customer) AND cv_id NOT IN (SELECT cv_id FROM k)"""
)
def reapplications(spark, d):
    """STR8: the latest application of each position and address, and the documents that nothing holds any more."""
    who = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "User").otherwise(" user"), (F.col("o_custkey") % 50).cast("string"), F.lit("@x.org"))
    rows = T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 40).alias("jd_id"), who.alias("email"), F.col("o_custkey").alias("cv_id"), F.col("o_orderdate").alias("at"))
    kept, orphans = operations.reapplied(rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0"), T(spark, d, "customer").select(F.col("c_custkey").alias("cv_id")))
    return kept.select(F.lit("kept").alias("kind"), "id").union(orphans.select(F.lit("orphan"), "cv_id"))


@query(
    """
WITH c AS (SELECT l_orderkey AS jd_id, l_suppkey AS cv_id, max(l_quantity) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY s DESC, cv_id) AS rank FROM c)
SELECT jd_id, round(max(s), 6) AS top_score, count(*) AS candidate_count, '[' || string_agg('{"cv_id":' || cv_id || ',"score":' || s || ',"rank":' || rank || '}', ',' ORDER BY rank) || ']' AS report FROM r GROUP BY 1"""
)
def stored_reports(spark, d):
    """SNK7: the ranked report of each position as it is stored, with the figures that lists of reports need."""
    rows = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("jd_id"), F.col("l_suppkey").alias("cv_id")).agg(F.max("l_quantity").alias("overall_score"))
    out = scoring.stored_reports(scoring.ranked(rows, "cv_id"))
    return out.select("jd_id", r6(F.col("top_score"), "top_score"), "candidate_count", "report")


def overlay_files(spark, d):
    """SRC6, SRC8, SRC11: overlays of aliases, rules and known false positives, written as files of the nations and read back."""
    path = _folder(spark)
    n = T(spark, d, "nation").withColumn("id", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))

    def write(name: str, key: str, entry) -> str:
        whole = n.agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias(key))).alias("value"))
        whole.coalesce(1).write.text(f"{path}/{name}")
        return f"{path}/{name}"

    a = write("aliases", "aliases", F.struct(F.col("id").alias("target_uri"), F.array("n_name", F.lower("n_name")).alias("surfaces")))
    context = F.struct(F.array(F.lit("skills")).alias("allowed_sections"), F.col("n_regionkey").alias("surrounding_window_chars"))
    r = write("rules", "rules", F.struct(F.col("n_name").alias("surface_pattern"), F.col("id").alias("target_concept_uri"), context.alias("context_required"), (F.col("n_regionkey") > 2).alias("case_sensitive")))
    f = write("known", "entries", F.struct(F.col("n_name").alias("span_lemma"), F.col("id").alias("wrong_uri")))
    rules = overlays.suppression_rules(spark, r).select(F.lit("rule").alias("kind"), F.col("target_uri").alias("uri"), F.concat_ws(":", "surface", F.array_join("allowed_sections", ","), F.col("window_chars").cast("string"), F.col("case_sensitive").cast("string")).alias("value"))
    names = overlays.aliases(spark, a).select(F.lit("alias").alias("kind"), F.col("concept_uri").alias("uri"), F.array_join("surfaces", ",").alias("value"))
    known = overlays.false_positives(spark, f).select(F.lit("known").alias("kind"), F.col("wrong_uri").alias("uri"), F.col("span_lemma").alias("value"))
    return rules.union(names).union(known)


if importlib.util.find_spec("yaml"):  # the overlays' format needs its parser
    query(
        """
SELECT 'rule' AS kind, 'n' || n_nationkey AS uri, n_name || ':skills:' || n_regionkey || ':' || CASE WHEN n_regionkey > 2 THEN 'true' ELSE 'false' END AS value FROM nation
UNION ALL SELECT 'alias', 'n' || n_nationkey, n_name || ',' || lower(n_name) FROM nation UNION ALL SELECT 'known', 'n' || n_nationkey, lower(n_name) FROM nation"""
    )(overlay_files)
