"""Further registered queries: filters of hits, taxonomy folding, uploads and applications,
requirement lists, comparison of predictors and of runs, and changes by key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import comparison, lexical, operations, preparation
from ..sources import taxonomy
from .queries import _CELLS, T, _cells, query, r6

# ---- filters of hits -----------------------------------------------------


@query(
    r"""
WITH g AS (SELECT doc_id, text, string_split(text, ' the ') AS gaps FROM documents),
k AS (SELECT doc_id, text, gaps, unnest(range(1, len(gaps))) AS k FROM g),
h AS (SELECT doc_id, text, CAST(list_sum(list_transform(gaps[1:k], lambda x : length(x))) + 5 * (k - 1) AS BIGINT) AS start FROM k)
SELECT doc_id, start FROM h WHERE NOT regexp_matches(lower(substr(text, greatest(start - 50, 0) + 1, least(start, 50))), '(^|[^\pL\pN])(of|in\s+on|to)\s*$')"""
)
def negation_filter(spark, d):
    """FLT3: every " the " that no denial stands before; the cues are the caller's."""
    docs = T(spark, d, "documents").select("doc_id", "text")
    gaps = F.slice(F.split("text", " the "), 1, F.size(F.split("text", " the ")) - 1)
    at = docs.select("doc_id", F.posexplode(gaps).alias("k", "gap"))
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    hits = at.select("doc_id", (F.sum(F.length("gap")).over(w) + 5 * F.col("k")).alias("start"))
    return lexical.without_negated(hits, docs, ["of", "in on", "to"])


_LI_HITS = """
hits AS (SELECT l_orderkey AS doc_id, l_partkey AS concept_uri, l_linenumber * 10 AS s, l_linenumber * 10 + 6 AS e, CASE l_returnflag WHEN 'R' THEN 'skills' ELSE 'other' END AS section, l_linestatus AS surface, l_suppkey FROM lineitem)
"""


def _li_hits(spark, d):
    return T(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("concept_uri"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 6).alias("end"),
        F.when(F.col("l_returnflag") == "R", "skills").otherwise("other").alias("section"), F.col("l_linestatus").alias("surface"), "l_suppkey",
    )


@query(
    "WITH " + _LI_HITS + """
, ent AS (SELECT o_orderkey AS d, (o_custkey % 7) * 10 + 3 AS e0, (o_custkey % 7) * 10 + 11 AS e1 FROM orders)
SELECT section, surface, count(*) AS n FROM hits WHERE section = 'skills' OR lower(surface) = 'o' OR NOT EXISTS (SELECT 1 FROM ent WHERE d = doc_id AND s < e1 AND e > e0) GROUP BY 1, 2"""
)
def entity_filter(spark, d):
    """FLT4, JON7: hits that overlap a proper noun go, but for allowed surfaces and the skills section."""
    first = (F.col("o_custkey") % 7) * 10 + 3
    entities = T(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), first.alias("start"), (first + 8).alias("end"))
    allowed = T(spark, d, "lineitem").select(F.col("l_linestatus").alias("surface")).filter("surface = 'O'")
    return lexical.without_entities(_li_hits(spark, d), entities, allowed).groupBy("section", "surface").agg(F.count("*").alias("n"))


@query(
    "WITH " + _LI_HITS + """
, rules AS (SELECT p_partkey, p_brand FROM part),
x AS (SELECT h.*, lower(substr(o_orderpriority, greatest(s - 8, 0) + 1, 22)) AS around FROM hits h JOIN orders ON o_orderkey = doc_id JOIN rules ON p_partkey = concept_uri)
SELECT doc_id, concept_uri, s AS start, count(DISTINCT l_suppkey) AS suppliers FROM x WHERE lower(surface) = 'f' AND section <> 'skills' AND (contains(around, 'i') OR contains(around, 'urg')) AND NOT contains(around, 'high') GROUP BY 1, 2, 3"""
)
def suppression_filter(spark, d):
    """FLT5: hits that a rule suppresses by surface, section and surrounding words."""
    rules = T(spark, d, "part").select(
        F.lit("F").alias("surface"), F.col("p_partkey").alias("target_uri"), F.lit(False).alias("case_sensitive"), F.lit(None).cast("array<string>").alias("allowed_sections"), F.array(F.lit("skills")).alias("forbidden_sections"),
        F.array(F.lit("I"), F.lit("URG")).alias("surrounding_any"), F.array(F.lit("HIGH")).alias("surrounding_none"), F.lit(8).alias("window_chars"),
    )
    docs = T(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("text"))
    out = lexical.suppressed(_li_hits(spark, d), rules, docs)
    return out.groupBy("doc_id", "concept_uri", "start").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@query(
    r"""
WITH raw AS (SELECT p_partkey, unnest(regexp_split_to_array(p_name || ' | ' || p_brand || ' ; ' || p_size || chr(10) || 'x|' || p_type, '\s*[|\n;]\s*')) AS surface FROM part)
SELECT p_partkey, trim(surface) AS surface, length(trim(surface)) < 2 OR NOT regexp_matches(surface, '\pL') AS junk FROM raw WHERE length(trim(surface)) > 0"""
)
def label_surfaces(spark, d):
    """SCL1, FLT6: a label list split into surfaces, junk told."""
    raw = F.concat("p_name", F.lit(" | "), "p_brand", F.lit(" ; "), F.col("p_size").cast("string"), F.lit("\nx|"), "p_type")
    rows = T(spark, d, "part").select("p_partkey", F.explode(text.alternative_labels(raw)).alias("surface"))
    return rows.withColumn("junk", text.junk_surface(F.col("surface")))


@query("SELECT DISTINCT source, unnest(list_distinct([trim(source || ' É ' || lang), source || ' E ' || lang])) AS surface FROM documents WHERE lang IS NOT NULL")
def surface_forms(spark, d):
    """SCL3, SCL4: a surface and its form without marks."""
    rows = T(spark, d, "documents").filter("lang is not null").select("source", F.concat("source", F.lit(" É "), "lang").alias("s")).distinct()
    return rows.select("source", F.explode(text.surface_variants(F.col("s"))).alias("surface"))


# ---- taxonomy ------------------------------------------------------------

_EXTRA = "extra AS (SELECT p_partkey * 2 AS uri, p_brand, p_name FROM part)"


@query(
    "WITH " + _EXTRA + """
, b AS (SELECT p_partkey AS uri, p.p_name AS pref, [p_type, e.p_brand, e.p_name] AS l FROM part p LEFT JOIN extra e ON e.uri = p.p_partkey),
k AS (SELECT uri, pref, list_filter(l, lambda x: x IS NOT NULL) AS l FROM b)
SELECT uri AS concept_uri, array_to_string(list_filter(l, lambda x, i: lower(x) <> lower(pref) AND list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '|') AS labels, true AS known FROM k
UNION ALL SELECT uri, p_brand || '|' || p_name, false FROM extra WHERE uri NOT IN (SELECT p_partkey FROM part)"""
)
def folded_surfaces(spark, d):
    """JON2, JON3, JON4: further surfaces folded into concepts, without repeats, and those of unknown concepts."""
    p = T(spark, d, "part")
    base = p.select(F.col("p_partkey").alias("concept_uri"), F.col("p_name").alias("preferred_label"), F.array("p_type").alias("alt_labels"))
    known, unknown = taxonomy.with_surfaces(base, p.select((F.col("p_partkey") * 2).alias("concept_uri"), F.array("p_brand", "p_name").alias("surfaces")))
    return known.select("concept_uri", F.array_join("alt_labels", "|").alias("labels"), F.lit(True).alias("known")).unionByName(unknown.select("concept_uri", F.array_join("surfaces", "|").alias("labels"), F.lit(False).alias("known")))


@query("SELECT p_partkey AS concept_uri, p_name AS label, false AS is_custom FROM part UNION ALL SELECT -s_suppkey - 1, s_name, true FROM supplier")
def appended_concepts(spark, d):
    """SET1, SET4: own concepts beside those of the taxonomy; an id in both would be an error."""
    base = T(spark, d, "part").select(F.col("p_partkey").alias("concept_uri"), F.col("p_name").alias("label"), F.lit(False).alias("is_custom"))
    return taxonomy.appended(base, T(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("concept_uri"), F.col("s_name").alias("label"), F.lit(True).alias("is_custom")))


@query(
    """
WITH neg AS (SELECT p_partkey AS pair_id, r AS rank, (p_size + r * 7) % 60 AS negative FROM part, (SELECT unnest([1, 2, 3]) AS r)),
t AS (SELECT DISTINCT p_size AS uri, 'concept ' || p_size AS text FROM part WHERE p_size % 5 <> 0)
SELECT p_partkey AS pair_id, CAST(neg.rank AS INT) AS rank, p_name AS anchor, a.text AS positive, b.text AS negative FROM part JOIN t a ON a.uri = p_size JOIN neg ON pair_id = p_partkey JOIN t b ON b.uri = neg.negative"""
)
def triplet_examples(spark, d):
    """JON23, TRN6: anchors with a positive and each ranked negative; a concept without a text drops the row."""
    p = T(spark, d, "part")
    texts = p.filter("p_size % 5 <> 0").select(F.col("p_size").alias("uri"), F.concat(F.lit("concept "), F.col("p_size").cast("string")).alias("text")).distinct()
    positives = p.select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("anchor"), F.col("p_size").alias("uri"))
    negatives = p.select(F.col("p_partkey").alias("pair_id"), "p_size", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank"))
    return preparation.triplets(positives, negatives.select("pair_id", "rank", ((F.col("p_size") + F.col("rank") * 7) % 60).alias("negative")), texts)


@query(
    """
SELECT doc_id, CAST(s AS INT) AS s, CAST(s + 12 AS INT) AS e, substr(text, s + 1, 12) AS span FROM (SELECT doc_id, n, text, length(text) * n // 8 AS s, (doc_id * 7 + n * 13) % 100 / 100.0 AS c
FROM documents, (SELECT unnest(range(8)) AS n)) WHERE c >= 0.65 AND s + 12 <= length(text) AND length(trim(substr(text, s + 1, 12))) > 0"""
)
def confident_positives(spark, d):
    """FLT11: hits that are sure enough, with a span that fits the text."""
    docs = T(spark, d, "documents")
    n = F.col("n")
    start = F.floor(F.col("size") * n / 8).cast("int")
    hits = docs.select("doc_id", F.length("text").alias("size"), F.explode(F.array(*map(F.lit, range(8)))).alias("n")).filter("size is not null")
    hits = hits.select("doc_id", start.alias("start"), (start + 12).alias("end"), ((F.col("doc_id") * 7 + n * 13) % 100 / 100).alias("confidence"))
    return comparison.positives(hits, docs).select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), "span")


@query(
    """
WITH cat AS (SELECT p_brand AS lemma, min(p_partkey) AS uri FROM part GROUP BY 1 UNION SELECT p_brand, max(p_partkey) FROM part GROUP BY 1)
SELECT p_partkey AS pair_id, min(uri) AS negative FROM part JOIN cat ON lower(lemma) = lower(p_brand) AND uri <> p_partkey GROUP BY 1"""
)
def catalogue_distractors(spark, d):
    """JON20: the known false positive of the same surface and another concept."""
    p = T(spark, d, "part")
    g = p.groupBy(F.upper("p_brand").alias("lemma")).agg(F.array(F.min("p_partkey"), F.max("p_partkey")).alias("u"))
    rows = p.select(F.col("p_partkey").alias("pair_id"), F.col("p_brand").alias("surface"), F.col("p_partkey").alias("uri"))
    return comparison.distractors(rows, g.select("lemma", F.explode("u").alias("uri")))


# ---- uploads and applications --------------------------------------------

_FILES = """
files AS (SELECT o_orderkey AS ord, CASE WHEN o_custkey % 11 = 0 THEN '' WHEN o_custkey % 13 = 0 THEN 'text' ELSE '%PDF-' || o_custkey END AS content, CASE WHEN o_custkey % 17 = 0 THEN 'text/plain' ELSE 'application/pdf' END AS kind FROM orders),
why AS (SELECT ord, content, CASE WHEN content = '' THEN 'EMPTY' WHEN kind <> 'application/pdf' THEN 'TYPE' WHEN NOT starts_with(content, '%PDF-') THEN 'MAGIC' END AS reason FROM files),
st AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN content IN (SELECT '%PDF-' || c_custkey FROM customer WHERE c_custkey % 10 = 3) OR row_number() OVER (PARTITION BY content, reason IS NULL ORDER BY ord) > 1 THEN 'duplicate' ELSE 'created' END AS status FROM why)
"""


def _uploads(spark, d):
    c = F.col("o_custkey")
    content = F.when(c % 11 == 0, "").when(c % 13 == 0, "text").otherwise(F.concat(F.lit("%PDF-"), c.cast("string")))
    batch = T(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), c.cast("string").alias("name"), F.when(c % 17 == 0, "text/plain").otherwise("application/pdf").alias("content_type"), content.cast("binary").alias("content"))
    known = T(spark, d, "customer").filter("c_custkey % 10 = 3").select(F.sha2(F.concat(F.lit("%PDF-"), F.col("c_custkey").cast("string")).cast("binary"), 256).alias("content_hash"))
    return operations.upload(batch, known)


@query("WITH " + _FILES + "SELECT ord, status, reason AS reject_reason FROM st")
def upload_validation(spark, d):
    """FLT12, STR6: files as created, duplicate or rejected with a reason."""
    return _uploads(spark, d).select("ord", "status", "reject_reason")


@query("WITH " + _FILES + "SELECT count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'rejected') AS rejected, CAST(0 AS BIGINT) AS other FROM st")
def upload_tallies(spark, d):
    """AGG17: how many files were created, known or rejected."""
    return comparison.counters(_uploads(spark, d), [], "status", ["created", "duplicate", "rejected"])


@query(
    """
SELECT c_custkey, CASE WHEN length(trim(name)) = 0 THEN 'NAME' WHEN NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'EMAIL' WHEN phone IS NOT NULL AND NOT regexp_matches(phone, '^[+0-9 ().-]{6,20}$') THEN 'PHONE' END AS reason
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN 'nobody' ELSE c_name || '@x.org' END AS email, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '+1 555 010' ELSE 'ask' END AS phone FROM customer)"""
)
def application_validation(spark, d):
    """FLT13: the reason for which an application is turned away, or null."""
    k = F.col("c_custkey")
    name, email = F.when(k % 7 == 0, " ").otherwise(F.col("c_name")), F.when(k % 5 == 0, "nobody").otherwise(F.concat("c_name", F.lit("@x.org")))
    phone = F.when(k % 3 == 1, "+1 555 010").when(k % 3 == 2, "ask")
    return T(spark, d, "customer").select("c_custkey", operations.valid_application(name, email, phone).alias("reason"))


@query(
    """
SELECT o_orderkey AS id, o_orderpriority AS jd_id, o_custkey AS cv_id, c_name AS original_filename, lower(CASE WHEN o_orderkey % 3 = 0 THEN 'F@x.org' WHEN c_custkey % 2 = 0 THEN 'm' || c_custkey || '@x.org' WHEN c_nationkey < 20 THEN c_mktsegment || '@x.org' END) AS email,
  CASE WHEN o_orderkey % 3 = 0 THEN 'FORM' WHEN c_custkey % 2 = 0 THEN 'MANUAL' WHEN c_nationkey < 20 THEN 'EXTRACTED' ELSE 'NONE' END AS email_source FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""
)
def application_list(spark, d):
    """JON16: applications with their stored CV and effective address."""
    o = T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("jd_id"), F.col("o_custkey").alias("cv_id"), F.when(F.col("o_orderkey") % 3 == 0, " F@x.org").alias("candidate_email"))
    k = F.col("c_custkey")
    c = T(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("original_filename"), F.when(k % 2 == 0, F.concat(F.lit("M"), k.cast("string"), F.lit("@x.org"))).otherwise(" ").alias("manual_email"), F.when(F.col("c_nationkey") < 20, F.concat("c_mktsegment", F.lit("@x.org"))).alias("extracted_email"))
    return operations.application_list(o, c)


@query("SELECT o_orderkey AS id, o_custkey AS cv_id, o_orderpriority AS jd_id, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS holders FROM orders QUALIFY holders > 1")
def foreign_links(spark, d):
    """JON30: links of a CV and a position that another application holds too."""
    links = T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cv_id"), F.col("o_orderpriority").alias("jd_id"))
    return comparison.conflicts(links, ["cv_id", "jd_id"])


# ---- requirements, predictors, runs --------------------------------------

_CAND = """
cand AS (SELECT l_orderkey AS jd_id, l_partkey % 20 AS skill_uri, 'Skill ' || (l_partkey % 20) AS label, l_discount AS confidence,
  CASE l_returnflag WHEN 'R' THEN 'lexical_kept' WHEN 'A' THEN 'semantic_expansion' ELSE 'lexical_dropped' END AS source, l_linenumber AS ord FROM lineitem)
"""


def _requirement_candidates(spark, d):
    uri = F.col("l_partkey") % 20
    return T(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("jd_id"), uri.alias("skill_uri"), F.concat(F.lit("Skill "), uri.cast("string")).alias("label"), F.col("l_discount").alias("confidence"),
        F.when(F.col("l_returnflag") == "R", "lexical_kept").when(F.col("l_returnflag") == "A", "semantic_expansion").otherwise("lexical_dropped").alias("source"), F.col("l_linenumber").alias("ord"),
    )


@query("WITH " + _CAND + ", b AS (SELECT jd_id, skill_uri, min(label) AS label, max(confidence) AS confidence FROM cand WHERE source <> 'lexical_dropped' GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY jd_id ORDER BY confidence DESC, lower(label), skill_uri) AS INT) AS place FROM b")
def requirement_list(spark, d):
    """AGG4, ORD1: extracted candidates as an ordered list of requirements."""
    return comparison.requirement_list(_requirement_candidates(spark, d))


@query("WITH " + _CAND + "SELECT jd_id % 100 AS block, count(*) FILTER (source = 'lexical_kept') AS lexical_kept, count(*) FILTER (source = 'lexical_ambiguous') AS lexical_ambiguous, count(*) FILTER (source = 'semantic_expansion') AS semantic_expansion, count(*) FILTER (source = 'lexical_dropped') AS other FROM cand GROUP BY 1")
def link_counters(spark, d):
    """AGG9: how many candidates each step of linking made."""
    rows = _requirement_candidates(spark, d).withColumn("block", F.col("jd_id") % 100)
    return comparison.counters(rows, ["block"], "source", ["lexical_kept", "lexical_ambiguous", "semantic_expansion"])


@query(
    """
WITH g AS (SELECT DISTINCT l_suppkey AS cv_id, l_orderkey AS jd_id FROM lineitem)
SELECT CASE WHEN s_suppkey IS NULL THEN 'NO_CV' WHEN o_orderkey IS NULL THEN 'NO_JD' ELSE 'scored' END AS status, count(*) AS n, count(DISTINCT cv_id) AS cvs
FROM g LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = cv_id LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON o_orderkey = jd_id GROUP BY 1"""
)
def judged_matrix(spark, d):
    """JON14: judged cells that can be scored, and why others are skipped."""
    gold = T(spark, d, "lineitem").select(F.col("l_suppkey").alias("cv_id"), F.col("l_orderkey").alias("jd_id")).distinct()
    cvs = T(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("cv_id"))
    jds = T(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("jd_id"))
    return comparison.judged(gold, cvs, jds).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("cv_id").alias("cvs"))


_SETS = """
g AS (SELECT DISTINCT l_suppkey AS cv, l_partkey % 97 AS uri FROM lineitem WHERE l_linestatus = 'O'),
p AS (SELECT DISTINCT l_suppkey AS cv, CASE l_returnflag WHEN 'R' THEN 'lexical' ELSE 'semantic' END AS m, l_partkey % 97 AS uri FROM lineitem WHERE l_returnflag IN ('R', 'A')
  UNION SELECT DISTINCT l_suppkey, 'union', l_partkey % 97 FROM lineitem WHERE l_returnflag IN ('R', 'A')),
ms AS (SELECT DISTINCT m FROM p),
o AS (SELECT p.cv, p.m, CASE WHEN g.cv IS NULL THEN 'fp' ELSE 'tp' END AS k FROM p LEFT JOIN g ON g.cv = p.cv AND g.uri = p.uri
  UNION ALL SELECT g.cv, ms.m, 'fn' FROM g CROSS JOIN ms WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.cv = g.cv AND p.m = ms.m AND p.uri = g.uri))
"""


def _outcomes(spark, d):
    li = T(spark, d, "lineitem").select(F.col("l_suppkey").alias("cv_id"), (F.col("l_partkey") % 97).alias("uri"), "l_returnflag", "l_linestatus", "l_quantity")
    made = li.filter("l_returnflag in ('R', 'A')")
    single = made.select("cv_id", F.when(F.col("l_returnflag") == "R", "lexical").otherwise("semantic").alias("predictor"), "uri")
    return comparison.outcomes(single.unionByName(single.withColumn("predictor", F.lit("union"))), li.filter("l_linestatus = 'O'"))


@query(
    "WITH " + _SETS + """, c AS (SELECT m, cv, count(*) FILTER (k = 'tp') AS tp, count(*) FILTER (k = 'fp') AS fp, count(*) FILTER (k = 'fn') AS fn FROM o GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM r),
a AS (SELECT m, count(*) AS documents, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM f GROUP BY 1)
SELECT m AS predictor, documents, round(mp, 6) AS macro_p, round(mr, 6) AS macro_r, round(mf, 6) AS macro_f1, round(tp / (tp + fp), 6) AS micro_p, round(tp / (tp + fn), 6) AS micro_r, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1 FROM a"""
)
def predictor_views(spark, d):
    """AGG23: macro and micro figures of the lexical, semantic and united predictor."""
    v = comparison.views(_outcomes(spark, d))
    return v.select("predictor", "documents", *(r6(F.col(c), c) for c in v.columns[2:]))


@query("WITH " + _SETS + "SELECT m AS predictor, k AS outcome, count(*) AS n FROM o GROUP BY 1, 2")
def predictor_outcomes(spark, d):
    """SET3, SET8: true and false positives and misses of each predictor."""
    return _outcomes(spark, d).groupBy("predictor", "outcome").agg(F.count("*").alias("n"))


_RUNS = """
a AS (SELECT l_suppkey AS k, avg(l_discount) * 10 AS v FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 10 <> 0 GROUP BY 1),
b AS (SELECT l_suppkey AS k, avg(l_discount) * 10 AS v FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 10 <> 1 GROUP BY 1),
d AS (SELECT k, coalesce(a.v, 0) AS before, coalesce(b.v, 0) AS after, round(coalesce(b.v, 0) - coalesce(a.v, 0), 9) AS delta FROM a FULL OUTER JOIN b USING (k))
"""


def _runs(spark, d):
    run = lambda flag, but: T(spark, d, "lineitem").filter((F.col("l_returnflag") == flag) & (F.col("l_suppkey") % 10 != but)).groupBy(F.col("l_suppkey").alias("cv_id")).agg((F.avg("l_discount") * 10).alias("f1"))
    return comparison.deltas(run("R", 0), run("A", 1), "cv_id", "f1")


@query("WITH " + _RUNS + "SELECT k AS cv_id, round(before, 6) AS before, round(after, 6) AS after, round(delta, 6) AS delta, CASE WHEN delta >= 0.1 THEN 'win' WHEN delta < -0.05 THEN 'regression' ELSE 'same' END AS verdict FROM d")
def run_deltas(spark, d):
    """JON29, FLT19: two runs side by side, wins and regressions told."""
    return _runs(spark, d).select("cv_id", *(r6(F.col(c), c) for c in ("before", "after", "delta")), "verdict")


@query("WITH " + _RUNS + "SELECT k % 3 = 0 AS flag, count(*) AS n, round(avg(delta), 6) AS mean_delta, count(*) FILTER (delta > 0) AS improved FROM d GROUP BY 1")
def delta_attribution(spark, d):
    """AGG32: whether the change follows what the training had seen."""
    g = comparison.attributed(_runs(spark, d), F.col("cv_id") % 3 == 0)
    return g.withColumn("mean_delta", F.round("mean_delta", 6))


@query(
    """
SELECT round(avg(CASE WHEN rank <= 5 THEN 0.2 ELSE 0 END), 6) AS precision_5, round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 0.1 ELSE 0 END), 6) AS precision_10, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS recall_10,
  round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 6) AS map_10, count(*) AS queries FROM (SELECT nullif(l_partkey % 17, 0) AS rank FROM lineitem)"""
)
def retrieval_precision(spark, d):
    """AGG38: precision and recall at 5 and 10, and MAP@10."""
    out = comparison.precision_recall(T(spark, d, "lineitem").select(F.nullif(F.col("l_partkey") % 17, F.lit(0)).alias("rank")))
    return out.select(*(r6(F.col(c), c) for c in out.columns[:-1]), "queries")


@query(
    """
WITH c AS (SELECT o_orderstatus AS split, o_orderpriority AS kind, count(*) AS counted FROM orders GROUP BY 1, 2), s AS (SELECT o_orderstatus AS split, o_orderpriority AS kind, count(*) FILTER (o_custkey % 50 <> 7 OR o_orderstatus <> 'P') AS stored FROM orders GROUP BY 1, 2)
SELECT * FROM c JOIN s USING (split, kind) WHERE counted <> stored"""
)
def pair_reconciliation(spark, d):
    """AGG41: counts by split and kind that differ from the stored totals."""
    rows = T(spark, d, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("kind"), "o_custkey")
    totals = rows.filter("o_custkey % 50 <> 7 or split <> 'P'").groupBy("split", "kind").agg(F.count("*").alias("n"))
    return comparison.mismatches(rows, totals, ["split", "kind"])


# ---- changes by key ------------------------------------------------------


@query("SELECT s_suppkey, s_name, coalesce(c_acctbal, s_acctbal) AS s_acctbal, coalesce(c_nationkey, s_nationkey) AS s_nationkey FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = s_suppkey")
def attribute_overwrite(spark, d):
    """JON32: attributes replaced from an update table; unknown ids are skipped."""
    updates = T(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"), F.col("c_nationkey").alias("s_nationkey"))
    return comparison.overwritten(T(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey"), updates, "s_suppkey", ["s_acctbal", "s_nationkey"])


@query("SELECT l_orderkey AS jd_id, l_linenumber AS sort_order, CAST(l_partkey AS BIGINT) AS skill FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1, CAST(o_custkey AS BIGINT) FROM orders WHERE o_orderstatus = 'P'")
def requirement_replace(spark, d):
    """STR9: the requirements of a changed position are replaced as a whole."""
    now = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("jd_id"), F.col("l_linenumber").alias("sort_order"), F.col("l_partkey").alias("skill"))
    changes = T(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("jd_id"), F.lit(1).alias("sort_order"), F.col("o_custkey").alias("skill"))
    return comparison.replaced(now, changes, "jd_id")


@query("SELECT p_partkey, try_cast(v AS DOUBLE) AS number FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '.5' WHEN 2 THEN 'n/a' ELSE p_brand END AS v FROM part)")
def tolerant_numbers(spark, d):
    """SCL27: strings as numbers where they are some, else null."""
    s = F.col("p_size").cast("string")
    v = F.when(F.col("p_size") % 4 == 0, s).when(F.col("p_size") % 4 == 1, F.concat(s, F.lit(".5"))).when(F.col("p_size") % 4 == 2, "n/a").otherwise(F.col("p_brand"))
    return T(spark, d, "part").select("p_partkey", scores.number(v).alias("number"))


@query("SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_categories(spark, d):
    """ORD8: the twenty most common categories, ties by name."""
    return T(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(20)


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 5")
def slowest_five(spark, d):
    """ORD7: the five largest values."""
    return T(spark, d, "events").select("event_id", "user_id", "value").orderBy(F.desc_nulls_last("value"), "event_id").limit(5)


# ---- reports -------------------------------------------------------------

_GRAVE = " ".join(f"WHEN gold = '{g}' AND predicted = '{p}' THEN {k}" for k, (g, p) in enumerate(comparison.SEVERITY))


@query("WITH " + _CELLS + f"SELECT cv_id, jd_id, k, gold, predicted, score, CASE {_GRAVE} END AS severity FROM pred WHERE gold <> predicted ORDER BY severity, abs(score) DESC, cv_id, jd_id, k LIMIT 10")
def grave_disagreements(spark, d):
    """ORD9: the ten gravest of six ordered classes of disagreement."""
    return comparison.gravest(_cells(spark, d), ["cv_id", "jd_id", "k"])


@query(
    "WITH " + _CELLS + """, o AS (SELECT cv_id, jd_id, k, abs(CASE gold WHEN 'strong' THEN 2 WHEN 'possible' THEN 1 ELSE 0 END - CASE predicted WHEN 'strong' THEN 2 WHEN 'possible' THEN 1 ELSE 0 END) AS far FROM pred)
SELECT cv_id, jd_id, k, ['right', 'near', 'wrong'][far + 1] AS kind FROM o QUALIFY row_number() OVER (PARTITION BY far ORDER BY cv_id, jd_id, k) <= CASE far WHEN 0 THEN 1 ELSE 2 END"""
)
def example_picks(spark, d):
    """ORD10: one right, two near and two wrong examples in input order."""
    level = lambda c: F.when(F.col(c) == "strong", 2).when(F.col(c) == "possible", 1).otherwise(0)
    far = F.abs(level("gold") - level("predicted"))
    kind = F.when(far == 0, "right").when(far == 1, "near").otherwise("wrong")
    return comparison.examples(_cells(spark, d).select("cv_id", "jd_id", "k", kind.alias("kind")), ["cv_id", "jd_id", "k"], {"right": 1, "near": 2, "wrong": 2})


@query("SELECT source AS method, count(*) FILTER (doc_id % 7 <> 0) AS ok, count(*) FILTER (doc_id % 7 = 0) AS errors, coalesce(round(avg(CASE WHEN doc_id % 7 <> 0 THEN (n_chars % 100) / 100 END), 6), 0) AS quality, coalesce(CAST(floor(sum(CASE WHEN doc_id % 7 <> 0 THEN n_chars END) / nullif(count(*) FILTER (doc_id % 7 <> 0), 0)) AS BIGINT), 0) AS ms FROM documents GROUP BY 1")
def method_summary(spark, d):
    """AGG30: runs, errors and means by method."""
    rows = T(spark, d, "documents").select(F.col("source").alias("method"), F.when(F.col("doc_id") % 7 == 0, "failed").alias("error"), (F.col("n_chars") % 100 / 100).alias("quality_score"), F.col("n_chars").alias("time_ms"))
    return comparison.method_summary(rows).withColumn("quality", F.round("quality", 6))


@query("SELECT l_suppkey, CASE WHEN s >= 0.55 AND e > 0.5 THEN 'go' WHEN s >= 0.45 AND s < 0.55 THEN 'borderline' ELSE 're-rank' END AS decision FROM (SELECT l_suppkey, round(avg(l_quantity) / 50, 6) AS s, round(avg(l_discount) * 10, 6) AS e FROM lineitem GROUP BY 1)")
def decision_gate(spark, d):
    """FLT20: go, borderline or re-rank, from the semantic and the united F1."""
    rows = T(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity") / 50, 6).alias("semantic_f1"), F.round(F.avg("l_discount") * 10, 6).alias("ensemble_f1"))
    return comparison.gate(rows, F.lit(0.5)).select("l_suppkey", "decision")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'EMAIL' ELSE 'UNFINISHED' END AS reason FROM orders WHERE (o_orderstatus = 'F' AND o_custkey % 3 = 0 AND o_custkey % 5 = 0) OR o_orderstatus = 'P'")
def backfill_selection(spark, d):
    """FLT17: documents without an address, and those left unfinished."""
    k = F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "READY").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("FAILED")
    rows = T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.when(k % 3 != 0, "a@x.org").alias("extracted_email"), F.when(k % 5 != 0, "b@x.org").alias("manual_email"))
    return comparison.backfill(rows)


@query("SELECT DISTINCT c_nationkey AS jd_id, upper(c_mktsegment) || '@X.org' AS email, s_suppkey AS id FROM customer JOIN supplier ON s_nationkey = c_nationkey AND lower(c_mktsegment) || '@x.org' = CASE s_suppkey % 2 WHEN 0 THEN 'building@x.org' ELSE 'machinery@x.org' END")
def email_lookup(spark, d):
    """JON26: applications of a position by address, in any case."""
    wanted = T(spark, d, "customer").select(F.col("c_nationkey").alias("jd_id"), F.concat(F.upper("c_mktsegment"), F.lit("@X.org")).alias("email"))
    email = F.when(F.col("s_suppkey") % 2 == 0, "Building@x.org").otherwise("MACHINERY@x.org")
    return comparison.by_email(wanted, T(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("jd_id"), email.alias("email")))


@query("SELECT l_partkey AS uri, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def training_frequency(spark, d):
    """AGG37: how often the training set has each concept."""
    return comparison.frequency(T(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("uri")))
