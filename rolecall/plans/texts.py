"""Further registered queries: resolution of requirements, languages and levels, slashes, job texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking, sections
from .queries import T, query, r6

# ---- resolution of requirements --------------------------------------------


@query(
    """
WITH v AS (SELECT p_partkey, list_append(CAST(embedding AS DOUBLE[])[2:], CAST(embedding AS DOUBLE[])[1]) AS q FROM part JOIN embeddings ON vec_id = p_partkey),
s AS (SELECT p_partkey, vec_id, label, round(list_dot_product(q, CAST(embedding AS DOUBLE[])), 12) AS sim FROM v, embeddings),
n AS (SELECT p_partkey, vec_id, label, sim FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY sim DESC, vec_id) = 1),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, CASE WHEN l_linestatus = 'F' THEN l_suppkey END AS uri FROM lineitem)
SELECT l_orderkey AS jd_id, CAST(l_linenumber AS INT) AS req_ord, coalesce(uri, n.vec_id) AS skill_uri, coalesce(e.label, CASE WHEN uri IS NULL THEN n.label END) AS skill_label,
  uri IS NULL AND n.vec_id IS NOT NULL AS resolved, round(CASE WHEN uri IS NULL AND n.vec_id IS NOT NULL AND l_discount <= 0 THEN sim ELSE l_discount END, 6) AS confidence
FROM r LEFT JOIN n ON p_partkey = l_partkey LEFT JOIN embeddings e ON e.vec_id = uri"""
)
def requirement_resolution(spark, d):
    """JON12: requirements without a concept get the nearest one to their text; a confidence stays if there is one."""
    e = T(spark, d, "embeddings").withColumnRenamed("embedding", "vec")
    turned = F.concat(F.slice("vec", 2, F.size("vec") - 1), F.slice("vec", 1, 1))
    vectors = T(spark, d, "part").join(e, F.col("vec_id") == F.col("p_partkey")).select(F.col("p_partkey").cast("string").alias("text"), turned.alias("vec"))
    rows = T(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("jd_id"), F.col("l_linenumber").cast("int").alias("req_ord"), F.col("l_partkey").cast("string").alias("text"),
        F.when(F.col("l_linestatus") == "F", F.col("l_suppkey")).alias("skill_uri"), F.col("l_discount").cast("double").alias("req_conf"),
    )
    out = linking.resolved(rows, e.select(F.col("vec_id").alias("skill_uri"), "label", "vec"), vectors)
    return out.select("jd_id", "req_ord", "skill_uri", "skill_label", "resolved", r6(F.col("req_conf"), "confidence"))


# ---- languages and levels ----------------------------------------------------

#: Names, and what follows them, with the level that it names.
_NAMES = [("English", "English"), ("franceză", "French"), ("Deutsch", "German"), ("ROMANIAN", "Romanian"), ("Klingon", None)]
_LEVELS = [(" (B2)", "B2"), (" - fluent", "fluent"), (": mother tongue", "native"), (" ( upper-intermediate )", "B2"), (" – some advanced words", "C1"), ("", None), (" (8 years)", None), (": C1 Advanced", "C1"), (" (Preliminary)", "B1")]


def _values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


@query(
    f"""
WITH n AS (SELECT * FROM {_values([(k, *r) for k, r in enumerate(_NAMES)])} v(k, word, language)), f AS (SELECT * FROM {_values([(k, *r) for k, r in enumerate(_LEVELS)])} v(k, tail, level)),
c AS (SELECT c_custkey, c_name || chr(10) AS head, a.word AS w1, a.language AS l1, f.tail AS t1, f.level AS v1, b.word AS w2, b.language AS l2, g.tail AS t2, g.level AS v2
  FROM customer JOIN n a ON a.k = c_custkey % 5 JOIN f ON f.k = c_nationkey % 9 JOIN n b ON b.k = (c_custkey // 5) % 5 JOIN f g ON g.k = (c_custkey // 7) % 9),
r AS (SELECT c_custkey AS doc_id, l1 AS language, w1 AS surface, CASE WHEN v1 IS NULL AND l1 = 'English' THEN CASE t2 WHEN ': C1 Advanced' THEN 'C1' WHEN ' (Preliminary)' THEN 'B1' END ELSE v1 END AS level, length(head) AS "start", 0 AS k FROM c
  UNION ALL SELECT c_custkey, l2, w2, v2, length(head || w1 || t1) + 2, 1 FROM c)
SELECT doc_id, language, surface, level, CAST("start" AS BIGINT) AS "start", CAST("start" + length(surface) AS BIGINT) AS "end" FROM r WHERE language IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, language ORDER BY k) = 1"""
)
def language_levels(spark, d):
    """SCL7: languages of a section with their levels, the first of each; sections are written from the customers."""
    name = lambda k: F.array(*(F.lit(w) for w, _ in _NAMES))[(k % 5).cast("int")]
    tail = lambda k: F.array(*(F.lit(t) for t, _ in _LEVELS))[(k % 9).cast("int")]
    key = F.col("c_custkey")
    head = F.concat("c_name", F.lit("\n"))
    text = F.concat(head, name(key), tail(F.col("c_nationkey")), F.lit(", "), name(F.floor(key / 5)), tail(F.floor(key / 7)))
    parts = T(spark, d, "customer").select(key.alias("doc_id"), text.alias("text"), F.length(head).cast("long").alias("start"), F.length(text).cast("long").alias("end"))
    out = sections.language_levels(parts)
    return out.select("doc_id", "language", "surface", "level", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


# ---- slashes -----------------------------------------------------------------


@query(
    """
WITH s AS (SELECT DISTINCT lower(p_type) AS s FROM part UNION SELECT lower(string_split(p_name, ' ')[1]) FROM part UNION SELECT lower(p_brand) FROM part WHERE p_size > 25),
w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part),
k AS (SELECT p_partkey, count(*) > 1 AND bool_and(s.s IS NOT NULL) AS ok FROM w LEFT JOIN s ON s.s = w.w GROUP BY 1),
t AS (SELECT p_partkey, p_brand, p_type, p_name, lower(p_brand) IN (SELECT s FROM s) AS k1, ok AS k2 FROM part JOIN k USING (p_partkey))
SELECT p_partkey AS doc_id, 'Uses ' || p_brand || CASE WHEN k1 THEN ' / ' ELSE '/' END || lower(p_type) || ' and/or ' || replace(p_name, ' ', CASE WHEN k2 THEN ' / ' ELSE '/' END) || ', ' || p_type || ' / ' || p_type || ' / ' || string_split(p_name, ' ')[1] || ';' AS text,
  true AS maps_back FROM t"""
)
def slash_segmentation(spark, d):
    """PRJ5: slashes between known names get blanks, and places of the new text map back to the old one."""
    part = T(spark, d, "part")
    first = F.split("p_name", " ")[0]
    text = F.concat(F.lit("Uses "), "p_brand", F.lit("/"), F.lower("p_type"), F.lit(" and/or "), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(", "), "p_type", F.lit("/"), "p_type", F.lit("/"), first, F.lit(";"))
    docs = part.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    surfaces = part.select(F.col("p_type").alias("surface")).union(part.select(first)).union(part.filter("p_size > 25").select("p_brand"))
    new = sections.slash_segmented(docs, surfaces)
    both = new.join(docs.repartition("doc_id").select("doc_id", F.split("text", "").alias("old")).hint("merge"), "doc_id")
    back = F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda y: F.coalesce(F.get("old", sections.original_place(y, F.col("slashes"))), F.lit("")))
    chars = F.split("text", "")
    same = F.forall(F.arrays_zip(chars.alias("a"), back.alias("b")), lambda p: (p["a"] == p["b"]) | ((p["a"] == " ") & (p["b"] == "/")))
    return both.select("doc_id", "text", same.alias("maps_back"))


# ---- job texts -----------------------------------------------------------------

_REQUIRED, _NICE, _OTHER = ["must know", "you bring"], ["good to know"], ["we give", "about us"]


@query(
    """
WITH b AS (SELECT l_orderkey, max(l_linestatus) AS st, list('part ' || l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag <> 'N') AS req, list('part ' || l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'N') AS nice FROM lineitem GROUP BY 1)
SELECT o_orderkey AS jd_id, 'Order ' || o_orderkey AS title, array_to_string(coalesce(req, []), '|') AS required_skills, CASE WHEN nice IS NULL OR o_orderstatus = 'P' THEN '' ELSE array_to_string(nice, '|') END AS nice_to_have_skills
FROM orders JOIN b ON l_orderkey = o_orderkey"""
)
def job_text_rows(spark, d):
    """SRC18, SCL8: title, required and further skills of job texts, which are written from the orders."""
    li = T(spark, d, "lineitem")
    lines = F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "N", F.struct("l_linenumber", "l_partkey"))))
    more = F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "N", F.struct("l_linenumber", "l_partkey"))))
    bullets = lambda c: F.array_join(F.transform(c, lambda s: F.concat(F.lit("\n - part "), s["l_partkey"].cast("string"))), "")
    parts = li.groupBy("l_orderkey").agg(lines.alias("req"), more.alias("nice"))
    rows = T(spark, d, "orders").join(parts, F.col("l_orderkey") == F.col("o_orderkey"))
    text = F.concat(
        F.lit("\n  Order "), F.col("o_orderkey").cast("string"), F.lit("\nSome words about us all\n\n## You bring (at least):\n*"), bullets(F.col("req")), F.lit("\n"), F.when(F.col("o_orderstatus") == "P", "").otherwise("GOOD TO KNOW"), bullets(F.when(F.col("o_orderstatus") != "P", F.col("nice"))),
        F.lit("\nWe give.\n- fruit\nMust know\n- no second block"),
    )
    jobs = rows.select(F.col("o_orderkey").alias("jd_id"), F.coalesce(text, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit("\nyou bring"), bullets(F.col("req")))).alias("text"))
    out = sections.job_rows(jobs, _REQUIRED, _NICE, _OTHER)
    return out.select("jd_id", "title", F.array_join("required_skills", "|").alias("required_skills"), F.array_join("nice_to_have_skills", "|").alias("nice_to_have_skills"))
