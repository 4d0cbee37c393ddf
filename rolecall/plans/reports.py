"""Further registered queries: language of texts, versions of an index, reports and their sources."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import language
from ..sources import reports, versions
from .queries import T, query, r6


@query(
    r"""
WITH c AS (SELECT doc_id, lang, length(text) AS n, string_split(lower(text), '') AS c FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, lang, n, c, unnest(range(1, len(c) - 1)) AS i FROM c WHERE len(c) >= 3),
t AS (SELECT doc_id, lang, n, c[i] || c[i + 1] || c[i + 2] AS tri FROM i), u AS (SELECT doc_id, lang, n, tri, count(*) AS k FROM t GROUP BY ALL), l AS (SELECT doc_id, lang, n, tri, k FROM u WHERE regexp_full_match(tri, '\pL{3}')),
p AS (SELECT lang, tri, sum(k) AS k, sum(sum(k)) OVER (PARTITION BY lang) AS whole FROM l WHERE lang IS NOT NULL GROUP BY 1, 2),
q AS (SELECT lang, tri, k / whole AS share FROM p QUALIFY row_number() OVER (PARTITION BY lang ORDER BY k DESC, tri) <= 300),
s AS (SELECT doc_id, q.lang, sum(l.k * share) AS w FROM l JOIN q USING (tri) WHERE n >= 50 GROUP BY 1, 2),
r AS (SELECT doc_id, lang, w, sum(w) OVER (PARTITION BY doc_id) AS whole, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, lang) AS rn, coalesce(lead(w) OVER (PARTITION BY doc_id ORDER BY w DESC, lang), 0) AS next FROM s)
SELECT doc_id, CASE WHEN (w - next) / whole >= 0.1 THEN r.lang END AS language, round((w - next) / whole, 6) AS gap FROM documents LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (doc_id)"""
)
def language_detection(spark, d):
    """UDF9: the language of each text by the trigrams of all, with its lead over the next; null where it is under 0.1."""
    docs = T(spark, d, "documents")
    return language.detected(docs, language.profiles(docs)).select("doc_id", "language", r6(F.col("gap"), "gap"))


@query("SELECT p_partkey AS uri, p_name AS label, 'second' AS source FROM part UNION ALL SELECT p_partkey, p_name, 'first' FROM part WHERE p_size > 25")
def index_versions(spark, d):
    """SNK3, SNK10: an index that is built once for a key, read while it is in force and after a new version replaced it."""
    folder = f"{shared_folder(spark)}/index-{spark.sparkContext.applicationId}-{zlib.crc32(d.encode())}"
    rows = T(spark, d, "part").select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("label"), "p_size")
    first = versions.get_or_build(spark, folder, {"model": "a", "rows": d}, lambda: rows.filter("p_size > 25"))
    again = versions.get_or_build(spark, folder, {"model": "b", "rows": d}, lambda: rows)
    return again.select("uri", "label", F.lit("second").alias("source")).union(first.select("uri", "label", F.lit("first")))


@query(
    """
WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag) - 1 AS row FROM g)
SELECT CAST(l_suppkey AS VARCHAR) AS path, 1 AS "table", row, 'flag' AS "column", l_returnflag AS value FROM r UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 1, row, 'rows', CAST(n AS VARCHAR) FROM r
UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 1, row, 'none', NULL FROM r UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 2, 0, 'a', 'b|c' FROM (SELECT DISTINCT l_suppkey FROM g) UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 0, 0, 'flags', CAST(count(*) AS VARCHAR) FROM g GROUP BY l_suppkey"""
)
def report_tables(spark, d):
    """SRC21: cells of the tables and keys of the bullets of reports, which are written from the line items."""
    g = T(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "n"))), lambda x: F.concat(F.lit("| "), x["l_returnflag"], F.lit(" | "), x["n"].cast("string"), F.lit(" |   |")))
    text = F.concat(F.lit("# Report\n\n- **flags**: "), F.count("*").cast("string"), F.lit("\n- flags: 0\n\n| flag | rows | none |\n|---|---:|---|\n"), F.array_join(lines, "\n"), F.lit("\n\nno table | here\n\n| a |\n|:---|\n| b\\|c |\n"))
    texts = g.groupBy(F.col("l_suppkey").cast("string").alias("path")).agg(text.alias("text"))
    cells = reports.pipe_tables(texts).select("path", "table", "row", "column", F.replace("value", F.lit("\\|"), F.lit("|")).alias("value"))
    keys = reports.bullet_keys(texts).select("path", F.lit(0).alias("table"), F.lit(0).alias("row"), F.col("key").alias("column"), "value")
    return cells.unionByName(keys)


@query(
    """
WITH p AS (SELECT p_partkey, p_name, p_size, p_type FROM part), l AS (
  SELECT p_partkey, 'name' AS leaf, p_name AS value FROM p UNION ALL SELECT p_partkey, 'metrics.size', CAST(p_size AS VARCHAR) FROM p UNION ALL SELECT p_partkey, 'metrics.deep.kind', p_type FROM p
  UNION ALL SELECT p_partkey, 'runs[0]', CAST(p_size + 1 AS VARCHAR) FROM p UNION ALL SELECT p_partkey, 'runs[1]', CAST(p_size + 2 AS VARCHAR) FROM p),
s AS (SELECT p_partkey, 'metrics' AS leaf FROM p WHERE p_size > 20 UNION ALL SELECT p_partkey, 'runs[1]' FROM p)
SELECT CAST(l.p_partkey AS VARCHAR) AS path, leaf, value FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.p_partkey = l.p_partkey AND (l.leaf = s.leaf OR l.leaf LIKE s.leaf || '.%' OR l.leaf LIKE s.leaf || '[%'))"""
)
def unsourced_metrics(spark, d):
    """FLT22, SCL21, SCL22: leaves of JSON reports that no source stands for."""
    part = T(spark, d, "part")
    tree = F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_type").alias("kind")).alias("deep")).alias("metrics"), F.array(F.col("p_size") + 1, F.col("p_size") + 2).alias("runs")))
    path = F.col("p_partkey").cast("string").alias("path")
    sources = part.filter("p_size > 20").select(path, F.lit("metrics").alias("leaf")).union(part.select(path, F.lit("runs[1]")))
    return reports.unsourced(reports.json_leaves(part.select(path, tree.alias("text"))), sources).select("path", "leaf", "value")
