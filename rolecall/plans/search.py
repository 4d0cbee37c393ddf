"""Further registered queries: threshold search, taxonomy closure, similarity of gold concepts, samples and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking, preparation, tuning
from ..sources import taxonomy
from .queries import T, query, r6

# ---- threshold search ----------------------------------------------------------

_GATES, _WEIGHTS = [0.1, 0.3], [0.6, 0.85]
_PAIRS = tuning.grid([0.1, 0.25, 0.4, 0.55, 0.7], [0.05, 0.2, 0.35, 0.5]) + [(0.2, 0.2), (0.2, 0.4)]
_CLASSES = ("strong", "possible", "no")


def _search_sql(tail: str) -> str:
    """Brute force: every pair of thresholds over every score of every setting."""
    n = ", ".join(f"count(*) FILTER (gold = '{g}' AND p = '{p}') AS {g}_{p}" for g in (*_CLASSES, "none") for p in _CLASSES)
    sup = {g: "(" + " + ".join(f"{g}_{p}" for p in _CLASSES) + ")" for g in _CLASSES}
    pred = {p: "(" + " + ".join(f"{g}_{p}" for g in _CLASSES) + ")" for p in _CLASSES}
    div = lambda a, b: f"(CASE WHEN {b} > 0 THEN ({a}) / {b} ELSE 0 END)"
    m = ", ".join(f"{div(f'{c}_{c}', pred[c])} AS p_{c}, {div(f'{c}_{c}', sup[c])} AS r_{c}" for c in _CLASSES)
    f1 = ", ".join(f"CASE WHEN p_{c} + r_{c} > 0 THEN 2 * p_{c} * r_{c} / (p_{c} + r_{c}) ELSE 0 END AS f_{c}" for c in _CLASSES)
    every = " + ".join(sup.values())
    guards = lambda floor, more: "array_to_string(list_filter([" + ", ".join([
        "CASE WHEN t2 >= t1 THEN 't2_lt_t1' END", f"CASE WHEN least({', '.join(pred.values())}) = 0 THEN 'all_three_classes_predicted' END",
        *(f"CASE WHEN {k}_{c} < {floor} THEN '{name}_floor_{c}' END" for c in _CLASSES for k, name in (("p", "precision"), ("r", "recall"))), *more,
    ]) + "], lambda x : x IS NOT NULL), ',')"
    bucket = "CASE WHEN least(" + ", ".join(f"{pred[p]} + none_{p}" for p in _CLASSES) + ") = 0 THEN 'score_buckets_non_empty' END"
    values = lambda xs: ", ".join("(" + ", ".join(f"CAST({v} AS DOUBLE)" for v in x) + ")" for x in xs)
    return f"""
WITH f AS (SELECT l_linestatus AS run, l_suppkey AS cv_id, l_orderkey AS jd_id, l_returnflag <> 'N' AS req, round((1 - l_discount) * (l_quantity / 50) * (1 - l_tax), 6) AS p FROM lineitem),
gold AS (SELECT l_suppkey AS cv_id, l_orderkey AS jd_id, CASE WHEN max(l_tax) = 0 THEN 'none' WHEN avg(l_quantity) >= 30 THEN 'strong' WHEN avg(l_quantity) >= 18 THEN 'possible' ELSE 'no' END AS gold FROM lineitem GROUP BY 1, 2),
g AS (SELECT run, gate, cv_id, jd_id, count(*) FILTER (req) AS rt, count(*) FILTER (NOT req) AS nt, coalesce(sum(p) FILTER (req AND p >= gate), 0) AS rs, coalesce(sum(p) FILTER (NOT req AND p >= gate), 0) AS ns FROM f, (VALUES {values([(x,) for x in _GATES])}) v(gate) GROUP BY 1, 2, 3, 4),
s AS (SELECT run, gate, weight, gold, round(greatest(0, least(1, CASE WHEN rt > 0 THEN weight * rs / rt + (1 - weight) * CASE WHEN nt > 0 THEN ns / nt ELSE 0 END WHEN nt > 0 THEN ns / nt ELSE 0 END)), 9) AS score
  FROM g JOIN gold USING (cv_id, jd_id), (VALUES {values([(x,) for x in _WEIGHTS])}) w(weight)),
q AS (SELECT run, gate, weight, t1, t2, gold, CASE WHEN score >= t1 THEN 'strong' WHEN score >= t2 THEN 'possible' ELSE 'no' END AS p FROM s, (VALUES {values(_PAIRS)}) t(t1, t2)),
n AS (SELECT run, gate, weight, t1, t2, {n} FROM q GROUP BY 1, 2, 3, 4, 5), m AS (SELECT *, {m} FROM n), x AS (SELECT *, {f1} FROM m),
c AS (SELECT run, gate, weight, t1, t2, (f_strong + f_possible + f_no) / 3 AS macro_f1, {div(" + ".join(f"f_{c} * {sup[c]}" for c in _CLASSES), f"({every})")} AS weighted_f1, {div(" + ".join(f"{c}_{c}" for c in _CLASSES), f"({every})")} AS accuracy,
  (r_strong + r_possible + r_no) / ({" + ".join(f"CASE WHEN {sup[c]} > 0 THEN 1 ELSE 0 END" for c in _CLASSES)}) AS balanced_accuracy, {guards(0.05, [bucket])} AS failed, {guards(1e-9, [])} AS failed_relaxed FROM x)
{tail}"""


def _combinations(spark, d):
    li = T(spark, d, "lineitem").repartition("l_suppkey", "l_orderkey")  # the groupings and the join below need no other place
    pair = [F.col("l_suppkey").alias("cv_id"), F.col("l_orderkey").alias("jd_id")]
    p = F.round((1 - F.col("l_discount")) * (F.col("l_quantity") / 50) * (1 - F.col("l_tax")), 6)
    factors = li.select(F.col("l_linestatus").alias("run"), *pair, F.when(F.col("l_returnflag") != "N", "required").otherwise("nice_to_have").alias("importance"), F.lit(1.0).alias("req_conf"), p.alias("cand_conf"), F.lit(1.0).alias("uri_sim"))
    mean = F.avg("l_quantity")
    gold = li.groupBy(*pair).agg(F.when(F.max("l_tax") > 0, F.when(mean >= 30, "strong").when(mean >= 18, "possible").otherwise("no")).alias("gold"))
    scored = tuning.regraded(factors, _GATES, _WEIGHTS, ("run",)).join(gold, ["cv_id", "jd_id"])
    return tuning.combinations(scored.withColumn("score", F.round("score", 9)), ["run", "gate", "weight"], _PAIRS)


_FIGURES = ("macro_f1", "weighted_f1", "accuracy", "balanced_accuracy")


@query(_search_sql("SELECT run, gate, weight, t1, t2, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FIGURES) + ", failed, failed_relaxed FROM c"))
def tuning_combinations(spark, d):
    """AGG21, AGG25: every setting of linker run, gate, weight and both thresholds, with its figures and the guards it fails."""
    c = _combinations(spark, d)
    return c.select("run", "gate", "weight", "t1", "t2", *(r6(F.col(x), x) for x in _FIGURES), F.array_join("failed", ",").alias("failed"), F.array_join("failed_relaxed", ",").alias("failed_relaxed"))


@query(_search_sql("""
SELECT * FROM (SELECT 'strict' AS kind, run, gate, weight, t1, t2, round(macro_f1, 6) AS macro_f1 FROM c WHERE failed = '' ORDER BY round(macro_f1, 9) DESC, run, gate, weight, t1, t2 LIMIT 1) UNION ALL
SELECT * FROM (SELECT 'relaxed', run, gate, weight, t1, t2, round(macro_f1, 6) FROM c WHERE failed_relaxed = '' ORDER BY round(macro_f1, 9) DESC, run, gate, weight, t1, t2 LIMIT 1) UNION ALL
SELECT * FROM (SELECT 'unguarded', run, gate, weight, t1, t2, round(macro_f1, 6) FROM c ORDER BY round(macro_f1, 9) DESC, run, gate, weight, t1, t2 LIMIT 1)"""))  # fmt: skip
def tuning_winners(spark, d):
    """AGG25: the best setting under all guards, under the relaxed ones and under none."""
    w = tuning.winners(_combinations(spark, d), ["run", "gate", "weight"])
    return w.select("kind", "run", "gate", "weight", "t1", "t2", r6(F.col("macro_f1"), "macro_f1"))


# ---- taxonomy ------------------------------------------------------------------


@query(
    """
WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS child, 's' || (c_custkey % (SELECT count(*) FROM supplier)) AS parent FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, min('r' || n_regionkey) FROM nation GROUP BY 1
  UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey = 0 THEN 'all' ELSE 'r' || (r_regionkey - 1) END FROM region),
w AS (SELECT child AS node, parent AS ancestor, 1 AS level FROM e UNION ALL SELECT w.node, e.parent, level + 1 FROM w JOIN e ON e.child = w.ancestor)
SELECT node, ancestor, CAST(level AS INT) AS level FROM w"""
)
def taxonomy_closure(spark, d):
    """SRC9, SRC10: every ancestor of every node with its level, by doubled paths; the first parent counts."""
    n = T(spark, d, "supplier").count()
    part = lambda t, a, p, b: T(spark, d, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("child"), b.alias("parent"), F.lit(0).alias("ord"))
    up = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    edges = part("customer", "c_custkey", "c", up("s", F.col("c_custkey") % n)).union(part("supplier", "s_suppkey", "s", up("n", F.col("s_nationkey")))).union(part("nation", "n_nationkey", "n", up("r", F.col("n_regionkey"))))
    edges = edges.union(part("region", "r_regionkey", "r", F.when(F.col("r_regionkey") == 0, "all").otherwise(up("r", F.col("r_regionkey") - 1))))
    later = edges.select("child", F.lit("a").alias("parent"), F.lit(1).alias("ord"))  # a second parent of each, which does not count
    return preparation.closure(edges.union(later)).select("node", "ancestor", "level")


@query("SELECT p_partkey AS concept_uri FROM part UNION SELECT -s_suppkey - 1 FROM supplier UNION SELECT l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT p_partkey FROM part)")
def known_uris(spark, d):
    """SET4: the set of all known concepts, of the taxonomy and own ones."""
    own = T(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("concept_uri"))
    return taxonomy.known_uris(T(spark, d, "part").select(F.col("p_partkey").alias("concept_uri")), own)


# ---- similarity of gold concepts -------------------------------------------------

_TURNED = "list_append(CAST(embedding AS DOUBLE[])[2:], CAST(embedding AS DOUBLE[])[1])"


def _turned():
    return F.concat(F.slice("vec", 2, F.size("vec") - 1), F.slice("vec", 1, 1))


@query(
    f"""
WITH e AS (SELECT 'plain' AS encoder, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL SELECT 'turned', vec_id, label, {_TURNED} FROM embeddings WHERE label <> 1),
gold AS (SELECT DISTINCT l_suppkey AS cv_id, l_partkey AS uri FROM lineitem JOIN embeddings ON vec_id = l_partkey WHERE label <> 1),
s AS (SELECT cv_id, uri, w.encoder, w.vec_id, round(list_dot_product(w.v, c.v), 12) AS sim FROM gold JOIN e c ON c.vec_id = uri JOIN e w ON w.encoder = c.encoder AND w.label = cv_id % 10)
SELECT cv_id, uri, encoder, vec_id AS "window", round(sim, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY cv_id, uri, encoder ORDER BY sim DESC, vec_id) = 1"""
)
def gold_similarity(spark, d):
    """JON33: the best window of a document for each of its gold concepts, under two encoders."""
    e = T(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    both = e.withColumn("encoder", F.lit("plain")).unionByName(e.filter("label <> 1").withColumn("vec", _turned()).withColumn("encoder", F.lit("turned")))
    gold = T(spark, d, "lineitem").select(F.col("l_suppkey").alias("cv_id"), F.col("l_partkey").alias("uri"))
    windows = both.select(F.col("label").alias("group"), "encoder", F.col("vec_id").alias("window"), "vec")
    groups = gold.select("cv_id", (F.col("cv_id") % 10).cast("int").alias("group"))
    out = linking.gold_similarity(gold, both.select("encoder", F.col("vec_id").alias("uri"), "vec"), windows, groups)
    return out.select("cv_id", "uri", "encoder", "window", r6(F.col("similarity"), "similarity"))


@query(
    """
WITH r AS (SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey, l_shipdate FROM lineitem),
d AS (SELECT l_returnflag, id, min(l_partkey) AS a, min(l_suppkey) AS u FROM r GROUP BY 1, 2),
s AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('5|' || id), id) <= 40)
SELECT l_returnflag AS stratum, id, round(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS similarity FROM s JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = u"""
)
def similarity_sample(spark, d):
    """TRN8: forty pairs of each stratum, drawn by hash order, with the similarity of their sides."""
    li = T(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("stratum"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_partkey").alias("anchor"), F.min("l_suppkey").alias("uri"))
    vectors = T(spark, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("vec"))
    out = preparation.sampled_similarity(li, vectors, ["stratum"], "id", 40, 5)
    return out.select("stratum", "id", r6(F.col("similarity"), "similarity"))


# ---- pairs and matrices ------------------------------------------------------------


@query(
    """
WITH s AS (SELECT event_id AS span, user_id AS doc_id, event_type AS uri, CAST(round(value) AS INT) AS s, CAST(round(value) AS INT) + 5 AS e, (event_id * 7) % 100 / 100.0 AS c FROM events WHERE value IS NOT NULL),
w AS (SELECT c_custkey AS win, c_custkey % 150 AS doc_id, (c_custkey * 7) % 400 AS w0, (c_custkey * 7) % 400 + 20 + c_custkey % 300 AS w1 FROM customer),
b AS (SELECT *, w0 <= s AND w1 >= e AS inside FROM s JOIN w USING (doc_id) WHERE c >= 0.65), n AS (SELECT span, doc_id, uri, bool_or(inside) AS any_in, arg_min(win, struct_pack(a := abs(w0 - s), b := win)) AS win FROM b GROUP BY 1, 2, 3)
SELECT doc_id, span, uri, win AS "window" FROM b WHERE inside UNION ALL SELECT doc_id, span, uri, win FROM n WHERE NOT any_in"""
)
def positive_windows(spark, d):
    """TRN3: confident spans with each window that covers them, or the nearest."""
    s = F.round("value").cast("int")
    spans = T(spark, d, "events").filter("value is not null").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("span"), F.col("event_type").alias("uri"), s.alias("s"), (s + 5).alias("e"), (F.col("event_id") * 7 % 100 / 100).alias("confidence"))
    c = F.col("c_custkey")
    windows = T(spark, d, "customer").select(c.alias("window"), (c % 150).alias("doc_id"), (c * 7 % 400).alias("w0"), (c * 7 % 400 + 20 + c % 300).alias("w1"))
    return preparation.positive_pairs(spans, windows, 0.65)


@query(
    """
WITH l AS (SELECT l_suppkey AS cv_id, max(l_returnflag) FILTER (l_linenumber = 1) AS a, max(l_linestatus) FILTER (l_linenumber = 2) AS b, max(l_returnflag) FILTER (l_linenumber = 3) AS c FROM lineitem GROUP BY 1),
u AS (SELECT cv_id, unnest(['1', '2', '3']) AS jd_id, unnest([CASE a WHEN 'R' THEN ' Strong ' WHEN 'A' THEN 'possible' ELSE '' END, CASE b WHEN 'O' THEN 'NO' ELSE 'maybe' END, CASE c WHEN 'R' THEN 'strong' END]) AS fit FROM l)
SELECT cv_id, jd_id, lower(trim(fit)) AS fit FROM u WHERE lower(trim(fit)) IN ('strong', 'possible', 'no')"""
)
def matrix_unpivot(spark, d):
    """SRC16, SRC17: a wide matrix of judgments to rows; blank and unknown ones are none."""
    at = lambda n, c: F.max(F.when(F.col("l_linenumber") == n, F.col(c)))
    wide = T(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cv_id")).agg(at(1, "l_returnflag").alias("a"), at(2, "l_linestatus").alias("b"), at(3, "l_returnflag").alias("c"))
    fit = wide.select("cv_id", F.when(F.col("a") == "R", " Strong ").when(F.col("a") == "A", "possible").otherwise("").alias("1"), F.when(F.col("b") == "O", "NO").otherwise("maybe").alias("2"), F.when(F.col("c") == "R", "strong").alias("3"))
    return taxonomy.fit_matrix(fit)
