"""Registered queries: the operators over the driver's tables, each with its SQL.

The tables stand in for a talent-matching store: suppliers are documents' owners
(cv), orders are positions (jd), line items are their requirements and the
skills of suppliers, customers are stored CVs, events are match jobs and requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scores, text
from ..operators import comparison, evaluation, layout, lexical, linking, operations, preparation, scoring, tuning
from ..sources import taxonomy
from ..streaming import limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# ---- text ----------------------------------------------------------------

WORDS_IN_TEXT = ["the", "and", "tion", "que", "der", "los", "ment", "ing", "$$$", "!!"]
_HITS = " + ".join(f"CAST(contains(lower(t), '{k}') AS INT)" for k in WORDS_IN_TEXT)


@query(
    rf"""
WITH c AS (
  SELECT doc_id, n_chars, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    replace(replace(replace(coalesce(text, ''), 'ﬃ', 'ffi'), 'ﬁ', 'fi'), 'ﬂ', 'fl'),
    '[\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g'), '[^\x09\x0A\x0D\x20-\x7E\x{{80}}-\x{{FFFD}}]', '', 'g'),
    '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents
), q AS (SELECT doc_id, t, 1 + n_chars // 3000 AS pages, {_HITS} AS hits FROM c)
SELECT doc_id, length(t) AS n_clean, sha256(t) AS clean_sha256, CAST(hits AS INT) AS hits, hits >= 2 AS likely,
  CASE WHEN length(t) > 0 THEN round(least(1.0, length(t) / (100.0 * pages)) * (0.5 * (length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / length(t)) + 0.5 * least(1.0, hits / {len(WORDS_IN_TEXT)}.0)), 4) ELSE 0.0 END AS quality
FROM q"""
)
def text_clean_quality(spark, d):
    """PRJ1, PRJ2, FLT1: cleaned text, its quality score and the keyword test."""
    rows = T(spark, d, "documents").select("doc_id", "n_chars", text.clean(F.col("text")).alias("t"))
    return rows.select(
        "doc_id", F.length("t").cast("long").alias("n_clean"), F.sha2("t", 256).alias("clean_sha256"), text.keyword_hits(F.col("t"), WORDS_IN_TEXT).alias("hits"),
        text.likely_document(F.col("t"), WORDS_IN_TEXT).alias("likely"), text.quality(F.col("t"), F.floor(1 + F.floor(F.col("n_chars") / 3000)), WORDS_IN_TEXT).alias("quality"),
    )


@query(
    r"""
WITH e AS (
  SELECT doc_id, [lower(regexp_replace(x, '^[.,;:<>()\[\]{}"'']+|[.,;:<>()\[\]{}"'']+$', '', 'g')) for x in regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')] AS l FROM documents
), f AS (SELECT doc_id, [x for x in l if regexp_matches(x, '^[^@]+@[^@.][^@]*\.[^@.]+$')] AS l FROM e),
u AS (SELECT doc_id, [l[i] for i in range(1, len(l) + 1) if list_position(l, l[i]) = i] AS l FROM f)
SELECT doc_id, CAST(len(l) AS INT) AS n, array_to_string(l, ',') AS emails, CASE WHEN len(l) > 0 THEN l[1] END AS first_email FROM u WHERE len(l) > 0"""
)
def email_extract(spark, d):
    """SCL6, FLT14: addresses of each document, once each, in order."""
    e = T(spark, d, "documents").select("doc_id", text.emails(F.col("text")).alias("l")).filter(F.size("l") > 0)
    return e.select("doc_id", F.size("l").alias("n"), F.array_join("l", ",").alias("emails"), F.get("l", F.lit(0)).alias("first_email"))


@query(
    """
WITH u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ' ' || upper(o_orderpriority) || '@X.ORG ' ELSE '  ' END AS form, CASE WHEN o_orderkey % 2 = 0 THEN 'm' || o_custkey || '@y.org' END AS man,
  CASE WHEN o_orderstatus = 'F' THEN 'E@z.org' END AS ext FROM orders),
n AS (SELECT o_orderkey, nullif(lower(trim(form)), '') AS f, nullif(lower(trim(man)), '') AS m, nullif(lower(trim(ext)), '') AS x FROM u)
SELECT CASE WHEN f IS NOT NULL THEN 'FORM' WHEN m IS NOT NULL THEN 'MANUAL' WHEN x IS NOT NULL THEN 'EXTRACTED' ELSE 'NONE' END AS source, count(*) AS n, count(DISTINCT coalesce(f, m, x)) AS distinct_emails FROM n GROUP BY 1"""
)
def email_resolution(spark, d):
    """PRJ23: form, manual, extracted, none."""
    o = T(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.upper("o_orderpriority"), F.lit("@X.ORG "))).otherwise("  ").alias("form"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("m"), F.col("o_custkey"), F.lit("@y.org"))).alias("man"),
        F.when(F.col("o_orderstatus") == "F", "E@z.org").alias("ext"),
    )
    e = o.select(text.effective_email(F.col("form"), F.col("man"), F.col("ext")).alias("e"))
    return e.groupBy(F.col("e.source").alias("source")).agg(F.count("*").alias("n"), F.count_distinct("e.email").alias("distinct_emails"))


_LINES = r"""
l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l),
p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e),
k AS (SELECT *, strip_accents(lower(trim(regexp_replace(trim(line), '[^\p{L}\p{N}_\s]+\s*$', '')))) AS key FROM p WHERE length(trim(line)) <= 60),
h AS (SELECT key, CASE WHEN length(key) % 2 = 0 THEN 'skills' ELSE 'experience' END AS label FROM (SELECT key, count(DISTINCT doc_id) AS n FROM k WHERE length(key) > 0 GROUP BY key) WHERE n >= 3)
""".replace("\\\\", "\\")


def _headers(documents: DataFrame) -> DataFrame:
    """Short lines that at least three documents have stand in for section headers."""
    keys = lexical.lines(documents).select("doc_id", text.header_key(F.col("line")).alias("key")).filter("key is not null")
    some = keys.groupBy("key").agg(F.count_distinct("doc_id").alias("n")).filter("n >= 3")
    return some.select("key", F.when(F.length("key") % 2 == 0, "skills").otherwise("experience").alias("label"))


@query(
    "WITH "
    + _LINES
    + """, m AS (SELECT doc_id, label, s + length(line) + 1 AS st, s AS hs FROM k JOIN h USING (key)),
a AS (SELECT doc_id, 'other' AS label, 0 AS st, -1 AS hs FROM documents UNION ALL SELECT * FROM m),
n AS (SELECT a.*, coalesce(lead(hs) OVER (PARTITION BY a.doc_id ORDER BY hs), length(coalesce(text, ''))) AS en FROM a JOIN documents USING (doc_id))
SELECT doc_id, label, CAST(least(st, en) AS BIGINT) AS "start", CAST(greatest(least(st, en), en) AS BIGINT) AS "end" FROM n"""
)
def section_detection(spark, d):
    """PRJ6, PRJ7, WIN8: sections between whole-line headers."""
    docs = T(spark, d, "documents")
    s = lexical.sections(docs, _headers(docs))
    return s.select("doc_id", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\.?[A-Za-z0-9_]+(?:[+\-#./][A-Za-z0-9_]+)*[+#]*') AS t FROM documents),
n AS (SELECT doc_id, t, CAST(CASE WHEN len(t) <= 30 THEN 1 ELSE 1 + ceil((len(t) - 30) / 15.0) END AS INT) AS c FROM t WHERE len(t) > 0),
w AS (SELECT doc_id, t, unnest(range(c)) AS k FROM n)
SELECT doc_id, CAST(k AS INT) AS "window", CAST(k * 15 AS INT) AS first_token, CAST(len(t[k * 15 + 1 : k * 15 + 30]) AS INT) AS n_tokens, t[k * 15 + 1] AS head, md5(array_to_string(t[k * 15 + 1 : k * 15 + 30], ' ')) AS digest FROM w"""
)
def token_windows(spark, d):
    """SCL5, WIN6, WIN7: windows of 30 tokens, 15 apart, over every token."""
    w = linking.token_windows(T(spark, d, "documents"))
    return w.select("doc_id", "window", "first_token", "n_tokens", F.get("tokens", F.lit(0)).alias("head"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def _patterns(spark, d) -> DataFrame:
    """Three words of each benchmark item as preferred labels, two as alternatives."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(lexical.WORD), 0)
    b = T(spark, d, "benchmark").select("item_id", w.alias("w"))
    part = lambda a, n, kind: b.filter(F.size("w") >= a + n - 1).select(F.concat(F.lit("c"), "item_id").alias("concept_uri"), F.get("w", F.lit(0)).alias("label"), F.lit(kind).alias("label_kind"), F.concat_ws(" ", F.slice("w", a, n)).alias("surface"))
    return part(1, 3, "preferred").unionByName(part(5, 2, "alt"))


_PATTERN_SQL = r"""
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
pat AS (SELECT 'c' || item_id AS concept_uri, w[1] AS label, 'preferred' AS label_kind, array_to_string(w[1:3], ' ') AS key, 3 AS n FROM b WHERE len(w) >= 3
  UNION ALL SELECT 'c' || item_id, w[1], 'alt', array_to_string(w[5:6], ' '), 2 FROM b WHERE len(w) >= 6),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 2)) AS pos, w, 3 AS n FROM dw WHERE len(w) >= 3 UNION ALL SELECT doc_id, unnest(range(len(w) - 1)), w, 2 FROM dw WHERE len(w) >= 2),
hit AS (SELECT doc_id, concept_uri, label, label_kind, pos, g.n FROM (SELECT doc_id, pos, n, array_to_string(w[pos + 1 : pos + n], ' ') AS key FROM g) g JOIN pat USING (key, n))
"""


@query("WITH " + _PATTERN_SQL + "SELECT doc_id, concept_uri, label_kind, CAST(pos AS INT) AS pos FROM hit")
def phrase_match(spark, d):
    """JON1, PRJ8: every occurrence of every dictionary phrase."""
    return lexical.phrase_hits(T(spark, d, "documents"), _patterns(spark, d)).select("doc_id", "concept_uri", "label_kind", "pos")


@query(
    "WITH "
    + _PATTERN_SQL
    + """, k AS (SELECT *, CASE label_kind WHEN 'preferred' THEN 1.0 ELSE 0.85 END AS w, CASE WHEN pos < 40 THEN 'skills' WHEN pos < 160 THEN 'education' ELSE 'other' END AS sec FROM hit),
sp AS (SELECT doc_id, concept_uri, pos, pos + n AS e, max(w) AS w, arg_max(sec, w) AS sec FROM k GROUP BY 1, 2, 3, 4),
a AS (SELECT doc_id, concept_uri, max(w) AS w, max(CASE sec WHEN 'skills' THEN 1.0 WHEN 'education' THEN 0.7 ELSE 0.5 END) AS sw, count(*) AS f, min(pos) AS first_pos FROM sp GROUP BY 1, 2)
SELECT doc_id, concept_uri, CAST(f AS BIGINT) AS frequency, CASE sw WHEN 1.0 THEN 'skills' WHEN 0.7 THEN 'education' ELSE 'other' END AS section, CASE w WHEN 1.0 THEN 'exact' ELSE 'alt' END AS match_kind,
  round(least(1.0, sw * w * (1 + ln(1 + f)) / (1 + ln(2))), 6) AS confidence, CAST(first_pos AS INT) AS first_pos FROM a"""
)
def skill_aggregation(spark, d):
    """AGG1, AGG2, JON6: hits to one row for each document and concept, with confidence."""
    h = lexical.phrase_hits(T(spark, d, "documents"), _patterns(spark, d))
    h = h.select("doc_id", "concept_uri", "label", F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end"), "surface", lexical.match_kind(F.col("label_kind")).alias("match_kind"), F.lit(1).alias("one"))
    parts = T(spark, d, "documents").select("doc_id", F.inline(F.array(*(F.struct(F.lit(n).alias("label"), F.lit(a).alias("start"), F.lit(b).alias("end")) for n, a, b in (("skills", 0, 40), ("education", 40, 160), ("other", 160, 2**31 - 1))))))
    m = lexical.skill_matches(lexical.in_sections(h, parts))
    return m.select("doc_id", "concept_uri", "frequency", "section", "match_kind", r6(F.col("confidence"), "confidence"), F.col("spans")[0]["s"].alias("first_pos"))


@query(
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
v AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
h AS (SELECT item_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM v),
j AS (SELECT doc_id, item_id, count(*) AS c, any_value(nd) AS nd, any_value(nh) AS nh FROM (SELECT doc_id, len(s) AS nd, unnest(s) AS x FROM s) JOIN (SELECT item_id, len(s) AS nh, unnest(s) AS x FROM h) USING (x) GROUP BY 1, 2),
r AS (SELECT *, c / (nd + nh - c) AS jac, row_number() OVER (PARTITION BY doc_id ORDER BY c / (nd + nh - c) DESC, item_id) AS rn FROM j)
SELECT doc_id, item_id, round(jac, 6) AS jaccard, jac >= 0.85 AS rejected FROM r WHERE rn = 1"""
)
def near_duplicate_join(spark, d):
    """JON19, SCL12, SCL13: the held-out text most like each document."""
    b = preparation.best_overlap(T(spark, d, "documents"), T(spark, d, "benchmark"))
    return b.select("doc_id", "item_id", r6(F.col("jaccard"), "jaccard"), (F.col("jaccard") >= C.JACCARD).alias("rejected"))


@query("SELECT doc_id, source FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 50 = 0)")
def exact_contamination(spark, d):
    """JON18, SCL10: documents equal to a held-out text."""
    docs = T(spark, d, "documents")
    return preparation.exact_contamination(docs, docs.filter("doc_id % 50 = 0")).select("doc_id", "source")


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_wins_dedupe(spark, d):
    """WIN9, JON25: the first document of each content hash."""
    docs = T(spark, d, "documents").select("doc_id", "source", "lang", preparation.content_hash(F.col("text")).alias("h"))
    return operations.first_of(docs, ["h"], ["doc_id"]).select("doc_id", "source", "lang")


@query("SELECT lang, CASE WHEN lang IN ('en', 'fr') THEN NULL WHEN lang IS NULL THEN 'NO_LANGUAGE' ELSE 'UNSUPPORTED_LANGUAGE' END AS error_code, count(*) AS n FROM documents GROUP BY 1, 2")
def language_guard(spark, d):
    """FLT2, PRJ17: documents outside the supported languages get an error code, not an exception."""
    code = F.when(F.col("lang").isin("en", "fr"), None).when(F.col("lang").isNull(), "NO_LANGUAGE").otherwise("UNSUPPORTED_LANGUAGE")
    return T(spark, d, "documents").groupBy("lang", code.alias("error_code")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, substr(sha1(concat_ws('|', source, doc_id, lang)), 1, 16) AS pair_id, left(text, 100) AS evidence FROM documents")
def pair_identifiers(spark, d):
    """SCL9, PRJ14: pair ids and capped evidence."""
    return T(spark, d, "documents").select("doc_id", text.pair_id(F.col("source"), F.col("doc_id"), F.col("lang")).alias("pair_id"), F.left("text", F.lit(100)).alias("evidence"))


@query(
    """
WITH s AS (SELECT field, value, count(*) AS n FROM (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'size', CAST(n_chars // 100 AS VARCHAR) FROM documents) GROUP BY 1, 2)
SELECT field, value, n, round(n / sum(n) OVER (PARTITION BY field), 6) AS share, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, value NULLS LAST) AS INT) AS rank, count(*) OVER (PARTITION BY field) AS "values" FROM s QUALIFY rank <= 20"""
)
def build_statistics(spark, d):
    """AGG28, AGG10, ORD8: the twenty most frequent values of several fields with their share, in one pass."""
    docs = T(spark, d, "documents").withColumn("size", F.floor(F.col("n_chars") / 100))
    s = preparation.top_values(preparation.build_stats(docs, ["lang", "source", "size"]))
    return s.select("field", "value", "n", r6(F.col("share"), "share"), "rank", "values")


@query(
    """
SELECT lang, CASE WHEN grouping(lang) = 1 THEN 1 ELSE 0 END AS level, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, count(*) FILTER (text IS NULL) AS no_chars,
  round(avg(len(string_split(text, ' '))), 6) AS mean_words, count(*) FILTER (text IS NULL) AS no_words FROM documents GROUP BY GROUPING SETS ((lang), ())"""
)
def corpus_profile(spark, d):
    """AGG29: averages, extremes and gaps of the texts of each language and of all."""
    p = preparation.corpus_profile(T(spark, d, "documents"), ["lang"], {"chars": F.length("text"), "words": F.size(F.split("text", " "))})
    return p.select("lang", F.col("level").cast("int").alias("level"), "n", r6(F.col("mean_chars"), "mean_chars"), "min_chars", "max_chars", "no_chars", r6(F.col("mean_words"), "mean_words"), "no_words")


@query(
    """
WITH n AS (SELECT doc_id, lang, md5('7|' || doc_id) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS c FROM n)
SELECT doc_id, CASE WHEN c >= 2 AND rn <= greatest(1, floor(c * 0.2)) THEN 'val' ELSE 'train' END AS split FROM r"""
)
def stratified_split(spark, d):
    """WIN12, TRN7: a fifth of each language validates, in hash order."""
    return preparation.stratified_split(T(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 0.2, 7).select("doc_id", "split")


@query(
    """
WITH w AS (SELECT user_id AS page, CASE WHEN value < 10 OR user_id % 3 = 0 THEN (value % 10) * 3.7 ELSE 55 + CAST(value AS BIGINT) % 44 END AS x FROM events),
b AS (SELECT page, least(floor(x / 5.0), 19) AS bin, count(*) AS n FROM w GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY page) AS words, lag(bin) OVER (PARTITION BY page ORDER BY bin) AS before FROM b),
g AS (SELECT page, count(*) AS gaps, min(before) AS before, max(bin) AS bin FROM r WHERE words >= 10 AND bin - before - 1 >= 2 AND before + 1 < 16 AND bin - 1 >= 4 GROUP BY 1)
SELECT page, round(greatest((before + 1) * 5.0, 20.0), 6) AS left_to, round(least(bin * 5.0, 80.0), 6) AS right_from FROM g WHERE gaps = 1"""
)
def column_detection(spark, d):
    """PRJ3, PRJ4, WIN10: pages with two columns and where each ends."""
    x = F.when((F.col("value") < 10) | (F.col("user_id") % 3 == 0), F.col("value") % 10 * 3.7).otherwise(55 + F.rint("value").cast("long") % 44)
    w = T(spark, d, "events").select(F.col("user_id").alias("page"), x.alias("x"), F.lit(100.0).alias("width"))
    c = layout.column_ranges(layout.column_gaps(w))
    return c.select("page", r6(F.col("left.to"), "left_to"), r6(F.col("right.from"), "right_from"))


# ---- vectors -------------------------------------------------------------

_TOPK = """
s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) AS similarity
  FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings e),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s)
"""


def _nearest(spark, d, k=5):
    e = T(spark, d, "embeddings")
    return linking.top_k(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), k)


@query("WITH " + _TOPK + "SELECT query, id, round(similarity, 6) AS similarity, CASE WHEN similarity >= 0.5 THEN 'strong' WHEN similarity >= 0.3 THEN 'possible' ELSE 'no' END AS fit, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5")
def vector_top_k(spark, d):
    """JON13, WIN3, PRJ19: the five nearest concepts of each query, classed and ranked."""
    return _nearest(spark, d).select("query", "id", r6(F.col("similarity"), "similarity"), scores.projected(F.col("similarity"), 0.5, 0.3).alias("fit"), "rank")


@query(
    "WITH "
    + _TOPK
    + """, r AS (SELECT k.query, min(k.rank) AS rank FROM k JOIN embeddings a ON a.vec_id = k.query JOIN embeddings b ON b.vec_id = k.id WHERE a.label = b.label AND k.id <> k.query AND k.rank <= 10 GROUP BY 1),
a AS (SELECT vec_id AS query, rank FROM embeddings LEFT JOIN r ON r.query = vec_id WHERE vec_id % 50 = 0)
SELECT round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS acc_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS acc_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS acc_k, count(*) AS queries FROM a"""
)
def retrieval_metrics(spark, d):
    """AGG38: mean reciprocal rank and accuracy of the first neighbour of the same label."""
    e = T(spark, d, "embeddings").select("vec_id", "label")
    k = _nearest(spark, d, 10).filter("id <> query")
    k = k.join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("a")), "query").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id").filter("a = b")
    ranks = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query")).join(k.groupBy("query").agg(F.min("rank").alias("rank")), "query", "left")
    m = evaluation.retrieval(ranks)
    return m.select(*(r6(F.col(c), c) for c in ("mrr", "acc_1", "acc_5", "acc_k")), "queries")


@query(
    "WITH "
    + _TOPK
    + """, l AS (SELECT query, id, similarity, ((query * 31 + id * 17) % 100) / 100.0 AS confidence FROM k WHERE rank <= 5)
SELECT query AS cv_id, id AS skill_uri, CASE WHEN similarity >= 0.2 THEN 'lexical_kept' ELSE 'lexical_dropped' END AS source,
  round(CASE WHEN similarity >= 0.3 THEN 0.5 * confidence + 0.5 * similarity WHEN similarity >= 0.2 THEN confidence * similarity / 0.3 ELSE confidence END, 6) AS confidence FROM l"""
)
def band_assignment(spark, d):
    """FLT7, JON5: lexical candidates kept, demoted or dropped by similarity."""
    k = _nearest(spark, d).select(F.col("query").alias("cv_id"), F.col("id").alias("skill_uri"), "similarity")
    lex = k.select("cv_id", "skill_uri", (((F.col("cv_id") * 31 + F.col("skill_uri") * 17) % 100) / 100.0).alias("confidence"))
    return linking.rescored(lex, k, 0.2, 0.3).select("cv_id", "skill_uri", "source", r6(F.col("confidence"), "confidence"))


@query(
    "WITH "
    + _TOPK
    + """, r AS (SELECT query % 7 AS cv_id, query AS w, id, similarity FROM k WHERE rank <= 5 AND similarity >= 0.25),
b AS (SELECT cv_id, id AS skill_uri, max(similarity) AS similarity, arg_max(w, struct_pack(a := similarity, b := -w)) AS w FROM r GROUP BY 1, 2)
SELECT cv_id, skill_uri, round(similarity, 6) AS similarity, w AS "window" FROM b WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id % 7 = b.cv_id AND (e.vec_id * 11 + e.label) % 500 = b.skill_uri)"""
)
def semantic_expansion(spark, d):
    """AGG5, JON9, FLT8: concepts that windows retrieve and the lexical step lacks, the best window each."""
    k = _nearest(spark, d).select((F.col("query") % 7).alias("cv_id"), F.col("query").alias("window"), F.col("id").alias("skill_uri"), "similarity")
    lex = T(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("cv_id"), ((F.col("vec_id") * 11 + F.col("label")) % 500).alias("skill_uri"))
    return linking.expansions(k, lex, 0.25).select("cv_id", "skill_uri", r6(F.col("similarity"), "similarity"), "window")


@query(
    """
WITH q AS (SELECT vec_id % 4 AS cv_id, vec_id AS req_ord, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT vec_id % 4 AS cv_id, vec_id AS cand_uri, 0.5 + (vec_id % 5) / 10.0 AS confidence, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 <> 0),
s AS (SELECT cv_id, req_ord, cand_uri, confidence, greatest(0, least(1, list_dot_product(q.v, c.v))) AS sim FROM q JOIN c USING (cv_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY cv_id, req_ord ORDER BY sim DESC, cand_uri) AS rn FROM s)
SELECT cv_id, req_ord, cand_uri, round(sim, 6) AS similarity, round(confidence, 6) AS match_score FROM r WHERE rn = 1 AND sim >= 0.25"""
)
def semantic_fallback(spark, d):
    """JON11, SCL15: the most similar candidate of the same document for each unmatched requirement."""
    e = T(spark, d, "embeddings").withColumn("cv_id", F.col("vec_id") % 4)
    req = e.filter("vec_id % 50 = 0").select("cv_id", F.lit(0).alias("jd_id"), F.col("vec_id").alias("req_ord"), F.col("embedding").alias("vec"))
    cand = e.filter("vec_id % 50 <> 0").select("cv_id", F.col("vec_id").alias("skill_uri"), (0.5 + (F.col("vec_id") % 5) / 10.0).alias("confidence"), F.col("embedding").alias("vec"))
    return scoring.semantic_fallback(req, cand, 0.25).select("cv_id", "req_ord", "cand_uri", r6(F.col("similarity"), "similarity"), r6(F.col("match_score"), "match_score"))


# ---- scoring -------------------------------------------------------------

_SCORING = """
cand AS (SELECT l_suppkey AS cv_id, l_partkey AS skill_uri, max(1 - 8 * l_discount) AS conf FROM lineitem GROUP BY 1, 2),
pr AS (SELECT DISTINCT l_suppkey AS cv_id, l_orderkey AS jd_id FROM lineitem),
req AS (SELECT l_orderkey AS jd_id, l_linenumber AS req_ord, l_partkey AS skill_uri, CASE WHEN l_returnflag = 'N' THEN 'nice_to_have' ELSE 'required' END AS importance FROM lineitem),
m AS (SELECT pr.cv_id, pr.jd_id, req_ord, importance, req.skill_uri, CASE WHEN conf >= 0.3 THEN conf END AS ms FROM pr JOIN req USING (jd_id) LEFT JOIN cand ON cand.cv_id = pr.cv_id AND cand.skill_uri = req.skill_uri),
g AS (SELECT cv_id, jd_id, count(*) FILTER (importance = 'required') AS rt, count(*) FILTER (importance <> 'required') AS nt, count(ms) FILTER (importance = 'required') AS rm, count(ms) FILTER (importance <> 'required') AS nm,
  coalesce(sum(ms) FILTER (importance = 'required'), 0) AS rs, coalesce(sum(ms) FILTER (importance <> 'required'), 0) AS ns FROM m GROUP BY 1, 2),
o AS (SELECT *, greatest(0, least(1, CASE WHEN rt > 0 THEN 0.85 * rs / rt + 0.15 * CASE WHEN nt > 0 THEN ns / nt ELSE 0 END WHEN nt > 0 THEN ns / nt ELSE 0 END)) AS score FROM g)
"""


def _hits(spark, d):
    """What each pair meets, and the requirements in their places."""
    li = T(spark, d, "lineitem")
    cand = li.select(F.col("l_suppkey").alias("cv_id"), F.col("l_partkey").alias("skill_uri"), (1 - 8 * F.col("l_discount")).alias("confidence"))
    pairs = li.select(F.col("l_suppkey").alias("cv_id"), F.col("l_orderkey").alias("jd_id")).distinct()
    req = li.select(
        F.col("l_orderkey").alias("jd_id"), F.col("l_linenumber").alias("req_ord"), F.col("l_partkey").alias("skill_uri"), F.concat(F.lit("p"), "l_partkey").alias("text"),
        F.when(F.col("l_returnflag") == "N", "nice_to_have").otherwise("required").alias("importance"),
    )
    placed = scoring.placed_requirements(req)
    return scoring.exact_hits(pairs, placed, cand, 0.3), placed


@query("WITH " + _SCORING + "SELECT cv_id, jd_id, round(score, 6) AS overall_score, rt AS required_total, nt AS nice_total, rm AS required_matched, nm AS nice_matched, round(CASE WHEN rt > 0 THEN rm / rt ELSE 0 END, 6) AS required_coverage, round(CASE WHEN nt > 0 THEN nm / nt ELSE 0 END, 6) AS nice_to_have_coverage FROM o")
def overall_score(spark, d):
    """JON10, FLT10, AGG6, AGG16: candidates against requirements, scored and covered."""
    o = scoring.overall_of_hits(_hits(spark, d)[0])
    return o.select("cv_id", "jd_id", *(r6(F.col(c), c) for c in ("overall_score", "required_coverage", "nice_to_have_coverage")), "required_total", "nice_total", "required_matched", "nice_matched")


@query(
    "WITH " + _SCORING + """, k AS (SELECT cv_id, jd_id, CASE WHEN cv_id % 9 = 0 THEN NULL ELSE round(score, 9) END AS score FROM o),
r AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY jd_id ORDER BY score DESC NULLS LAST, cv_id) END AS rank FROM k)
SELECT cv_id, jd_id, round(score, 6) AS overall_score, CAST(rank AS INT) AS rank, CASE WHEN score >= 0.6 THEN 'strong' WHEN score >= 0.3 THEN 'possible' ELSE 'no' END AS fit,
  CASE WHEN floor(score * 100 + 0.5) >= 70 THEN 'excellent' WHEN floor(score * 100 + 0.5) >= 60 THEN 'strong' WHEN floor(score * 100 + 0.5) >= 50 THEN 'partial' WHEN floor(score * 100 + 0.5) >= 30 THEN 'weak' ELSE 'unsuitable' END AS band,
  coalesce(rank <= 3, FALSE) AS shortlisted FROM r"""
)
def ranked_report(spark, d):
    """WIN1, PRJ19, PRJ20, ORD11: candidates of each position ranked, classed, banded; failed rows last."""
    o = scoring.overall_of_hits(_hits(spark, d)[0]).withColumn("overall_score", F.when(F.col("cv_id") % 9 == 0, None).otherwise(F.round("overall_score", 9)))
    s = F.col("overall_score")
    return scoring.ranked(o, "cv_id").select("cv_id", "jd_id", r6(s, "overall_score"), "rank", scores.projected(s, 0.6, 0.3).alias("fit"), scores.display_band(s).alias("band"), F.coalesce(F.col("rank") <= 3, F.lit(False)).alias("shortlisted"))


@query(
    "WITH " + _SCORING + """, t AS (SELECT *, row_number() OVER (PARTITION BY cv_id, jd_id ORDER BY round(ms, 6) DESC NULLS LAST, req_ord, 'p' || skill_uri) AS rn FROM m),
e AS (SELECT cv_id, jd_id, count(*) FILTER (importance = 'required') AS n, count(ms) FILTER (importance = 'required') AS c,
  string_agg('p' || skill_uri || ' (' || printf('%.2f', round(ms, 6)) || ')', ', ' ORDER BY rn) FILTER (rn <= 3 AND ms IS NOT NULL) AS top,
  string_agg('p' || skill_uri, ', ' ORDER BY req_ord, 'p' || skill_uri) FILTER (importance = 'required' AND ms IS NULL) AS gaps FROM t GROUP BY 1, 2)
SELECT cv_id, jd_id, concat_ws(' ', CASE WHEN n > 0 THEN 'Covers ' || c || '/' || n || ' required.' END, 'Strengths: ' || top || '.', 'Missing critical: ' || gaps || '.') AS explanation FROM e"""
)
def explanations(spark, d):
    """PRJ21, PRJ22, WIN4: what a candidate covers, its strengths, what is missing."""
    hits, placed = _hits(spark, d)
    return scoring.explained_of_hits(hits.withColumn("match_score", F.round("match_score", 6)), placed)


@query(
    """
WITH f AS (SELECT l_suppkey AS cv_id, l_orderkey AS jd_id, CASE WHEN l_returnflag = 'N' THEN 'nice_to_have' ELSE 'required' END AS importance, round((1 - l_discount) * (l_quantity / 50) * (1 - l_tax), 6) AS p FROM lineitem),
w AS (SELECT *, CASE WHEN p >= 0.3 THEN p END AS ms FROM f),
g AS (SELECT cv_id, jd_id, count(*) FILTER (importance = 'required') AS rt, count(*) FILTER (importance <> 'required') AS nt, coalesce(sum(ms) FILTER (importance = 'required'), 0) AS rs, coalesce(sum(ms) FILTER (importance <> 'required'), 0) AS ns FROM w GROUP BY 1, 2)
SELECT cv_id, jd_id, round(greatest(0, least(1, CASE WHEN rt > 0 THEN 0.7 * rs / rt + 0.3 * CASE WHEN nt > 0 THEN ns / nt ELSE 0 END WHEN nt > 0 THEN ns / nt ELSE 0 END)), 10) AS overall_score FROM g"""
)
def tri_factor_score(spark, d):
    """AGG7, AGG8: scores from the three factors of each requirement."""
    f = T(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("cv_id"), F.col("l_orderkey").alias("jd_id"), F.when(F.col("l_returnflag") == "N", "nice_to_have").otherwise("required").alias("importance"),
        F.lit(1.0).alias("req_conf"), F.lit(1.0).alias("uri_sim"), F.round((1 - F.col("l_discount")) * (F.col("l_quantity") / 50) * (1 - F.col("l_tax")), 6).alias("cand_conf"),
    )
    return scoring.tri_factor(f, 0.3, 0.7).select("cv_id", "jd_id", F.round("overall_score", 10).alias("overall_score"))


@query(
    """
WITH c AS (SELECT l_suppkey AS cv_id, l_partkey AS skill_uri, l_discount AS confidence, l_tax AS similarity, CASE l_returnflag WHEN 'R' THEN 'lexical_kept' WHEN 'A' THEN 'semantic_expansion' ELSE 'lexical_dropped' END AS source, l_linenumber AS s, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY cv_id, skill_uri ORDER BY confidence DESC, similarity DESC, CASE source WHEN 'lexical_kept' THEN 0 WHEN 'semantic_expansion' THEN 1 ELSE 2 END, s, ord) AS rn FROM c WHERE source <> 'lexical_dropped' OR confidence >= 0.6)
SELECT cv_id, skill_uri, confidence, similarity, source, ord FROM r WHERE rn = 1"""
)
def candidate_dedupe(spark, d):
    """FLT9, AGG3, ORD2: the best admitted candidate of each document and concept."""
    li = T(spark, d, "lineitem")
    c = li.select(
        F.col("l_suppkey").alias("cv_id"), F.col("l_partkey").alias("skill_uri"), F.col("l_discount").alias("confidence"), F.col("l_tax").alias("similarity"),
        F.when(F.col("l_returnflag") == "R", "lexical_kept").when(F.col("l_returnflag") == "A", "semantic_expansion").otherwise("lexical_dropped").alias("source"),
        F.col("l_linenumber").alias("start"), F.lit(None).cast("int").alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return linking.best_candidates(c).select("cv_id", "skill_uri", "confidence", "similarity", "source", "ord")


# ---- evaluation ----------------------------------------------------------

_CELLS = """
li AS (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2, 3),
cells AS (SELECT l_suppkey AS cv_id, l_orderkey AS jd_id, l_linenumber AS k, round(l_quantity / 50, 6) AS score,
  CASE WHEN l_quantity * (1 - 3 * l_discount) >= 30 THEN 'strong' WHEN l_quantity * (1 - 3 * l_discount) >= 12 THEN 'possible' ELSE 'no' END AS gold FROM li),
pred AS (SELECT *, CASE WHEN score >= 0.6 THEN 'strong' WHEN score >= 0.3 THEN 'possible' ELSE 'no' END AS predicted FROM cells)
"""


def _cells(spark, d):
    li = T(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"))
    v = F.col("l_quantity") * (1 - 3 * F.col("l_discount"))
    score = F.round(F.col("l_quantity") / 50, 6)
    return li.select(
        F.col("l_suppkey").alias("cv_id"), F.col("l_orderkey").alias("jd_id"), F.col("l_linenumber").alias("k"), score.alias("score"),
        F.when(v >= 30, "strong").when(v >= 12, "possible").otherwise("no").alias("gold"), scores.projected(score, 0.6, 0.3).alias("predicted"),
    )


_KEY = ["cv_id", "jd_id", "k"]


def _confusion(spark, d):
    c = _cells(spark, d)
    return evaluation.confusion(c.select(*_KEY, "predicted"), c.select(*_KEY, "gold"), _KEY)


@query("WITH " + _CELLS + ", cls AS (SELECT unnest(['strong', 'possible', 'no']) AS c) SELECT g.c AS gold, p.c AS predicted, count(pred.gold) AS n FROM cls g CROSS JOIN cls p LEFT JOIN pred ON pred.gold = g.c AND pred.predicted = p.c GROUP BY 1, 2")
def confusion_matrix(spark, d):
    """AGG18, SET5: gold by predicted, zeros too."""
    return _confusion(spark, d)


_METRICS = """
, cls AS (SELECT unnest(['strong', 'possible', 'no']) AS c),
x AS (SELECT c, count(*) FILTER (gold = c) AS support, count(*) FILTER (predicted = c) AS pn, count(*) FILTER (gold = c AND predicted = c) AS hit FROM cls, pred GROUP BY 1),
y AS (SELECT *, CASE WHEN pn > 0 THEN hit / pn ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM x),
z AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM y)
"""


@query("WITH " + _CELLS + _METRICS + "SELECT c AS class, support, pn AS predicted_n, hit, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM z")
def class_metrics(spark, d):
    """AGG19: precision, recall, F1 of each class."""
    m = evaluation.class_metrics(_confusion(spark, d))
    return m.select("class", *(F.col(c).cast("long").alias(c) for c in ("support", "predicted_n", "hit")), *(r6(F.col(c), c) for c in ("precision", "recall", "f1")))


@query("WITH " + _CELLS + _METRICS + "SELECT round(avg(f), 6) AS macro_f1, round(sum(f * support) / sum(support), 6) AS weighted_f1, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(r) FILTER (support > 0), 6) AS balanced_accuracy FROM z")
def macro_metrics(spark, d):
    """AGG20: macro and weighted F1, accuracy, balanced accuracy."""
    m = evaluation.summary(evaluation.class_metrics(_confusion(spark, d)))
    return m.select(*(r6(F.col(c), c) for c in m.columns))


@query(
    "WITH " + _CELLS + """, t AS (SELECT unnest([0.1, 0.25, 0.4, 0.55, 0.7, 0.85]) AS th), pos AS (SELECT count(*) AS n FROM cells WHERE gold = 'strong'),
a AS (SELECT th, count(*) FILTER (score >= th AND gold = 'strong') AS tp, count(*) FILTER (score >= th) AS pn FROM cells, t GROUP BY 1),
b AS (SELECT a.*, CASE WHEN pn > 0 THEN tp / pn ELSE 0 END AS p, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS r FROM a, pos)
SELECT CAST(th AS DOUBLE) AS threshold, tp, pn AS predicted, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM b"""
)
def threshold_sweep(spark, d):
    """AGG24: a score re-thresholded six times in one pass."""
    s = evaluation.swept(_cells(spark, d), "score", F.col("gold") == "strong", [0.1, 0.25, 0.4, 0.55, 0.7, 0.85])
    return s.select("threshold", "tp", "predicted", *(r6(F.col(c), c) for c in ("precision", "recall", "f1")))


_GRID = [(round(0.1 + 0.08 * a, 2), round(0.06 + 0.08 * b, 2)) for a in range(10) for b in range(10)]


@query(
    "WITH " + _CELLS + ", grid AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in _GRID) + """) v(t1, t2) WHERE t2 < t1),
n AS (SELECT score, gold, count(*) AS n FROM cells GROUP BY 1, 2),
q AS (SELECT t1, t2, gold, CASE WHEN score >= t1 THEN 'strong' WHEN score >= t2 THEN 'possible' ELSE 'no' END AS predicted, n FROM n, grid),
cls AS (SELECT unnest(['strong', 'possible', 'no']) AS c),
x AS (SELECT t1, t2, c, coalesce(sum(n) FILTER (gold = c), 0) AS s, coalesce(sum(n) FILTER (predicted = c), 0) AS pn, coalesce(sum(n) FILTER (gold = c AND predicted = c), 0) AS h FROM q, cls GROUP BY 1, 2, 3),
y AS (SELECT *, CASE WHEN pn > 0 THEN h / pn ELSE 0 END AS p, CASE WHEN s > 0 THEN h / s ELSE 0 END AS r FROM x),
m AS (SELECT t1, t2, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS macro_f1, sum(h) / sum(s) AS accuracy FROM y GROUP BY 1, 2)
SELECT t1, t2, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy, CAST(row_number() OVER (ORDER BY round(macro_f1, 9) DESC, t1, t2) AS INT) AS rank FROM m"""
)
def grid_search(spark, d):
    """AGG25, ORD4: every pair of class thresholds, ranked by macro F1."""
    g = tuning.grid_search(_cells(spark, d).select("score", "gold"), [(a, b) for a, b in _GRID if b < a])
    return g.select("t1", "t2", r6(F.col("macro_f1"), "macro_f1"), r6(F.col("accuracy"), "accuracy"), "rank")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM events GROUP BY 1")
def score_percentiles(spark, d):
    """AGG26, AGG34: interpolated percentiles by class."""
    p = evaluation.percentiles(T(spark, d, "events"), "value", ["event_type"])
    return p.select("event_type", "n", *(r6(F.col(c), c) for c in p.columns[2:]))


@query("SELECT CAST(CASE WHEN value >= 0 AND value < 10 THEN 0 WHEN value >= 10 AND value < 50 THEN 1 WHEN value >= 50 AND value < 100 THEN 2 ELSE 3 END AS INT) AS bin, count(*) AS n FROM events GROUP BY 1")
def value_histogram(spark, d):
    """AGG33: half-open bins, the rest in the last."""
    return evaluation.histogram(T(spark, d, "events"), "value", [0, 10, 50, 100, 200])


@query("WITH " + _CELLS + "SELECT cv_id, k, count(*) AS n, count(*) FILTER (gold = predicted) AS agree, round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, " + ", ".join(f"count(*) FILTER (gold = '{c}') AS gold_{c}, count(*) FILTER (gold = '{c}' AND predicted = '{c}') AS hit_{c}" for c in ("strong", "possible", "no")) + " FROM pred GROUP BY GROUPING SETS ((cv_id), (k), ())")
def group_breakdown(spark, d):
    """AGG31, AGG39, AGG40: figures by document, by requirement place and in all."""
    b = evaluation.breakdown(_cells(spark, d), ["cv_id", "k"])
    return b.select("cv_id", "k", "n", "agree", *(r6(F.col(c), c) for c in ("mean_score", "min_score", "max_score")), *b.columns[7:])


@query("WITH " + _CELLS + "SELECT cv_id, count(*) FILTER (gold = 'strong') AS strong, count(*) FILTER (gold = 'possible') AS possible, count(*) FILTER (gold = 'no') AS no FROM cells GROUP BY ROLLUP (cv_id)")
def class_composition(spark, d):
    """AGG43: judgments by document and over all."""
    return evaluation.composition(_cells(spark, d), "cv_id")


@query("WITH " + _CELLS + "SELECT cv_id, jd_id, k, gold, predicted, CAST(abs(CASE gold WHEN 'strong' THEN 2 WHEN 'possible' THEN 1 ELSE 0 END - CASE predicted WHEN 'strong' THEN 2 WHEN 'possible' THEN 1 ELSE 0 END) AS INT) AS distance FROM pred WHERE gold <> predicted ORDER BY distance DESC, cv_id, jd_id, k LIMIT 10")
def top_disagreements(spark, d):
    """WIN5, SCL18: the ten worst disagreements by distance of class."""
    c = _cells(spark, d).filter("gold <> predicted").withColumn("distance", scores.class_distance(F.col("gold"), F.col("predicted")))
    return c.orderBy(F.desc("distance"), *_KEY).limit(10).select(*_KEY, "gold", "predicted", "distance")


@query(
    """
WITH a AS (SELECT o_custkey AS cv_id, list(DISTINCT l_partkey % 40) FILTER (l_returnflag = 'R') AS p, list(DISTINCT l_partkey % 40) FILTER (l_linestatus = 'F') AS g FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
b AS (SELECT cv_id, coalesce(p, []) AS p, coalesce(g, []) AS g FROM a), c AS (SELECT *, len(list_intersect(p, g)) AS h FROM b),
e AS (SELECT cv_id, CASE WHEN len(p) = 0 THEN 1.0 ELSE h / len(p) END AS pr, CASE WHEN len(p) = 0 AND len(g) > 0 THEN 0.0 WHEN len(g) = 0 THEN 1.0 ELSE h / len(g) END AS rc, len(list_distinct(list_concat(p, g))) AS u FROM c)
SELECT cv_id, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1, CAST(u AS INT) AS union_size FROM e"""
)
def set_metrics(spark, d):
    """AGG22, SET2, SET3: precision, recall, F1 of sets, and their union."""
    j = T(spark, d, "lineitem").join(T(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    u = (F.col("l_partkey") % 40).alias("u")
    s = j.groupBy(F.col("o_custkey").alias("cv_id")).agg(F.collect_set(F.when(F.col("l_returnflag") == "R", u)).alias("p"), F.collect_set(F.when(F.col("l_linestatus") == "F", u)).alias("g"))
    m = s.select("cv_id", scores.set_prf(F.col("p"), F.col("g")).alias("m"), F.size(F.array_union("p", "g")).alias("union_size"))
    return m.select("cv_id", *(r6(F.col(f"m.{c}"), c) for c in ("precision", "recall", "f1")), "union_size")


@query(
    """
WITH c AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, round(sum(value), 6) AS v FROM events GROUP BY 1, 2),
l AS (SELECT *, coalesce(v >= lag(v) OVER (PARTITION BY user_id ORDER BY day) - 1e-9, TRUE) AS up FROM c)
SELECT user_id, CAST(arg_max(day, struct_pack(a := v, b := -epoch(day))) AS VARCHAR) AS peak_x, round(max(v), 6) AS peak, bool_and(up) AS monotone, round(max(v) - arg_max(v, day), 6) AS gap FROM l GROUP BY 1"""
)
def curve_peaks(spark, d):
    """WIN11: peak, monotony and end gap of each user's daily curve."""
    c = T(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))
    p = evaluation.peak(c.withColumn("x", F.unix_date("day")), ["user_id"], "x", "v")
    return p.select("user_id", F.date_from_unix_date("peak_x").cast("string").alias("peak_x"), r6(F.col("peak"), "peak"), "monotone", r6(F.col("gap"), "gap"))


# ---- operations ----------------------------------------------------------

_APPS = """
app AS (SELECT o_orderkey AS id, o_custkey AS cv_id, o_orderkey % 40 AS jd_id, o_orderdate AS created_at FROM orders),
cv AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN md5(CAST(c_custkey // 3 AS VARCHAR)) END AS content_hash, c_mktsegment FROM customer)
"""


def _apps(spark, d):
    return T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cv_id"), (F.col("o_orderkey") % 40).alias("jd_id"), F.col("o_orderdate").alias("created_at"))


def _cvs(spark, d):
    return T(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 > 0, F.md5(F.floor(F.col("c_custkey") / 3).cast("string"))).alias("content_hash"), F.when(F.col("c_mktsegment") == "BUILDING", "PENDING").otherwise("READY").alias("processing_status"))


@query(
    "WITH " + _APPS + """, a AS (SELECT app.*, coalesce(content_hash, CAST(app.cv_id AS VARCHAR)) AS k, CASE WHEN jd_id = 7 THEN 0 ELSE 1 END AS pri FROM app JOIN cv ON cv.id = app.cv_id WHERE jd_id IN (7, 11, 13)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pri, created_at, id) AS rn FROM a)
SELECT id, cv_id, jd_id, CASE WHEN pri = 0 THEN 'DIRECT' ELSE 'OTHER_JD' END AS origin FROM r WHERE rn = 1"""
)
def candidate_pool(spark, d):
    """JON15, PRJ24: the pool of a position and two others, direct applications first."""
    return operations.pool(_apps(spark, d), _cvs(spark, d), 7, [11, 13]).select("id", "cv_id", "jd_id", "origin")


_JOBS = """jobs AS (SELECT event_id AS id, user_id % 45 AS jd_id, CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'RUNNING' ELSE 'PENDING' END AS status, ts AS created_at, ts AS finished_at, value AS top_score FROM events)"""


def _jobs(spark, d):
    status = F.when(F.col("event_type") == "purchase", "SUCCEEDED").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "RUNNING").otherwise("PENDING")
    return T(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 45).alias("jd_id"), status.alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("finished_at"), F.col("value").alias("top_score"), F.lit(1).alias("candidate_count"), (F.col("user_id") % 3).alias("owner_id"))


@query(
    "WITH " + _APPS + ", " + _JOBS + """, pos AS (SELECT DISTINCT jd_id FROM app UNION SELECT DISTINCT jd_id FROM jobs),
c AS (SELECT jd_id, count(*) AS n FROM app GROUP BY 1), l AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY created_at DESC, id DESC) AS rn FROM jobs),
s AS (SELECT jd_id, max(finished_at) AS last_success FROM jobs WHERE status = 'SUCCEEDED' GROUP BY 1)
SELECT pos.jd_id, coalesce(n, 0) AS applications, status, round(top_score, 6) AS top_score, last_success FROM pos LEFT JOIN c USING (jd_id) LEFT JOIN (SELECT * FROM l WHERE rn = 1) l USING (jd_id) LEFT JOIN s USING (jd_id)"""
)
def dashboard_positions(spark, d):
    """JON17, AGG12, AGG15, WIN2: positions with counts, latest job and last success."""
    a, j = _apps(spark, d), _jobs(spark, d)
    b = operations.dashboard(a.select("jd_id").union(j.select("jd_id")).distinct(), a, j)
    return b.select("jd_id", "applications", "status", r6(F.col("top_score"), "top_score"), "last_success")


@query("WITH " + _APPS + ", " + _JOBS + " SELECT (SELECT count(DISTINCT jd_id) FROM app) AS open_positions, (SELECT count(DISTINCT cv_id) FROM app) AS unique_candidates, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS processing, (SELECT max(finished_at) FROM jobs WHERE status = 'SUCCEEDED') AS last_match")
def dashboard_kpis(spark, d):
    """AGG11, AGG13, AGG14: the KPI record."""
    a = _apps(spark, d)
    return operations.kpis(a.select("jd_id").distinct(), a, _cvs(spark, d), _jobs(spark, d))


@query("SELECT user_id % 45 AS jd_id, event_id AS id, CAST(ts AS TIMESTAMP) AS created_at FROM events WHERE user_id % 3 = 1 AND event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def job_history_page(spark, d):
    """FLT15, FLT16, ORD6: the third page of an owner's succeeded jobs, newest first."""
    h = operations.history(_jobs(spark, d), 1, status="SUCCEEDED")
    return operations.page(h, [F.desc("created_at"), "id"], 2, 20).select("jd_id", "id", "created_at")


@query("WITH " + _APPS + " SELECT r.cv_id, CASE WHEN c_custkey IS NULL THEN 'NOT_FOUND' WHEN k.cv_id IS NOT NULL THEN 'ALREADY' ELSE 'CREATED' END AS status FROM (SELECT DISTINCT l_partkey AS cv_id FROM lineitem) r LEFT JOIN customer ON c_custkey = r.cv_id LEFT JOIN (SELECT DISTINCT cv_id FROM app WHERE jd_id = 7) k ON k.cv_id = r.cv_id")
def attach_partition(spark, d):
    """SET6: requested ids as created, already there, or not found."""
    a = _apps(spark, d)
    return operations.attached(T(spark, d, "lineitem").select(F.col("l_partkey").alias("cv_id")), _cvs(spark, d).select(F.col("id").alias("cv_id")), a.filter("jd_id = 7").select("cv_id"))


@query("SELECT c_custkey AS cv_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT user_id FROM events)")
def orphan_documents(spark, d):
    """JON24, JON28: documents with no application and no job."""
    return operations.orphans(_cvs(spark, d).select(F.col("id").alias("cv_id")), T(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("cv_id")), T(spark, d, "events").select(F.col("user_id").alias("cv_id")))


@query("SELECT source_id, ord, CASE WHEN source_id = 7 THEN 'SELF' WHEN source_id NOT IN (SELECT o_orderkey % 40 FROM orders) THEN 'FOREIGN' END AS reject_reason FROM (SELECT user_id % 60 AS source_id, min(event_id) AS ord FROM events GROUP BY 1)")
def source_validation(spark, d):
    """SET7, FLT21: requested source positions once each, with the reason where one is rejected."""
    r = T(spark, d, "events").select((F.col("user_id") % 60).alias("source_id"), F.col("event_id").alias("ord"))
    return operations.valid_sources(r, _apps(spark, d).select("jd_id"), 7)


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def latest_per_key(spark, d):
    """WIN2, STR8: the latest turn of each conversation."""
    c = T(spark, d, "conversations")
    return operations.latest(c, ["conv_id"], ["turn"]).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("SELECT 'quantity_positive' AS rule, count(*) FILTER (NOT coalesce(l_quantity > 0, FALSE)) AS n FROM lineitem UNION ALL SELECT 'discount_below_9', count(*) FILTER (NOT coalesce(l_discount < 0.09, FALSE)) FROM lineitem UNION ALL SELECT 'flag_known', count(*) FILTER (NOT coalesce(l_returnflag IN ('R', 'A'), FALSE)) FROM lineitem")
def quality_rules(spark, d):
    """Integrity rules as counts of rows that break them."""
    return operations.violations(T(spark, d, "lineitem"), {"quantity_positive": F.col("l_quantity") > 0, "discount_below_9": F.col("l_discount") < 0.09, "flag_known": F.col("l_returnflag").isin("R", "A")})


# ---- taxonomy and preparation ---------------------------------------------


@query(
    """
WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS child, min('n' || s_nationkey) AS parent FROM supplier GROUP BY 1 UNION ALL SELECT 'n' || n_nationkey, min('r' || n_regionkey) FROM nation GROUP BY 1 UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region),
w AS (SELECT child AS node, parent AS cur, 1 AS depth FROM e UNION ALL SELECT w.node, e.parent, depth + 1 FROM w JOIN e ON e.child = w.cur WHERE depth < 10 AND w.cur NOT LIKE 'r%')
SELECT node, cur AS ancestor, CAST(depth AS INT) AS depth FROM w WHERE cur LIKE 'r%'"""
)
def taxonomy_walk(spark, d):
    """JON22: the first target ancestor of each node, in ten hops at most."""
    part = lambda t, a, p, b, q: T(spark, d, t).select(F.concat(F.lit(p), a).alias("child"), (F.concat(F.lit(q), b) if b else F.lit(q)).alias("parent"))
    edges = part("supplier", "s_suppkey", "s", "s_nationkey", "n").union(part("nation", "n_nationkey", "n", "n_regionkey", "r")).union(part("region", "r_regionkey", "r", None, "root"))
    targets = edges.filter("child like 'r%'").select(F.col("child").alias("node")).union(spark.createDataFrame([("root",)], "node string"))
    return preparation.ancestors(edges, targets)


@query(
    """
WITH n AS (SELECT l_suppkey AS cv_id, p_type AS category, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY n DESC, category) AS rn FROM n) SELECT cv_id, category FROM r WHERE rn = 1"""
)
def dominant_category(spark, d):
    """AGG27: the most frequent category of each document's concepts."""
    s = T(spark, d, "lineitem").select(F.col("l_suppkey").alias("cv_id"), F.col("l_partkey").alias("uri"))
    return preparation.dominant_category(s, T(spark, d, "part").select(F.col("p_partkey").alias("uri"), F.col("p_type").alias("category")))


@query(
    """
WITH r AS (SELECT p_partkey AS uri, p_type AS category, row_number() OVER (PARTITION BY p_type ORDER BY md5('3|' || p_partkey), p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_type) AS size,
  row_number() OVER (ORDER BY md5('3|' || p_partkey), p_partkey) - 1 AS spot, count(*) OVER () AS total FROM part),
p AS (SELECT l_orderkey * 10 + l_linenumber AS pair_id, l_partkey AS uri FROM lineitem),
x AS (SELECT *, CAST('0x' || substr(md5('3|' || pair_id), 1, 8) AS BIGINT) AS f FROM p JOIN r USING (uri)),
c AS (SELECT p_brand AS b, min(p_partkey) AS u FROM part GROUP BY 1 UNION SELECT p_brand, max(p_partkey) FROM part GROUP BY 1),
known AS (SELECT pair_id, min(u) AS negative FROM p JOIN part ON p_partkey = uri JOIN c ON b = p_brand AND u <> uri WHERE p_size % 2 = 0 GROUP BY 1),
found AS (SELECT pair_id, uri, negative, 0 AS o, 0 AS k FROM p JOIN known USING (pair_id) WHERE negative <> uri
  UNION ALL SELECT s.pair_id, s.uri, r.uri, 1, k FROM (SELECT *, unnest(range(least(3, size - 1))) AS k FROM x WHERE size > 1) s JOIN r ON r.category = s.category AND r.place = (s.place + 1 + (f + k) % (s.size - 1)) % s.size
  UNION ALL SELECT s.pair_id, s.uri, r.uri, 2, k FROM (SELECT *, unnest(range(least(7, total - 1))) AS k FROM x WHERE size <= 3) s JOIN r ON r.spot = (s.spot + 1 + (f + k) % (s.total - 1)) % s.total),
best AS (SELECT pair_id, uri, negative, min(o * 100 + k) AS w FROM found GROUP BY 1, 2, 3)
SELECT pair_id, uri, negative, CAST(row_number() OVER (PARTITION BY pair_id, uri ORDER BY w, negative) AS INT) AS rank, CASE WHEN w < 100 THEN 'known' WHEN w < 200 THEN 'sibling' ELSE 'any' END AS strategy FROM best QUALIFY rank <= 3"""
)
def hard_negatives(spark, d):
    """TRN4, JON21: three other concepts for each positive: a known false positive, siblings, then any."""
    part = T(spark, d, "part")
    p = T(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id"), F.col("l_partkey").alias("uri"))
    g = part.groupBy(F.col("p_brand").alias("lemma")).agg(F.array(F.min("p_partkey"), F.max("p_partkey")).alias("u"))
    surfaces = p.join(part.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("uri"), F.col("p_brand").alias("surface")), "uri")
    known = comparison.distractors(surfaces, g.select("lemma", F.explode("u").alias("uri")))
    return preparation.hard_negatives(p, part.select(F.col("p_partkey").alias("uri"), F.col("p_type").alias("category")), 3, 3, known)


@query("SELECT l_orderkey * 10 + l_linenumber AS pair_id, l_shipdate || '' AS anchor, p_name || '. ' || p_type AS positive FROM lineitem JOIN part ON p_partkey = l_partkey".replace("l_shipdate || ''", "l_returnflag || l_linestatus"))
def pair_examples(spark, d):
    """TRN5, PRJ9: anchors with the text of their concept."""
    p = T(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id"), F.concat("l_returnflag", "l_linestatus").alias("anchor"), F.col("l_partkey").alias("uri"))
    t = T(spark, d, "part").select(F.col("p_partkey").alias("uri"), text.concept_text(F.col("p_name"), F.array().cast("array<string>"), F.col("p_type")).alias("text"))
    return preparation.pairs(p, t)


@query("SELECT l_suppkey AS cv_id, count(DISTINCT l_partkey) AS needed, count(DISTINCT CASE WHEN l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) THEN l_partkey END) AS covered FROM lineitem GROUP BY 1")
def skill_coverage(spark, d):
    """JON27: how many of a document's concepts the training set has."""
    li = T(spark, d, "lineitem")
    return preparation.coverage(li.filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("uri")), li.select(F.col("l_suppkey").alias("cv_id"), F.col("l_partkey").alias("uri")))


@query(
    """
WITH s AS (SELECT event_id AS span, user_id AS doc_id, CAST(value AS INT) AS s, CAST(value AS INT) + 5 AS e FROM events), w AS (SELECT c_custkey AS win, c_custkey % 150 AS doc_id, (c_custkey * 7) % 400 AS w0, (c_custkey * 7) % 400 + 20 AS w1 FROM customer),
b AS (SELECT *, w0 <= s AND w1 >= e AS inside FROM s JOIN w USING (doc_id)), n AS (SELECT span, doc_id, bool_or(inside) AS any_in, arg_min(win, struct_pack(a := abs(w0 - s), b := win)) AS win FROM b GROUP BY 1, 2)
SELECT doc_id, span, win AS "window" FROM b WHERE inside UNION ALL SELECT doc_id, span, win FROM n WHERE NOT any_in"""
)
def nearest_window(spark, d):
    """JON8: windows that hold a span, else the nearest."""
    s = T(spark, d, "events").select(F.col("event_id").alias("span"), F.col("user_id").alias("doc_id"), F.rint("value").cast("int").alias("s"), (F.rint("value").cast("int") + 5).alias("e"))
    c = T(spark, d, "customer")
    w = c.select(F.col("c_custkey").alias("window"), (F.col("c_custkey") % 150).alias("doc_id"), (F.col("c_custkey") * 7 % 400).alias("w0"), (F.col("c_custkey") * 7 % 400 + 20).alias("w1"))
    return linking.nearest_window(s, w)


@query("SELECT c_mktsegment AS cv_id, " + ", ".join(f"max(c_acctbal) FILTER (c_nationkey = {k}) AS \"{k}\"" for k in range(4)) + " FROM (SELECT c_mktsegment, c_nationkey, round(max(c_acctbal), 6) AS c_acctbal FROM customer GROUP BY 1, 2) GROUP BY 1")
def matrix_pivot(spark, d):
    """SNK9: long judgments to a wide matrix."""
    c = T(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("cv_id"), F.col("c_nationkey").cast("string").alias("jd_id")).agg(F.round(F.max("c_acctbal"), 6).alias("fit"))
    return taxonomy.wide_matrix(c, [str(k) for k in range(4)])


# ---- windows and state -----------------------------------------------------

_LIMITS = {"GET": (2, "1 hour"), "POST": (1, "1 hour")}


@query(
    """
WITH q AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS method, date_trunc('hour', ts) AS w FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id % 20, method, w ORDER BY ts, event_id) AS n FROM q)
SELECT event_id, method, CAST(n AS INT) AS n, n > CASE method WHEN 'GET' THEN 2 ELSE 1 END AS rejected FROM r"""
)
def rate_limiter(spark, d):
    """STR1: requests over the limit of their client's window."""
    e = T(spark, d, "events")
    q = e.select("event_id", F.col("ts"), (F.col("user_id") % 20).alias("client"), F.when(F.col("event_type").isin("view", "click"), "GET").otherwise("POST").alias("method"), F.col("event_id").alias("ord"))
    return limits.limited(q, _LIMITS).select("event_id", "method", "n", "rejected")


@query(
    """
WITH c AS (SELECT user_id AS id, event_id AS ord, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'READY' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END AS state FROM events),
l AS (SELECT *, lag(state) OVER (PARTITION BY id ORDER BY ord) AS before FROM c)
SELECT coalesce(before, 'NONE') AS before, state, count(*) AS n, bool_and(coalesce((before IS NULL AND state = 'PENDING') OR (before = 'PENDING' AND state = 'PROCESSING') OR (before = 'PROCESSING' AND state IN ('READY', 'FAILED')), FALSE)) AS allowed FROM l GROUP BY 1, 2"""
)
def lifecycle_transitions(spark, d):
    """STR2, STR3, STR4: state changes and whether they may follow one another."""
    state = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "PROCESSING").when(F.col("event_type") == "purchase", "READY").when(F.col("event_type") == "error", "FAILED").otherwise("PROCESSING")
    t = limits.transitions(T(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), state.alias("state")))
    return t.groupBy(F.coalesce("before", F.lit("NONE")).alias("before"), "state").agg(F.count("*").alias("n"), F.bool_and("allowed").alias("allowed"))


from . import reports, search, store, texts, views  # noqa: E402,F401  further queries, registered on import
