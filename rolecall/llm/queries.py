"""The registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ctw import score_texts
from .decontaminate import contamination
from .licenses import licenses
from .manifest import audited
from .media import features, store
from .neardup import near_duplicates
from .pii import personal_data
from .pieces import encoded
from .quality import fit, scores
from .runindex import deduplicated
from .substrings import repeated_passages
from .warc import fixity
from .whitening import whitened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_decontaminate_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th", "item_ids")


def op10_near_dedup_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("th")


def op9_substring_dedup_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), texts=False).drop("th")


def op11_suffix_dedup_rindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), texts=False).drop("th")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), id_remainder(5) == 0)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def id_remainder(n: int):
    """crc32 of doc_id as text, modulo n; a null id has none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op6_lm_score_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), id_remainder(10) != 0)


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fit(docs, table(spark, sf_dir, "labels"), id_remainder(3) != 1)
    return scores(docs, network).select("doc_id", (F.coalesce(id_remainder(3), F.lit(1)) == 1).alias("held_out"), "score", "predicted")


def op5_media_wav_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))


def op2_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("span_list")


def op4_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica of the pages in which every 89th record has a changed byte,
    every 199th is missing and every 307th stands again as an extra record of a new id."""
    rest = pages.filter(F.col("page_id") % 199 != 7).select(
        "page_id", "url", F.when(F.col("page_id") % 89 == 3, F.concat("html", F.lit(" "))).otherwise(F.col("html")).alias("html")
    )
    return rest.union(pages.filter(F.col("page_id") % 307 == 11).select(F.col("page_id") + 10_000_000, "url", "html"))


def op1_warc_fixity_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity(pages, damaged(pages))


OP1_SQL = """
WITH RECURSIVE raw AS (
  SELECT 'a' AS side, page_id AS rid, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
  UNION ALL
  SELECT 'b', page_id, coalesce(url, ''), CASE WHEN page_id % 89 = 3 THEN html || ' ' ELSE html END FROM pages WHERE page_id % 199 <> 7
  UNION ALL
  SELECT 'b', page_id + 10000000, coalesce(url, ''), html FROM pages WHERE page_id % 307 = 11
), rec AS (
  SELECT side, rid, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha256(html)
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS raw
  FROM raw
), leaf AS (
  SELECT side, rid // 4096 AS archive, rid % 4096 AS place, CAST(strlen(raw) AS BIGINT) AS bytes, sha256(raw) AS hash FROM rec
), l1 AS (
  SELECT side, archive, place // 16 AS place, sum(bytes) AS bytes, sha256(string_agg(place || ':' || hash, ';' ORDER BY place)) AS hash FROM leaf GROUP BY 1, 2, 3
), l2 AS (
  SELECT side, archive, place // 16 AS place, sum(bytes) AS bytes, sha256(string_agg(place || ':' || hash, ';' ORDER BY place)) AS hash FROM l1 GROUP BY 1, 2, 3
), root AS (
  SELECT side, archive, sum(bytes) AS bytes, sha256(string_agg(place || ':' || hash, ';' ORDER BY place)) AS hash FROM l2 GROUP BY 1, 2
), placed AS (
  SELECT *, coalesce(sum(bytes) OVER (PARTITION BY archive ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM leaf WHERE side = 'a'
)
SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a.archive, b.archive) * 4096 + coalesce(a.place, b.place) AS page_id, CAST(a.off AS BIGINT) AS "offset", a.bytes AS length,
  CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'extra' ELSE 'changed' END AS kind, a.hash AS hash_a, b.hash AS hash_b
FROM placed a FULL OUTER JOIN (SELECT * FROM leaf WHERE side = 'b') b ON a.archive = b.archive AND a.place = b.place
WHERE a.hash IS DISTINCT FROM b.hash
UNION ALL
SELECT coalesce(a.archive, b.archive), NULL, 0, CAST(a.bytes AS BIGINT), 'root', a.hash, b.hash
FROM (SELECT * FROM root WHERE side = 'a') a FULL OUTER JOIN (SELECT * FROM root WHERE side = 'b') b ON a.archive = b.archive
"""


OP7_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM item WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, n, p, item_id FROM dw JOIN iw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM doc LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP9_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM doc WHERE len(w) >= 50)),
least_doc AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN least_doc USING (k) WHERE lo < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM doc),
kept AS (SELECT word.doc_id, count(gone.i) AS n_removed, string_agg(x, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (doc_id)
"""


OP10_SQL = r"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p : p + 3], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM doc UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON edge.x = reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = doc_id AS kept FROM (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) LEFT JOIN size USING (doc_id)
"""


OP11_SQL = """
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT rid, p, md5(substr(x, 2 * p + 1, 400)) AS k FROM (SELECT rid, x, unnest(range(0, len(x) // 2 - 199)) AS p FROM doc WHERE len(x) >= 400)),
again AS (SELECT k FROM win GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS q, max(p) OVER (PARTITION BY rid) AS m FROM win JOIN again USING (k)),
gone AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(p, p + 200)) AS i FROM hit) GROUP BY 1),
runs AS (SELECT rid, s, coalesce(lead(b) OVER (PARTITION BY rid ORDER BY s), m) + 200 AS e FROM (SELECT rid, p AS s, q AS b, m FROM hit WHERE q IS NULL OR p > q + 200)),
gap AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS a, s AS b FROM runs UNION ALL SELECT rid, max(e), CAST(NULL AS BIGINT) FROM runs GROUP BY 1),
kept AS (SELECT rid, string_agg(substr(x, 2 * a + 1, CASE WHEN b IS NULL THEN len(x) ELSE 2 * (b - a) END), '' ORDER BY a, b NULLS LAST) AS x, count(b) AS n_spans FROM gap JOIN doc USING (rid) GROUP BY 1)
SELECT doc_id, len(doc.x) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, doc.x))) AS kept_sha256
FROM doc LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""

OP12_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_case, 'abcdefghijklmnopqrstuvwxyz' AS lower_case,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x : CAST(ascii(x) AS BIGINT))),
      lambda c, b : list_reduce(list_prepend(xor(c & 255, b) | (c & 4294967040), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i : xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents
), leaf AS (
  SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, crc % 5 = 0 AS changed,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, upper_case, lower_case), '-')) AS altered
  FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid FROM leaf
), low AS (
  SELECT 0 AS h, sid, place, n, leaf AS digest FROM p
  UNION ALL
  SELECT h + 1, sid, place // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY h, sid, place // 16
), high AS (
  SELECT 0 AS h, CAST(-1 AS BIGINT) AS sid, sid AS place, count(*) OVER () AS n, digest FROM low WHERE n = 1
  UNION ALL
  SELECT h + 1, sid, place // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY h, sid, place // 16
), node AS (SELECT * FROM low UNION ALL SELECT * FROM high
), step AS (
  SELECT a.h, a.sid, a.place, a.h + 1 AS h2, a.sid AS sid2, a.place // 16 AS place2, true AS hashed,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM node a JOIN node b ON a.h = b.h AND a.sid = b.sid AND a.place // 16 = b.place // 16 WHERE a.n > 1 GROUP BY a.h, a.sid, a.place
  UNION ALL
  SELECT h, sid, place, 0, -1, sid, false, '', '' FROM low WHERE n = 1
), walk AS (
  SELECT rid, 0 AS h, sid, place, CASE WHEN changed THEN altered ELSE leaf END AS digest, '' AS proof FROM p
  UNION ALL
  SELECT rid, h2, sid2, place2, CASE WHEN hashed THEN sha256(l || digest || r) ELSE digest END, proof || l || r FROM walk JOIN step USING (h, sid, place)
), root AS (SELECT digest AS root FROM high WHERE n = 1
), ended AS (SELECT walk.rid, walk.digest, proof FROM walk JOIN high ON walk.sid = -1 AND walk.h = high.h WHERE high.n = 1)
SELECT doc_id, leaf, low.digest AS subroot, root, sha256(proof) AS proof_sha256, ended.digest AS folded_root, ended.digest = root AS verified
FROM p JOIN low ON low.sid = p.sid AND low.n = 1 JOIN ended USING (rid) CROSS JOIN root
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op7_decontaminate_winnowing": op7_decontaminate_winnowing,
    "op1_warc_fixity_merkle": op1_warc_fixity_merkle,
    "op2_license_patience": op2_license_patience,
    "op3_pii_disclosure": op3_pii_disclosure,
    "op4_sentencepiece_wfst": op4_sentencepiece_wfst,
    "op5_media_wav_peaks": op5_media_wav_peaks,
    "op6_lm_score_ctw": op6_lm_score_ctw,
    "op8_quality_cnn": op8_quality_cnn,
    "op9_substring_dedup_rlz": op9_substring_dedup_rlz,
    "op10_near_dedup_minhash": op10_near_dedup_minhash,
    "op11_suffix_dedup_rindex": op11_suffix_dedup_rindex,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op1_warc_fixity_merkle": OP1_SQL,
    "op7_decontaminate_winnowing": OP7_SQL,
    "op9_substring_dedup_rlz": OP9_SQL,
    "op10_near_dedup_minhash": OP10_SQL,
    "op11_suffix_dedup_rindex": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
