"""Windows, encoders, vector retrieval, and the linking of lexical matches to concepts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .. import config as C
from ..functions import scores, text


def token_windows(documents: DataFrame, size: int = C.WINDOW_TOKENS, stride: int = C.STRIDE_TOKENS) -> DataFrame:
    """(doc_id, window, first_token, n_tokens, tokens): windows that cover every token; the last may be short."""
    each = documents.select("doc_id", text.tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    count = text.window_count(F.size("t"), size, stride)
    each = each.select("doc_id", "t", F.posexplode(F.sequence(F.lit(0), (count - 1) * stride, F.lit(stride))).alias("window", "first_token"))
    part = F.slice("t", F.col("first_token") + 1, size)
    return each.select("doc_id", "window", "first_token", F.size(part).alias("n_tokens"), part.alias("tokens"))


def hash_vector(value: str, size: int = 64) -> np.ndarray:
    """A deterministic unit vector from blocks of BLAKE2b."""
    blocks = b"".join(hashlib.blake2b(f"{k}:{value}".encode(), digest_size=64).digest() for k in range(-(-size * 4 // 64)))
    v = np.frombuffer(blocks, "<u4")[:size].astype(np.float64) / 2**32 - 0.5
    return (v / np.linalg.norm(v)).astype(np.float32)


def encoded(rows: DataFrame, column: str, encode: Callable[[list[str]], np.ndarray] | None = None, size: int = 64) -> DataFrame:
    """``rows`` with ``vec``, the encoding of a text column; the encoder runs on Arrow batches."""
    run = encode or (lambda texts: np.stack([hash_vector(t, size) for t in texts]))

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(run(s.fillna("").tolist()))) if len(s) else pd.Series([], dtype=object)

    return rows.withColumn("vec", vectors(F.col(column)))


#: Queries and index rows that meet in one task, and into how many parts smaller tables are cut for the cores.
QUERY_BLOCK, INDEX_BLOCK, LEAST_PARTS = 32768, 32768, 8


def _nearest_in_block(k: int):
    """The k nearest of a block of index rows for each query of a block: one matrix product for a slice
    of queries.  The functions are nested, so that executors need not have this package."""

    def best(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, similarity) of the k greatest of each row of ``s`` at 12 digits, ties to the first column.

        Only what reaches a row's k-th greatest within the rounding is rounded and sorted.
        """
        width = s.shape[1]
        least = s.min(1) if k >= width else s.max(1) if k == 1 else np.partition(s, width - k, axis=1)[:, width - k]
        if np.isfinite(least).all():
            row, column = np.divmod(np.flatnonzero(s >= least[:, None] - 2e-12), width)
        else:
            row, column = np.divmod(np.arange(s.size), width)
        value = np.round(s[row, column], 12)
        order = np.lexsort((column, -value, row))
        row, column, value = row[order], column[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return row[place < k], column[place < k], value[place < k]

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        parts = []
        asked = queries.drop_columns(["vec", "block", "part"])
        ids = index.column("id").combine_chunks()
        if queries.num_rows and index.num_rows:
            order = pc.sort_indices(ids)
            ids = ids.take(order)
            vectors = lambda t: t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
            q, x = vectors(queries), vectors(index)[order.to_numpy()]
            for i in range(0, len(q), 64):
                row, column, value = best(q[i : i + 64] @ x.T)
                parts.append(asked.take(pa.array(row + i)).append_column("id", ids.take(pa.array(column))).append_column("similarity", pa.array(value)))
        return pa.concat_tables(parts) if parts else asked.slice(0, 0).append_column("id", ids.slice(0, 0)).append_column("similarity", pa.array([], pa.float64()))

    return run


def top_k(
    queries: DataFrame, index: DataFrame, k: int = C.TOP_K, by: tuple[str, ...] = (), block: int = QUERY_BLOCK, part: int = INDEX_BLOCK, unique: bool = False
) -> DataFrame:
    """(*by, query, id, similarity, rank): the k nearest of ``index`` (*by, id, vec) for each of
    ``queries`` (*by, query, vec), within equal ``by``.

    A join of blocks: queries are hashed into blocks of about ``block`` rows and index
    rows into parts of about ``part``, so every block meets every part in a task of
    bounded size, and a row is copied as often as the other side has blocks.  A task
    keeps k rows for each of its queries; a window, which Spark cuts to k before its
    shuffle too, ranks them.  No vector passes the driver.  Null vectors and null ``by``
    have no neighbours; ties go to the smaller id; repeated queries count as one, which
    costs no shuffle if the caller knows that they are ``unique``.
    """
    keys = list(by)
    known = F.expr(" and ".join(f"{c} is not null" for c in (*keys, "vec")))
    q = queries.filter(known).select(*keys, "query", "vec")
    q = q if unique else q.dropDuplicates([*keys, "query"])
    x = index.filter(known).select(*keys, "id", "vec")
    if keys:  # only groups of more than one block are listed, which are few
        many = lambda rows, most, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias(name)).filter(F.col(name) > 1)
        sizes = F.broadcast(many(q, block, "blocks").join(many(x, part, "parts"), keys, "full_outer"))
        q, x = (t.join(sizes, keys, "left").fillna(1, ["blocks", "parts"]) for t in (q, x))
    else:
        count = lambda n, most: max(-(-n // most), min(LEAST_PARTS, -(-n * 32 // most)), 1)
        blocks, parts = count(q.count(), block), count(x.count(), part)
        q, x = (t.withColumn("blocks", F.lit(blocks).cast("long")).withColumn("parts", F.lit(parts).cast("long")) for t in (q, x))
    all_of = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = [F.col(c).alias(c) for c in (*keys, "query", "vec")]  # other columns than those of the index, if both come from one table
    q = q.select(*own, F.pmod(F.xxhash64("query"), F.col("blocks")).alias("block"), all_of("parts").alias("part"))
    x = x.select(*keys, "id", "vec", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), all_of("blocks").alias("block"))
    schema = StructType([*(f for f in q.schema if f.name in (*keys, "query")), x.schema["id"], StructField("similarity", DoubleType())])
    cell = [*keys, "block", "part"]
    found = q.groupBy(*cell).cogroup(x.groupBy(*cell)).applyInArrow(_nearest_in_block(k), schema)
    w = Window.partitionBy(*keys, "query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def resolved(requirements: DataFrame, concepts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Requirements (text, skill_uri, req_conf, ...) without a concept get the one nearest to their text.

    ``vectors``: text, vec, the encoding of each text; ``concepts``: skill_uri, label, vec.  A
    confidence over 0 stays, else the similarity takes its place.  Equal texts are
    looked up once.  Requirements that have a concept, and those without any neighbour,
    are as they were, with the label of their concept or none.
    """
    asked = requirements.filter("skill_uri is null and text is not null").select("text").distinct()
    near = top_k(asked.join(vectors, "text").select(F.col("text").alias("query"), "vec"), concepts.select(F.col("skill_uri").alias("id"), "vec"), 1, unique=True)
    near = near.select(F.col("query").alias("text"), F.col("id").alias("found"), "similarity")
    rows = requirements.join(near, "text", "left").withColumn("new", F.col("skill_uri").isNull() & F.col("found").isNotNull())
    uri = F.when(F.col("new"), F.col("found")).otherwise(F.col("skill_uri"))
    sure = F.when(F.col("new") & (F.coalesce("req_conf", F.lit(0.0)) <= 0), F.col("similarity")).otherwise(F.col("req_conf"))
    rows = rows.select(*(uri.alias(c) if c == "skill_uri" else sure.alias(c) if c == "req_conf" else F.col(c) for c in requirements.columns), F.col("new").alias("resolved"))
    return rows.join(concepts.select("skill_uri", F.col("label").alias("skill_label")), "skill_uri", "left").select(*requirements.columns, "skill_label", "resolved")


def rescored(lexical: DataFrame, similarity: DataFrame, drop: float = C.DROP, keep: float = C.KEEP) -> DataFrame:
    """Lexical candidates (cv_id, skill_uri, confidence) with their similarity (cv_id, skill_uri,
    similarity) and the band they fall in; candidates of unknown concepts have none and go."""
    both = lexical.join(similarity, ["cv_id", "skill_uri"])
    band = scores.banded(F.col("confidence"), F.col("similarity"), drop, keep)
    return both.withColumn("lexical_confidence", F.col("confidence")).withColumn("band", band).select(
        *[c for c in lexical.columns if c != "confidence"], "similarity", "lexical_confidence", F.col("band.source").alias("source"), F.col("band.confidence").alias("confidence")
    )


def expansions(retrieved: DataFrame, lexical: DataFrame, threshold: float = C.EXPANSION) -> DataFrame:
    """Concepts that windows of a document retrieve and the lexical step did not: best window each.

    ``retrieved``: cv_id, window, skill_uri, similarity.
    """
    best = retrieved.filter(F.col("similarity") >= threshold).groupBy("cv_id", "skill_uri").agg(
        F.max("similarity").alias("similarity"), F.max_by("window", F.struct(F.col("similarity"), -F.col("window"))).alias("window")
    )
    return best.join(lexical.select("cv_id", "skill_uri").distinct(), ["cv_id", "skill_uri"], "left_anti")


def best_candidates(candidates: DataFrame) -> DataFrame:
    """One candidate for each document and concept among those admitted: kept, expanded, or dropped
    with confidence 0.6 at least; by confidence, similarity, source, place and ``ord``."""
    ok = (F.col("source") != "lexical_dropped") | (F.col("confidence") >= C.DROPPED_ADMISSION)
    source = F.when(F.col("source") == "lexical_kept", 0).when(F.col("source") == "semantic_expansion", 1).otherwise(2)
    rest = [c for c in candidates.columns if c not in ("cv_id", "skill_uri")]
    key = F.struct(-F.col("confidence"), -F.col("similarity"), source, F.coalesce("start", F.lit(-1)), F.coalesce("end", F.lit(-1)), F.col("ord"))
    return candidates.filter(ok).groupBy("cv_id", "skill_uri").agg(F.min_by(F.struct(*rest), key).alias("c")).select("cv_id", "skill_uri", "c.*")


def nearest_window(spans: DataFrame, windows: DataFrame, bin_size: int = 256) -> DataFrame:
    """(doc_id, span, window): every window that holds a span, or else the nearest by start.

    ``spans``: doc_id, span, s, e; ``windows``: doc_id, window, w0, w1.  Windows stand in
    the bins of places that they cover, and a span meets those of its own bin; the
    nearest are found in one sorted pass over the starts of both, so a document's
    spans and windows are not multiplied out.
    """
    at = lambda c: F.floor(F.col(c) / bin_size)
    binned = windows.filter("w0 <= w1").select("doc_id", "window", "w0", "w1", F.explode(F.sequence(at("w0"), at("w1"))).alias("bin"))
    met = spans.withColumn("bin", at("s")).join(binned, ["doc_id", "bin"])
    held = met.filter("w0 <= s and w1 >= e").select("doc_id", "span", "window")
    rest = spans.join(held.select("doc_id", "span").distinct(), ["doc_id", "span"], "left_anti")
    starts = windows.groupBy("doc_id", "w0").agg(F.min("window").alias("window"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    kinds = dict(spans.dtypes) | dict(windows.dtypes)
    both = starts.select("doc_id", F.col("w0").cast("long").alias("p"), F.lit(0).alias("o"), none("span", kinds["span"]), F.struct(F.col("w0").cast("long").alias("w0"), "window").alias("w"))
    both = both.unionByName(rest.select("doc_id", F.col("s").cast("long").alias("p"), F.lit(1).alias("o"), "span", none("w", dict(both.dtypes)["w"])))
    seen = lambda *order: F.last("w", True).over(Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before, after = seen("p", "o"), seen(F.desc("p"), "o")
    near = both.select("doc_id", "p", "span", F.array_compact(F.array(before, after)).alias("near")).filter("span is not null and size(near) > 0")
    best = F.array_min(F.transform("near", lambda w: F.struct(F.abs(w["w0"] - F.col("p")).alias("d"), w["window"].alias("window"))))["window"]
    return held.unionByName(near.select("doc_id", "span", best.alias("window")))


def gold_similarity(gold: DataFrame, concepts: DataFrame, windows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(cv_id, uri, encoder, window, similarity): the most similar window of a document to each of its gold
    concepts, for every encoder in one pass.

    ``gold``: cv_id, uri; ``concepts``: encoder, uri, vec; ``windows``: cv_id, encoder, window,
    vec.  Only gold concepts meet windows, by blocks of a document and an encoder.  A
    concept that an encoder lacks has no row for any.  Where documents share their windows,
    ``groups`` (cv_id, group) says which, and ``windows`` has ``group`` for cv_id: a concept
    then meets the windows of a group once, and no window is copied for each document.
    """
    several = concepts.agg(F.count_distinct("encoder")).first()[0]
    whole = concepts.groupBy("uri").agg(F.count_distinct("encoder").alias("n")).filter(F.col("n") == several).select("uri")
    wanted = gold.select("cv_id", "uri").distinct().join(whole, "uri", "left_semi")
    by = "cv_id" if groups is None else "group"
    wanted = wanted if groups is None else wanted.join(groups.select("cv_id", "group").distinct(), "cv_id")
    asked = wanted.select(by, "uri").distinct().join(concepts, "uri")
    near = top_k(asked.select(by, "encoder", F.col("uri").alias("query"), "vec"), windows.select(by, "encoder", F.col("window").alias("id"), "vec"), 1, by=(by, "encoder"), unique=True)
    near = near.select(by, F.col("query").alias("uri"), "encoder", F.col("id").alias("window"), "similarity")
    out = near if groups is None else wanted.join(near, ["group", "uri"])
    return out.select("cv_id", "uri", "encoder", "window", "similarity")
