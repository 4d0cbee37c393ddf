"""Near-duplicate documents: one-permutation hashing with optimal densification.

One hash of every shingle fills ``BINS`` bins with minima; an empty bin borrows
from the first full bin in an order of its own, fixed for all documents.  Bands
of bins name buckets, and each bucket links its members to its least member, so
candidate pairs grow with members and not with their square.  Every candidate
is confirmed on the full shingle sets.

A star can miss a link between two members that are both unlike the centre.
Documents connected by buckets whose members still lie in different components
are therefore compared whole, on full sets, in blocks of bounded size; a block
returns which components it joins and no pairs.  At similarity 0.8 a pair shares no bucket with
probability (1 - 0.8**4)**32, about 4e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .graph import components
from .rows import checkpointed, keyed, row_condition, written

SHINGLE = 5
BINS = 128
BAND_ROWS = 4
#: Documents, and shingles, that half a block of a family holds on average.
BLOCK = 1024
BLOCK_SHINGLES = 400_000
PERCENT = 80


def borrow_order(bins: int) -> np.ndarray:
    """For each bin, the order in which it asks the others when it is empty."""
    k = np.arange(bins, dtype=np.uint64)
    return np.argsort(W.mix(k[:, None] * np.uint64(bins) + k[None, :] + np.uint64(1)), axis=1, kind="stable")


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text; one shingle of all words if there are fewer."""
    data, at = W.text_buffers(column)
    for i, j in W.groups(at):
        d, a = data[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, ends, first = W.word_bounds(d, a, W.SPACE)
        grams = W.Grams(W.word_hashes(d, starts, ends, W.LOWER))
        here = np.arange(first[-1])
        every = grams.of(here, np.minimum(here + n, first[-1]))
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= n:
                yield np.unique(every[lo : hi - n + 1])
            elif hi > lo:
                yield grams.of(np.array([lo]), np.array([hi]))
            else:
                yield every[:0]


def signature(u: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Densified minima of a non-empty sorted set of 64-bit hashes."""
    bins = len(order)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    edges = np.searchsorted(u, np.arange(bins, dtype=np.uint64) << shift)
    at = np.minimum(edges, len(u) - 1)
    full = np.append(edges[1:], len(u)) > edges
    if not full.all():
        empty = np.flatnonzero(~full)
        lender = order[empty, full[order[empty]].argmax(axis=1)]
        at[empty] = at[lender]
    return u[at]


def _sketches(n: int, bins: int, rows: int):
    order = borrow_order(bins)
    base = W.powers(0xC2B2AE3D27D4EB4F, rows)
    band = W.mix(np.arange(1, bins // rows + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, bands = [], [], [], []
            for u in shingle_sets(batch.column("text"), n):
                sizes.append(len(u))
                if not len(u):
                    one.append(0), two.append(0), bands.append(None)
                    continue
                one.append(int(W.mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                two.append(int(W.mix(u ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64)))
                v = W.mix(signature(u, order))
                bands.append(W.signed(W.mix((v.reshape(-1, rows) * base).sum(axis=1, dtype=np.uint64) ^ band)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "th", "n_shingles", "set1", "set2", "bands"],
            )

    return run


def _confirm(n: int, percent: int):
    """Batches of (a, b, text_a, text_b), rows of one ``a`` together, to the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("a").to_numpy()
            new = np.append(True, (ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
            heads = shingle_sets(batch.column("text_a").take(pa.array(np.flatnonzero(new))), n)
            ok = np.zeros(len(ids), bool)
            mine = None
            for k, u in enumerate(shingle_sets(batch.column("text_b"), n)):
                if new[k]:
                    mine = next(heads)
                if len(u) and len(mine):
                    at = np.minimum(np.searchsorted(mine, u), len(mine) - 1)
                    both = int((mine[at] == u).sum())
                    ok[k] = 100 * both >= percent * (len(u) + len(mine) - both)
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose documents reach the threshold on full shingle sets."""
    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(n, percent), "a long, b long").distinct()


def _join_block(n: int, percent: int):
    """One block of a family (rep, component, chunk, text) to the components it joins.
    All intersections come from products of 0/1 matrices over the shingles that occur twice."""

    def run(key, rows):
        one, two = key[1].as_py(), key[2].as_py()
        chunk, component = rows.column("chunk").to_numpy(), rows.column("component").to_numpy()
        sets = list(shingle_sets(rows.column("text"), n))
        size = np.array([len(u) for u in sets])
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(sets)), size)[times[at] > 1]
        column = (np.cumsum(times > 1) - 1)[at[times[at] > 1]]
        left, right = np.flatnonzero(chunk == one), np.flatnonzero(chunk == two)
        place = np.zeros((2, len(sets)), np.int64)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        both = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            i, j = np.searchsorted(column, [c, c + 4096])
            sides = []
            for side, ids, mine in ((0, left, one), (1, right, two)):
                grid = np.zeros((len(ids), 4096), np.float32)
                here = chunk[doc[i:j]] == mine
                grid[place[side, doc[i:j][here]], column[i:j][here] - c] = 1
                sides.append(grid)
            both += sides[0] @ sides[1].T
        total = size[left][:, None] + size[right][None, :]
        linked = (100 * both >= percent * (total - both)) & (component[left][:, None] != component[right][None, :])
        x, y = np.nonzero(linked)
        ends = np.sort(np.column_stack([component[left][x], component[right][y]]), axis=1)
        ends = np.unique(ends, axis=0) if len(ends) else ends.astype(np.int64).reshape(0, 2)
        return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bins: int = BINS, rows: int = BAND_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, n_shingles, component_id, kept.

    Null and empty texts have no shingles and are linked with nothing.  Rows that
    repeat a doc_id count as one document.  A null doc_id takes part as no
    document's least id: its component is the least id of its copies, or itself.
    """
    docs = keyed(docs)
    base = checkpointed(docs.mapInArrow(_sketches(shingle, bins, rows), "doc_id long, th long, n_shingles long, set1 long, set2 long, bands array<long>"))
    full = base.filter("n_shingles > 0 and doc_id is not null")
    # tables of their own, so that Spark can split the rows of a set or a bucket that very many documents have
    reps = written(full.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    on_set = ["set1", "set2", "n_shingles"]
    lead = full.join(reps, on_set).filter("doc_id = rep").select("rep", "n_shingles", "bands")
    members = lead.select("rep", "n_shingles", F.explode("bands").alias("bucket")).distinct()
    buckets = written(members.groupBy("bucket").agg(F.min("rep").alias("head"), F.count("*").alias("n")).filter("n > 1"))
    star = members.join(buckets, "bucket").filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    texts = docs.select("doc_id", "text")
    again = full.join(reps, on_set).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("a", "b")
    links = checkpointed(confirmed(star, texts, shingle, percent).union(again))
    label = components(links)

    placed = members.join(buckets.filter("n > 2"), "bucket").join(label.withColumnRenamed("id", "rep"), "rep", "left").select(
        "bucket", "head", "rep", "n_shingles", F.coalesce("component", "rep").alias("component")
    )
    open_buckets = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    rest = checkpointed(placed.join(open_buckets, "bucket").select("head", "rep", "n_shingles", "component").distinct())
    # documents that open buckets connect form a family, so that each text travels once for all its buckets
    family = components(rest.select("head", "rep"), "head", "rep").select(F.col("id").alias("rep"), F.col("component").alias("family"))
    kin = rest.select("rep", "n_shingles", "component").distinct().join(family, "rep")
    size = kin.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    chunks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    more = (
        kin.join(size, "family")
        .select("family", "rep", "component", F.pmod(F.xxhash64("rep"), chunks).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("family", "rep", "component", "chunk", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"))
        .join(texts.withColumnRenamed("doc_id", "rep"), "rep")
        .groupBy("family", "one", "two")
        .applyInArrow(_join_block(shingle, percent), "a long, b long")
        .distinct()
    )
    more = checkpointed(more)
    if not more.isEmpty():
        label = components(links.union(more))

    out = (
        base.join(reps, on_set, "left")
        .join(label.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )
    return out.withColumn("kept", F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group; columns unchanged."""
    gone = near_duplicates(docs, shingle, percent).filter("not kept").select("doc_id", "th").distinct()
    return docs.join(gone, row_condition(docs, gone), "left_anti")
