"""Substring dedup: relative Lempel-Ziv parsing against indexed reference blocks.

Every document is reference for the documents after it.  Content picks the
places to index: of ``window - gram + 1`` consecutive n-grams the least is an
anchor, so every window of ``window`` words holds one, and equal windows hold
the same one.  The block of an anchor is the text that any window around it
can reach.  The index maps each block to its first place (doc_id, word).

A document is parsed greedily: while the blocks of consecutive anchors are
indexed at one distance in one earlier document, the factor grows; it ends
where the source changes.  Inside a factor every window is a copy.  At the
ends of factors, where an anchor is known but its block is not, the windows
around that anchor are looked up one by one.  Blocks and windows are compared
as two 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .rows import few, keyed, same_row, written

WINDOW = 50
GRAM = 8
_SECOND = 0xA0761D6478BD642F
#: Bits for the words of a block on one side of its anchor.
_SIDE = 12
_POS = f"shiftright(place, {2 * _SIDE})"
_S = f"{_POS} - (shiftright(place, {_SIDE}) & {(1 << _SIDE) - 1})"
_E = f"{_POS} + (place & {(1 << _SIDE) - 1})"


def _each_group(batch: pa.RecordBatch):
    """(i, j, bytes, starts, ends, first word of each text, word hashes) for runs of documents."""
    data, at = W.text_buffers(batch.column("text"))
    for i, j in W.groups(at):
        d, a = data[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, ends, first = W.word_bounds(d, a, W.SPACE)
        yield i, j, d, starts, ends, first, W.word_hashes(d, starts, ends)


def _anchors(window: int, gram: int):
    """Anchors of texts; ``place`` holds the anchor's word, and how many words before and from it the block covers."""
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, _, first, hashes in _each_group(batch):
                one, two = W.Grams(hashes), W.Grams(hashes, _SECOND)
                here = np.arange(len(hashes))
                every = one.of(here, np.minimum(here + gram, len(hashes)))
                at = W.winnow(every, first, gram, reach + 1)
                doc = W.doc_of(first)[at]
                lo, hi = first[doc], first[doc + 1]
                left, right = np.maximum(at - reach, lo), np.minimum(at + window, hi)
                # what the ends of the document cut off is part of the block
                cut = (at - left).astype(np.uint64) << np.uint64(_SIDE) | (right - at).astype(np.uint64)
                place = (at - lo).astype(np.int64) << 2 * _SIDE | cut.view(np.int64)
                part = batch.slice(i, j - i)
                who = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(who), part.column("th").take(who), *(pa.array(x) for x in (place, W.signed(every[at]), W.signed(one.of(left, right) ^ cut), W.signed(two.of(left, right) ^ cut)))],
                    ["doc_id", "th", "place", "anchor", "block1", "block2"],
                )

    return run


def _windows(window: int, gram: int):
    """Windows around the anchors in ``ask``: one row for each, with its two hashes."""
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("ask")
            for i, j, _, _, _, first, hashes in _each_group(batch):
                one, two = W.Grams(hashes), W.Grams(hashes, _SECOND)
                lists = asked.slice(i, j - i)
                doc = np.repeat(np.arange(j - i), lists.value_lengths().fill_null(0).to_numpy())
                at = lists.flatten().to_numpy().astype(np.int64) + first[doc]
                mark = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(mark, np.maximum(at - reach, first[doc]), 1)
                np.add.at(mark, np.minimum(at, first[doc + 1] - window) + 1, -1)
                start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                who = W.doc_of(first)[start]
                part = batch.slice(i, j - i)
                w = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(w), part.column("th").take(w), pa.array((start - first[who]).astype(np.int32)), pa.array(W.signed(one.of(start, start + window))), pa.array(W.signed(two.of(start, start + window)))],
                    ["doc_id", "th", "pos", "win1", "win2"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, th, text, spans) to what is left after the spans of words are cut."""
    for batch in batches:
        n_words = np.zeros(len(batch), np.int64)
        n_removed = np.zeros(len(batch), np.int64)
        texts: list[str] = []
        spans: list[list[tuple[int, int]]] = []
        lists = batch.column("spans")
        for i, j, d, starts, ends, first, _ in _each_group_bounds(batch):
            part = lists.slice(i, j - i)
            doc = np.repeat(np.arange(j - i), part.value_lengths().fill_null(0).to_numpy())
            flat = part.flatten()
            mark = np.zeros(len(starts) + 1, np.int64)
            np.add.at(mark, flat.field("s").to_numpy() + first[doc], 1)
            np.add.at(mark, flat.field("e").to_numpy() + first[doc], -1)
            gone = np.cumsum(mark[:-1]) > 0
            n_words[i:j] = np.diff(first)
            total = np.append(0, np.cumsum(gone))
            n_removed[i:j] = total[first[1:]] - total[first[:-1]]
            # kept words and one space after each: bytes to keep, by runs
            keep = np.flatnonzero(~gone)
            size = ends[keep] - starts[keep] + 1
            at = np.append(0, np.cumsum(size))
            source = np.repeat(starts[keep] - at[:-1], size) + np.arange(at[-1])
            out = np.append(d, np.uint8(32))[np.minimum(source, len(d))]
            out[at[1:] - 1] = 32
            raw = out.tobytes()
            mine = np.searchsorted(keep, first)
            for k in range(j - i):
                a, b = at[mine[k]], at[mine[k + 1]]
                texts.append(raw[a : max(a, b - 1)].decode())
                lo, hi = first[k], first[k + 1]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone[lo:hi].view(np.int8), [0]))))
                spans.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(n_words), pa.array(n_removed), pa.array(texts, pa.string()), pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
            ["doc_id", "th", "n_words", "n_removed", "kept_text", "removed"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_cut``, but with the digest of what is left in place of the text itself."""
    for batch in _cut(batches):
        digest = [hashlib.sha256(t.as_buffer()).hexdigest() for t in batch.column("kept_text")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digest, pa.string())], ["doc_id", "th", "n_words", "n_removed", "kept_sha256"])


def _each_group_bounds(batch: pa.RecordBatch):
    """As ``_each_group``, without word hashes."""
    data, at = W.text_buffers(batch.column("text"))
    for i, j in W.groups(at):
        d, a = data[at[i] : at[j]], at[i : j + 1] - at[i]
        yield i, j, d, *W.word_bounds(d, a, W.SPACE), None


def parse(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Anchors of keyed documents that more than one document has: doc_id, th, place,
    ``ref`` the first place (doc_id, pos) of its block, ``mixed`` whether the anchor has several blocks.

    Each step is a narrow table, so that joins meet plain scans on both sides and
    Spark can split the rows of an anchor or a block that very many documents hold.
    """
    anchors = docs.filter("doc_id is not null").mapInArrow(_anchors(window, gram), "doc_id long, th long, place long, anchor long, block1 long, block2 long")
    shared = written(
        anchors.groupBy("anchor")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("block1") < F.max("block1")).alias("mixed"))
        .filter("lo < hi")
        .select("anchor", "mixed")
    )
    live = written(anchors.join(shared, "anchor").select("doc_id", "th", "place", "mixed", "block1", "block2"))
    index = written(live.groupBy("block1", "block2").agg(F.min(F.struct("doc_id", F.expr(_POS).alias("pos"))).alias("ref")))
    return written(live.join(index, ["block1", "block2"]).select("doc_id", "th", "place", "mixed", "ref"))


def _factors(parsed: DataFrame) -> DataFrame:
    """(doc_id, th, ref_doc, shift, s, e): greedy factors.  Anchors are taken in text order;
    a factor goes on while the next block continues the copy from the same earlier
    document at the same distance, and ends where the source changes or words lie between."""
    known = parsed.filter("ref.doc_id < doc_id").select("doc_id", "th", F.expr(_POS).alias("pos"), F.expr(_S).alias("s"), F.expr(_E).alias("e"), F.col("ref.doc_id").alias("ref_doc"), F.expr(f"{_POS} - ref.pos").alias("shift"))
    order = Window.partitionBy("doc_id", "th").orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    goes_on = (before("ref_doc") == F.col("ref_doc")) & (before("shift") == F.col("shift")) & (F.col("s") <= before("e"))
    number = F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn("number", number).groupBy("doc_id", "th", "number").agg(F.first("ref_doc").alias("ref_doc"), F.first("shift").alias("shift"), F.min("s").alias("s"), F.max("e").alias("e")).drop("number")


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The parse itself: (doc_id, ref_doc, shift, s, e), words [s, e) copied from
    ``ref_doc``, where they stand ``shift`` words earlier; every factor has ``window`` words at least."""
    return _factors(parse(keyed(docs), window, gram)).drop("th")


def _spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, th, spans): the words of factors, and the windows at their ends that an earlier document holds."""
    parsed = parse(docs, window, gram)
    ask = written(parsed.filter("mixed and ref.doc_id >= doc_id").groupBy("doc_id", "th").agg(F.collect_set(F.expr(_POS)).alias("ask")))
    asked = docs.filter("doc_id is not null")
    if (keys := few(ask.select("doc_id", "th"))) is not None:
        asked = asked.join(keys, ["doc_id", "th"], "left_semi")
    asked = asked.join(ask, ["doc_id", "th"]).select("doc_id", "th", "text", "ask")
    windows = written(asked.mapInArrow(_windows(window, gram), "doc_id long, th long, pos int, win1 long, win2 long"))
    first = written(windows.groupBy("win1", "win2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi"))
    late = windows.join(first, ["win1", "win2"]).filter("lo < doc_id").select("doc_id", "th", F.struct(F.col("pos").cast("long").alias("s"), (F.col("pos") + window).cast("long").alias("e")).alias("span"))
    whole = _factors(parsed).select("doc_id", "th", F.struct("s", "e").alias("span"))
    return written(whole.union(late).groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans")))


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, n_words, n_removed, and kept_text with
    ``removed`` (spans of words) or, without ``texts``, kept_sha256.

    A word goes if a run of ``window`` words around it also stands in a document
    with a smaller doc_id; runs are judged on the input.  Null and empty texts have
    no words; texts under a window lose nothing; a null doc_id is neither smaller
    nor larger than any, so such rows stay whole; repeated rows get one row each.
    """
    docs = keyed(docs)
    spans = _spans(docs, window, gram)
    keys = few(spans.select("doc_id", "th"))
    parts = [docs]
    if keys is not None:  # only texts with spans are shuffled to meet them
        parts = [docs.join(keys, same_row(docs, keys), "left_semi"), docs.join(keys, same_row(docs, keys), "left_anti")]
    joined = [d.join(spans, same_row(d, spans), "left").select(d["doc_id"], d["th"], "text", "spans") for d in parts[:1]]
    joined += [d.select("doc_id", "th", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")) for d in parts[1:]]
    schema = "doc_id long, th long, n_words long, n_removed long, "
    run, schema = (_cut, schema + "kept_text string, removed array<struct<s:long,e:long>>") if texts else (_digest, schema + "kept_sha256 string")
    return reduce(DataFrame.unionByName, (d.mapInArrow(run, schema) for d in joined))
