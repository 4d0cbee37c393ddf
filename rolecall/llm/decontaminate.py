"""Benchmark decontamination by winnowing.

Of every ``width`` consecutive n-gram hashes the least is kept, in documents
and in benchmark items.  Kept fingerprints are joined; each hit names an item
for a document, and the hit is extended word by word to the windows that
really occur.  With n + width - 1 = ``window`` every shared window keeps a
common fingerprint, so none is missed.  Items shorter than a window are one
window each: for their lengths all n-grams are kept (width 1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .rows import keyed, row_condition, same_row

WINDOW = 10
GRAM = 5


def _fingerprints(window: int, gram: int, short: tuple[int, ...], item: bool):
    """Batches of (doc_id, th, text) to (doc_id, th, fp): the kept n-gram hashes of each text, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_buffers(batch.column("text"))
            for i, j in W.groups(at):
                d, a = data[at[i] : at[j]], at[i : j + 1] - at[i]
                starts, ends, first = W.word_bounds(d, a, W.NON_WORD)
                hashes = W.word_hashes(d, starts, ends, W.LOWER)
                grams = W.Grams(hashes)
                doc = W.doc_of(first)
                here = np.arange(len(hashes))
                every = grams.of(here, np.minimum(here + gram, len(hashes)))
                kept = W.winnow(every, first, gram, window - gram + 1)
                found = [(doc[kept], every[kept])]
                sizes = np.diff(first)
                for n in short:
                    at_n = W.gram_starts(first, n)
                    if item:
                        at_n = at_n[sizes[doc[at_n]] == n]
                    # the length is part of the hash: a short item meets runs of its own length only
                    found.append((doc[at_n], grams.of(at_n, at_n + n) ^ np.uint64(n)))
                who = np.concatenate([f[0] for f in found])
                fp = np.concatenate([f[1] for f in found])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(who)), part.column("th").take(pa.array(who)), pa.array(W.signed(fp))],
                    ["doc_id", "th", "fp"],
                )

    return run


def item_lengths(benchmark: DataFrame, window: int) -> tuple[int, ...]:
    """Which lengths under ``window`` words occur; at most window - 1 numbers."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            data, at = W.text_buffers(batch.column("text"))
            sizes = np.diff(W.word_bounds(data, at, W.NON_WORD)[2])
            seen |= set(sizes[(sizes > 0) & (sizes < window)].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], ["n"])

    rows = benchmark.select("text").mapInArrow(run, "n int").distinct().collect()
    return tuple(sorted(r.n for r in rows))


def _extend(window: int):
    """Batches of (doc_id, th, text, items) to one result row each: the windows of the
    candidate items that occur in the text, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_buffers(batch.column("text"))
            items = batch.column("items")
            n_words = np.zeros(len(batch), np.int64)
            n_hit = np.zeros(len(batch), np.int64)
            n_items = np.zeros(len(batch), np.int64)
            names: list[list[int | None]] = [[] for _ in range(len(batch))]
            for i, j in W.groups(at):
                d, a = data[at[i] : at[j]], at[i : j + 1] - at[i]
                starts, ends, first = W.word_bounds(d, a, W.NON_WORD)
                n_words[i:j] = np.diff(first)
                folded = W.mapped(d, W.LOWER)
                for k in range(i, j):
                    if not items[k].is_valid:
                        continue
                    lo, hi = first[k - i], first[k - i + 1]
                    text = [folded[s:e].tobytes() for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
                    where: dict[bytes, list[int]] = {}
                    for p, word in enumerate(text):
                        where.setdefault(word, []).append(p)
                    hit = np.zeros(len(text), bool)
                    for item in items[k].as_py():
                        parts = _words(item["item_text"])
                        found = False
                        m = min(window, len(parts))
                        for q in range(len(parts) - m + 1 if m else 0):
                            want = parts[q : q + m]
                            rarest = min(range(m), key=lambda x: len(where.get(want[x], ())))
                            for p in where.get(want[rarest], ()):
                                p -= rarest
                                if p >= 0 and text[p : p + m] == want:
                                    hit[p : p + m] = True
                                    found = True
                        if found:
                            names[k].append(item["item_id"])
                    n_hit[k] = hit.sum()
                    names[k] = list(dict.fromkeys(names[k]))
                    n_items[k] = len(names[k])
            digest = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(names, pa.list_(pa.int64())), pa.array(digest), pa.array(n_hit > 0)],
                ["doc_id", "th", "n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated"],
            )

    return run


def _words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = W.word_bounds(data, np.array([0, len(data)]), W.NON_WORD)
    folded = W.mapped(data, W.LOWER)
    return [folded[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, n_words, n_hit, n_items, item_ids,
    items_sha256, contaminated.

    Null and empty texts have no words and no hits; a null item is no item; items
    of one text are all reported; repeated rows get one row each; a null doc_id is
    kept.  Documents are scanned twice: for fingerprints, which Spark joins to
    those of the benchmark (broadcast while that side is under Spark's own
    threshold, else a shuffled join), and to extend the hits.
    """
    docs = keyed(docs)
    items = keyed(benchmark, "item_id")
    short = item_lengths(items, window)
    schema = "doc_id long, th long, fp long"
    ours = docs.mapInArrow(_fingerprints(window, gram, short, False), schema)
    theirs = items.mapInArrow(_fingerprints(window, gram, short, True), schema).select(
        F.col("doc_id").alias("item_id"), F.col("th").alias("item_th"), "fp"
    ).distinct()
    texts = items.select(F.col("doc_id").alias("item_id"), F.col("th").alias("item_th"), F.col("text").alias("item_text")).distinct()
    pairs = ours.join(theirs, "fp").select("doc_id", "th", "item_id", "item_th").distinct()
    found = (
        pairs.join(texts, pairs["item_id"].eqNullSafe(texts["item_id"]) & (pairs["item_th"] == texts["item_th"]))
        .select("doc_id", "th", F.struct(texts["item_id"], "item_text").alias("item"))
        .groupBy("doc_id", "th")
        .agg(F.collect_list("item").alias("items"))
    )
    return (
        docs.join(found, same_row(docs, found), "left")
        .select(docs["doc_id"], docs["th"], "text", "items")
        .mapInArrow(_extend(window), "doc_id long, th long, n_words long, n_hit long, n_items long, item_ids array<long>, items_sha256 string, contaminated boolean")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs; columns unchanged."""
    bad = contamination(docs, benchmark, window).filter("contaminated").select("doc_id", "th").distinct()
    return docs.join(bad, row_condition(docs, bad), "left_anti")
