"""Suffix-array dedup with a run-length index.

A byte goes if a string of ``length`` bytes around it also starts anywhere else, in
any document or in its own.  Content deals the windows (strings of ``length`` bytes)
into groups: the least of the ``gram``-byte hashes in a window is its anchor, so equal
windows have equal anchors at equal offsets.  The windows of one anchor are
consecutive, and the text they cover is its context; every window of the corpus lies
in exactly one context.  Contexts that are equal as wholes are counted, not compared.

Where an anchor has several contexts, these are indexed: their suffixes are sorted,
the Burrows-Wheeler transform is kept as runs, and only the suffixes at the two ends
of each run are sampled.  The common prefix of two neighbours is computed at run
borders alone.  Everywhere else the matching statistics stream through the text, one
less at each byte, since inside a run the neighbours move on together.  The more the
contexts repeat each other, the fewer runs there are.  A byte position whose
statistic reaches ``length`` starts a repeated window.

An anchor with more than ``GROUP`` different contexts (a line on very many pages)
is divided by the windows' offsets from it: each part is keyed by all bytes that its
windows share, and its contexts are cut to its windows, so that they become equal
where the surroundings no longer matter.  A part of one offset has one context only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .rows import few, keyed, same_row, written

LENGTH = 200
GRAM = 32
#: More different contexts of one anchor are divided.
GROUP = 1024
#: Ways of dividing the offsets of an anchor.
_WAYS = 8
#: Bytes of context that are indexed together, and bytes of text that are hashed together.
_INDEX = 1 << 18
_SLICE = 1 << 18
_TABLE = W.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PACK = 7


class RunIndex:
    """The run-length BWT of some contexts, with suffixes sampled at both ends of every run.

    ``heads`` and ``tails`` are text positions: of the first suffix of each run, and of
    the suffix before it in order (the last of the run before); ``common`` is the length
    of what the two share.  Suffixes end with their context.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray):
        """``data`` holds the contexts one after another, ``at`` their m + 1 bounds."""
        m = len(at) - 1
        size = np.diff(at)
        n = int(at[-1]) + m  # one terminator after each context
        self.first = at[:-1] + np.arange(m)
        self.context = np.repeat(np.arange(m), size + 1)
        self.rest = (self.first + size)[self.context] - np.arange(n)
        text = np.zeros(n + 8, np.uint8)
        text[np.flatnonzero(self.rest)] = data
        self.text = text
        order = self._sorted(n)
        before = text[order - 1].astype(np.int16)
        before[(order == 0) | (self.rest[order - 1] == 0)] = -1  # terminators differ from each other
        border = np.ones(n, bool)
        border[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        self.runs = np.flatnonzero(border)
        self.symbols = before[self.runs]
        self.heads, self.tails = order[self.runs[1:]], order[self.runs[1:] - 1]
        self.top, self.bottom = order[0], order[-1]
        self.common = self._shared(self.heads, self.tails)

    def _sorted(self, n: int) -> np.ndarray:
        """The suffix array, by prefixes of threefold length; terminators are least and ordered by context."""
        symbol = np.where(self.rest > 0, self.text[:n].astype(np.int64) + 1, 0)
        key = np.zeros(n, np.int64)
        for k in range(_PACK):
            shifted = np.zeros(n, np.int64)
            shifted[: n - k] = symbol[k:]
            key = key << 9 | np.where(self.rest >= k, shifted, 0)
        rank = _ranks(key)[1]
        order, rank, several = _ranks(rank * (len(self.first) + 1) + np.where(self.rest < _PACK, self.context + 1, 0))
        h = _PACK
        ways = 3 if n < 1 << 21 else 2  # as many ranks as a key of 63 bits holds
        while several < n:
            key = rank.copy()
            for k in range(1, ways):
                key *= n + 1
                if k * h < n:
                    key[: n - k * h] += rank[k * h :] + 1
            order, rank, several = _ranks(key)
            h *= ways
        return order

    def _shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at i and j have in common."""
        most = np.minimum(self.rest[i], self.rest[j])
        out, live = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
        words = np.lib.stride_tricks.sliding_window_view(self.text, 8)
        while len(live):
            done = out[live]
            differ = words[i[live] + done] != words[j[live] + done]
            run = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
            out[live] = done + run
            live = live[(run == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def statistics(self) -> np.ndarray:
        """For each text position the longest string from it that also starts elsewhere in the index."""
        n = len(self.rest)
        place = np.arange(n)
        out = np.zeros(n, np.int64)
        for sample, end in ((self.heads, self.top), (self.tails, self.bottom)):
            value, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
            value[sample], last[sample] = self.common, sample
            last[end] = end  # the outermost suffix has no neighbour
            last = np.maximum.accumulate(last)
            np.maximum(out, value[last] - (place - last), out=out)
        return np.minimum(out, self.rest)


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of the keys, each key's rank (the place of the last equal key), and how many differ."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.append(ordered[1:] != ordered[:-1], True)
    ends = np.flatnonzero(new)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.repeat(ends, np.diff(np.append(-1, ends)))
    return order, rank, len(ends)


def _texts(batch: pa.RecordBatch):
    """(row, bytes) of each text of a batch; null texts are empty."""
    data, at = W.text_buffers(batch.column("text"))
    for k in range(len(at) - 1):
        yield k, data[at[k] : at[k + 1]]


class _Hashes:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        self.grams = W.Grams(_TABLE.take(data))

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | None = None) -> np.ndarray:
        h = self.grams.of(start, end)
        return W.signed(h if salt is None else W.mix(h ^ salt))


def _salt(pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where a context begins and ends around its anchor."""
    return W.mix((pos - lo).astype(np.uint64) << np.uint64(32) | (pos - hi + (1 << 20)).astype(np.uint64))


def _chosen(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Of texts one after another: (text, anchor, first and last window start, hash of the anchor, hash of the context)."""
    reach = length - gram
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    hashes = _Hashes(data)
    total, ipw = hashes.grams.total, hashes.grams.ipw
    every = W.mix((total[gram:] - total[:-gram]) * ipw[: len(data) - gram + 1])
    mask = np.uint64((1 << 24) - 1)
    least = W.sliding_min((every & ~mask) | (mask - np.arange(len(every), dtype=np.uint64)), reach + 1)
    anchor = (mask - (least & mask)).astype(np.int64)  # of each window
    whole = np.zeros(len(anchor) + 1, np.int64)
    some = np.flatnonzero(np.diff(at) >= length)
    whole[at[some]] = 1
    np.add.at(whole, at[some + 1] - length + 1, -1)
    inside = np.cumsum(whole[:-1]) > 0  # windows that lie in one text
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]))
    new[at[some]] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(anchor)) - 1
    begin, end = begin[inside[begin]], end[inside[begin]]
    pos = anchor[begin]
    text = np.searchsorted(at, begin, "right") - 1
    return text, pos, begin, end, W.signed(every[pos]), hashes.of(begin, end + length, _salt(pos, begin, end))


def anchors(data: np.ndarray, length: int, gram: int):
    """Of one text: (anchor, first and last window start, hash of the anchor, hash of the context),
    slice by slice.  A slice owns the anchors in it, and sees all windows around them."""
    reach = length - gram
    for a in range(0, len(data) - gram + 1 if len(data) >= length else 0, _SLICE):
        lo, hi = max(a - reach, 0), min(a + _SLICE + length, len(data))
        _, pos, begin, end, key, u = _chosen(data[lo:hi], np.array([0, hi - lo]), length, gram)
        mine = (pos + lo >= a) & (pos + lo < a + _SLICE)
        yield pos[mine] + lo, begin[mine] + lo, end[mine] + lo, key[mine], u[mine]


_ROW = "doc_id long, th long, pos long, lo long, hi long, key long, u long, n long"
_NAMES = ["doc_id", "th", "pos", "lo", "hi", "key", "u", "n"]


def _rows(batch: pa.RecordBatch, who: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    at = pa.array(who)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), *(pa.array(c) for c in columns)], _NAMES)


def _contexts(length: int, gram: int):
    """All contexts of texts, in runs of short texts or slices of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_buffers(batch.column("text"))
            for i, j in W.groups(at, _SLICE):
                part = data[at[i] : at[j]]
                if len(part) > _SLICE:  # one long text
                    for pos, lo, hi, key, u in anchors(part, length, gram):
                        yield _rows(batch, np.full(len(pos), i), pos, lo, hi, key, u, np.ones(len(pos), np.int64))
                else:
                    text, pos, lo, hi, key, u = _chosen(part, at[i : j + 1] - at[i], length, gram)
                    base = at[i : j + 1][text] - at[i]
                    yield _rows(batch, text + i, pos - base, lo - base, hi - base, key, u, np.ones(len(pos), np.int64))

    return run


def _asked(batch: pa.RecordBatch):
    """(bytes of all texts, text, start of the text, pos, lo, hi, key, n) for the contexts that ``ask`` names, in order of their places."""
    data, at = W.text_buffers(batch.column("text"))
    lists = batch.column("ask")
    text = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    flat = lists.flatten()
    pos, lo, hi, key, n = (flat.field(c).to_numpy() for c in ("pos", "lo", "hi", "key", "n"))
    order = np.argsort(at[text] + lo)
    return data, text[order], at[text[order]], pos[order], lo[order], hi[order], key[order], n[order]


def _divided(length: int, gram: int, level: int):
    """The contexts in ``ask``, cut to parts of their windows' offsets from the anchor."""
    width = length - gram + 1
    for _ in range(level):
        width = -(-width // _WAYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, text, base, *fields = _asked(batch)
            for some in np.split(np.arange(len(text)), np.searchsorted(base + fields[1], np.arange(_SLICE, len(data) + _SLICE, _SLICE))):
                if not len(some):
                    continue
                shift, (pos, lo, hi, _, n) = base[some], (f[some] for f in fields)
                pos, lo, hi = pos + shift, lo + shift, hi + shift  # places among all texts
                first = int(lo.min())
                hashes = _Hashes(data[first : int(hi.max()) + length])
                step = (pos - hi) // width
                count = (pos - lo) // width - step + 1
                each = np.repeat(np.arange(len(pos)), count)
                near = (step[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)) * width  # the part's least offset
                p, far = pos[each], near + width - 1
                start, last = np.maximum(p - far, lo[each]), np.minimum(p - near, hi[each])
                # all windows of the part share these bytes
                key = hashes.of(p - near - first, p - far + length - first, W.mix(near.astype(np.uint64) + np.uint64(level << 40)))
                u = hashes.of(start - first, last + length - first, _salt(p, start, last))
                back = shift[each]
                yield _rows(batch, text[some][each], p - back, start - back, last - back, key, u, n[each])

    return run


def _fetched(length: int):
    """The bytes of the contexts in ``ask``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, text, base, _, lo, hi, key, n = _asked(batch)
            size = hi - lo + length
            at = np.append(0, np.cumsum(size))
            for i, j in W.groups(at, _INDEX):
                source = np.repeat((base + lo)[i:j] - at[i:j], size[i:j]) + np.arange(at[i], at[j])
                context = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at[i : j + 1] - at[i]).astype(np.int32)), pa.py_buffer(data[source].tobytes())])
                who = pa.array(text[i:j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(who), batch.column("th").take(who), pa.array(lo[i:j]), pa.array(key[i:j]), pa.array(n[i:j]), context], ["doc_id", "th", "lo", "key", "n", "context"]
                )

    return run


def repeats(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context the offsets at which a string of ``length`` bytes starts that also starts elsewhere in them."""
    at = np.append(0, np.cumsum([len(c) for c in contexts])).astype(np.int64)
    index = RunIndex(np.frombuffer(b"".join(contexts), np.uint8), at)
    long = np.flatnonzero(index.statistics() >= length)
    who = index.context[long]
    return np.split(long - index.first[who], np.searchsorted(who, np.arange(1, len(contexts))))


def _indexed(length: int):
    """Contexts in order of their keys to the repeated stretches of those that stand once."""

    def marks(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        for (doc_id, th, lo, _, n, _), found in zip(rows, repeats([r[5] for r in rows], length)):
            if n == 1 and len(found):
                edge = np.flatnonzero(np.diff(found) > 1)
                first, last = found[np.append(0, edge + 1)], found[np.append(edge, len(found) - 1)]
                out += [(doc_id, th, lo + int(a), lo + int(b) + length) for a, b in zip(first, last)]
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "th", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size > _INDEX and r[3] != rows[-1][3]:
                    yield marks(rows)
                    W.trim()
                    rows, size = [], 0
                rows.append(r)
                size += len(r[5])
        if rows:
            yield marks(rows)
        W.trim()

    return run


def _with_ask(docs: DataFrame, uniq: DataFrame) -> DataFrame:
    """Documents with the list of contexts wanted of them; only such documents are moved."""
    places = uniq.select("rep.doc_id", "rep.th", F.struct("rep.pos", "rep.lo", "rep.hi", "key", "n").alias("one"))
    ask = written(places.groupBy("doc_id", "th").agg(F.collect_list("one").alias("ask")))
    texts = docs
    if (keys := few(ask.select("doc_id", "th"))) is not None:
        texts = docs.join(keys, same_row(docs, keys), "left_semi")
    return texts.join(ask, same_row(texts, ask)).select(texts["doc_id"], texts["th"], "text", "ask")


def _once(docs: DataFrame) -> DataFrame:
    """Keyed documents without repeated rows, whose contexts would be read twice; other rows are not moved."""
    again = written(docs.groupBy("doc_id", "th").count().filter("count > 1").select("doc_id", "th"))
    if again.isEmpty():
        return docs
    keys = few(again) or again
    return docs.join(keys, same_row(docs, keys), "left_anti").union(docs.join(keys, same_row(docs, keys), "left_semi").dropDuplicates(["doc_id", "th"]))


def _spans(docs: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """(doc_id, th, s, e): stretches of bytes that repeated windows cover; they may overlap."""
    rows, found, level = written(docs.mapInArrow(_contexts(length, gram), _ROW)), [], 0
    docs = _once(docs)
    while True:
        live = written(rows.groupBy("key").agg(F.sum("n").alias("total"), (F.min("u") < F.max("u")).alias("mixed")).filter("total > 1").drop("total"))
        met = written(rows.join(live, "key"))
        stretch = ["doc_id", "th", F.col("lo").alias("s"), (F.col("hi") + length).alias("e")]
        found.append(met.filter("not mixed and n = 1").select(*stretch))
        mixed = met.filter("mixed")
        place = F.struct("doc_id", "th", "pos", "lo", "hi")
        uniq = written(mixed.groupBy("key", "u").agg(F.sum("n").alias("n"), F.min(place).alias("rep")))
        again = uniq.filter("n > 1").select("key", "u")
        found.append(mixed.filter("n = 1").join(few(again) or again, ["key", "u"]).select(*stretch))
        sizes = written(uniq.groupBy("key").agg(F.count("*").alias("several"), F.min("n").alias("least")).filter("least = 1").drop("least"))
        small = uniq.join(sizes.filter(F.col("several") <= group), "key")
        texts = _with_ask(docs, small).mapInArrow(_fetched(length), "doc_id long, th long, lo long, key long, n long, context binary")
        dealt = texts.repartition("key").sortWithinPartitions("key")
        found.append(written(dealt.mapInArrow(_indexed(length), "doc_id long, th long, s long, e long")))
        large = sizes.filter(F.col("several") > group)
        if large.isEmpty():
            return reduce(DataFrame.union, found)
        level += 1
        rows = written(_with_ask(docs, uniq.join(few(large) or large, "key")).mapInArrow(_divided(length, gram, level), _ROW))


def _merged(spans: pa.Array) -> list[tuple[int, int]]:
    """Maximal runs of bytes that spans cover."""
    if not len(spans):
        return []
    s, e = spans.field("s").to_numpy(), spans.field("e").to_numpy()
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.append(True, s[1:] > e[:-1])
    return list(zip(s[new].tolist(), e[np.append(new[1:], True)].tolist()))


def _cut(texts: bool):
    """(doc_id, th, text, spans) to what is left after the spans of bytes are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            sizes, gone, runs, last = [], [], [], []
            for k, data in _texts(batch):
                cut = _merged(lists[k].values) if lists[k].is_valid else []
                sizes.append(len(data))
                gone.append(sum(e - s for s, e in cut))
                runs.append(cut)
                kept = [data[a:b] for a, b in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(data)])]
                if texts:
                    last.append(b"".join(p.tobytes() for p in kept))
                else:
                    digest = hashlib.sha256()
                    for p in kept:
                        digest.update(p)
                    last.append(digest.hexdigest())
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(list(map(len, runs)), pa.int64()), pa.array(last, pa.binary() if texts else pa.string())]
            names = ["doc_id", "th", "n_bytes", "n_removed", "n_spans", "kept" if texts else "kept_sha256"]
            if texts:
                columns.append(pa.array([[{"s": s, "e": e} for s, e in x] for x in runs], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))))
                names.append("removed")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = True, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, n_bytes, n_removed, n_spans, and what is left: ``kept``
    (bytes, as a cut may fall inside a character) with ``removed`` (spans of bytes) or,
    without ``texts``, kept_sha256.

    All places of a repeated string go, the first one too, and places in one document
    may overlap.  Null and empty texts have no bytes; texts under ``length`` bytes lose
    nothing; rows that repeat each other repeat each other's strings and get one row
    each; a null doc_id is an id like others.  Long texts are hashed in slices.
    """
    if not 0 < gram < length:
        raise ValueError("gram must be positive and below length")
    docs = keyed(docs)
    spans = written(_spans(docs, length, gram, group).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    parts = [docs]
    if (keys := few(spans.select("doc_id", "th"))) is not None:  # only texts with spans are shuffled to meet them
        parts = [docs.join(keys, same_row(docs, keys), "left_semi"), docs.join(keys, same_row(docs, keys), "left_anti")]
    joined = [d.join(spans, same_row(d, spans), "left").select(d["doc_id"], d["th"], "text", "spans") for d in parts[:1]]
    joined += [d.select("doc_id", "th", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")) for d in parts[1:]]
    schema = "doc_id long, th long, n_bytes long, n_removed long, n_spans long, " + ("kept binary, removed array<struct<s:long,e:long>>" if texts else "kept_sha256 string")
    return reduce(DataFrame.unionByName, (d.mapInArrow(_cut(texts), schema) for d in joined))
