"""Language-model scoring by context-tree weighting over bytes.

A text is a sequence of bytes (A-Z folded) with an end byte 0xFF; a byte is
eight binary decisions, and each decision has a Krichevsky-Trofimov estimate in
every context of 0 to ``DEPTH`` preceding bytes.  Context-tree weighting mixes
the estimates of all depths by how well each coded the training texts.

Counts of (context, byte) come from every training text.  A context is a node
of the tree if it was met ``LEAST`` times, whatever the size of the corpus, so
the tree grows with it; the rarer contexts of a node form one leaf together.

A decision is mixed along its own contexts only.  Codes are dealt out by the last
``TOP + 1`` bytes of their context; each such subtree is a whole in one task and
goes up as one sum for each decision of the ``TOP`` bytes before the byte.  The
top, which the alphabet bounds, is weighted on the driver and goes back, and the
second pass down the subtrees gives the log probability of every (context, byte)
that any text holds.  Texts meet these, and the word counts of the baseline, by
join; a head of bounded size, the most frequent ones, is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .rows import checkpointed, shipped

DEPTH = 5
LEAST = 2
TOP = 2
HEAD = 1 << 20
END = 0xFF
_END_WORD = 0x1F83D9ABFB41BD6B
_MERGE = 1 << 19
#: Rows of subtrees that are weighted at once.
_CHUNK = 1 << 16
_SLICE = 1 << 16
#: Bytes of text whose contexts a task holds at once.
_RUN = 1 << 18


class Table:
    """Hash lookup of 64-bit keys for numpy; levels of tables without probing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        at = np.arange(len(keys), dtype=np.int32)
        self.levels = []
        seed = 0x9E3779B97F4A7C15
        while len(at):
            bits = max(8, int(len(at) * 2).bit_length())
            slot = self._slot(self.keys[at], seed, bits)
            row = np.full(1 << bits, -1, np.int32)
            row[slot] = at
            self.levels.append((seed, bits, row))
            at = at[row[slot] != at]
            seed = (seed * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    def __reduce__(self):
        return Table, (self.keys,)  # the levels are built where they are used

    @staticmethod
    def _slot(x: np.ndarray, seed: int, bits: int) -> np.ndarray:
        return ((x * np.uint64(seed)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The position of each x among the keys, or -1."""
        out = np.full(len(x), -1, np.int64)
        todo = np.arange(len(x))
        for seed, bits, row in self.levels:
            at = row[self._slot(x[todo], seed, bits)]
            # an empty slot ends the search: an absent key met no other key here
            full = at >= 0
            todo, at = todo[full], at[full]
            hit = self.keys[at] == x[todo]
            out[todo[hit]] = at[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def byte_codes(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and its end: the ``depth`` bytes before it and
    itself as one number; and the texts' offsets into these.  Zeros stand before a text."""
    n = len(at) - 1
    size = np.diff(at)
    doc = np.repeat(np.arange(n), size)
    gap = depth + 1
    stream = np.zeros(len(data) + n * gap, np.uint8)
    stream[np.arange(len(data)) + doc * gap + depth] = data
    ends = at[1:] + np.arange(n) * gap + depth
    stream[ends] = END
    code = np.zeros(len(stream), np.uint64)
    for k in range(depth, -1, -1):
        code <<= np.uint64(8)
        code[k:] |= stream[: len(stream) - k]
    inside = np.ones(len(stream), bool)
    pad = (at[:-1] + np.arange(n) * gap)[:, None] + np.arange(depth)
    inside[pad.ravel()] = False
    return code[inside], at + np.arange(n + 1)


def code_runs(data: np.ndarray, at: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, code) of every byte of a run of texts; a text of over ``_RUN`` bytes comes in
    slices that overlap by the bytes of a context."""
    n = len(at) - 1
    if n != 1 or len(data) <= _RUN:
        code, first = byte_codes(data, at, depth)
        yield np.repeat(np.arange(n), np.diff(first)), code
        return
    for lo in range(0, len(data) + 1, _RUN):
        hi = min(lo + _RUN, len(data) + 1)
        before = np.zeros(depth - min(lo, depth), np.uint8)
        part = np.concatenate([before, data[max(0, lo - depth) : hi], np.full(int(hi > len(data)), END, np.uint8)])
        code = np.zeros(hi - lo, np.uint64)
        for k in range(depth + 1):
            code = code << np.uint64(8) | part[k : k + hi - lo].astype(np.uint64)
        yield np.zeros(hi - lo, np.int64), code


def _counts(depth: int):
    """Batches of (text, held_out) to (kind, key, n): counts of words (0) and of byte codes (1), merged within
    the task.  Codes of held-out texts are listed with the count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}

        def add(kind, keys, times=1):
            if not len(keys):
                return
            u, n = np.unique(keys, return_counts=True)
            held[kind].append((u, n * times))
            if sum(len(p[0]) for p in held[kind]) > _MERGE:
                held[kind] = [_merged(held[kind])]
                if len(held[kind][0][0]) > _MERGE // 2:
                    yield from give(kind)

        def give(kind):
            if held[kind]:
                keys, n = _merged(held[kind])
                held[kind] = []
                for i in range(0, len(keys), _SLICE):
                    k, m = keys[i : i + _SLICE], n[i : i + _SLICE]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(W.signed(k)), pa.array(m.astype(np.int64))], ["kind", "key", "n"])
                del keys, n
                W.trim()

        for batch in batches:
            data, at = W.text_buffers(batch.column("text"))
            learn = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for i, j in W.groups(at, _RUN):
                d, a, mine = W.mapped(data[at[i] : at[j]], W.LOWER), at[i : j + 1] - at[i], learn[i:j]
                if mine.any():
                    starts, ends, first = W.word_bounds(d, a, W.SPACE)
                    hashes = W.word_hashes(d, starts, ends)[mine[W.doc_of(first)]]
                    yield from add(0, np.append(hashes, np.full(mine.sum(), _END_WORD, np.uint64)))
                for doc, code in code_runs(d, a, depth):
                    yield from add(1, code[mine[doc]])
                    yield from add(1, code[~mine[doc]], 0)
        yield from give(0)
        yield from give(1)

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5 (Stirling after a shift by 8)."""
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def _nodes(counts: np.ndarray) -> np.ndarray:
    """Byte counts [n, 256] to counts of the 512 places of the binary tree: 1 the root, 256 + b the byte b."""
    heap = np.zeros((len(counts), 512))
    heap[:, 256:] = counts
    for k in (128, 64, 32, 16, 8, 4, 2, 1):
        heap[:, k : 2 * k] = heap[:, 2 * k : 4 * k : 2] + heap[:, 2 * k + 1 : 4 * k : 2]
    return heap


def _kt(heap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each decision (nodes 0 to 255, 0 unused): ln of the KT block probability, and the estimate of a one."""
    zero, one = heap[:, 0::2].copy(), heap[:, 1::2].copy()
    zero[:, 0] = one[:, 0] = 0
    block = log_gamma(zero + 0.5) + log_gamma(one + 0.5) - np.log(np.pi) - log_gamma(zero + one + 1)
    return block, (one + 0.5) / (zero + one + 1)


def _byte_logs(p: np.ndarray) -> np.ndarray:
    """Estimates of a one in each decision to log10 probabilities of the 256 bytes."""
    byte = np.arange(256)
    out = np.zeros((len(p), 256), np.float32)
    one, zero = np.log10(p), np.log10(1 - p)
    for level in range(8):
        node = (256 + byte) >> (8 - level)
        bit = (byte >> (7 - level)) & 1
        out += np.where(bit, one[:, node], zero[:, node]).astype(np.float32)
    return out


class Tree:
    """The trained tree as leaves: which row of ``logs`` codes the byte after a context."""

    def __init__(self, depth: int, contexts: list[np.ndarray], counts: list[np.ndarray]):
        """contexts[d]: sorted codes of the kept contexts of d bytes; counts[d]: their byte counts [n, 256]."""
        self.depth = depth
        parent = [None, *(np.searchsorted(contexts[d - 1], contexts[d] & ((1 << 8 * (d - 1)) - 1)) for d in range(1, depth + 1))]
        heap = [_nodes(c) for c in counts]
        rest: list[np.ndarray | None] = [None] * (depth + 1)
        weight: list[np.ndarray | None] = [None] * (depth + 1)
        below = None
        for d in range(depth, -1, -1):
            block, _ = _kt(heap[d])
            if d < depth:
                rest[d] = heap[d].copy()
                np.subtract.at(rest[d], parent[d + 1], heap[d + 1])
                split = _kt(rest[d])[0]
                np.add.at(split, parent[d + 1], below)
                both = np.logaddexp(block, split) - np.log(2)
                weight[d] = np.exp(block - np.log(2) - both)
                below = both
            else:
                below = block
        logs, self.row, first = [], [], 0
        fixed = left = None
        for d in range(depth + 1):
            _, p = _kt(heap[d])
            up = (0.0, 1.0) if d == 0 else (fixed[parent[d]], left[parent[d]])
            if d < depth:
                fixed = up[0] + up[1] * weight[d] * p
                left = up[1] * (1 - weight[d])
                p = fixed + left * _kt(rest[d])[1]
            else:
                p = up[0] + up[1] * p
            logs.append(_byte_logs(np.clip(p, 1e-15, 1 - 1e-15)))
            self.row.append(first)
            first += len(p)
        self.logs = np.concatenate(logs).ravel()
        self.find = [None, *(Table(contexts[d]) for d in range(1, depth + 1))]

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each code, by the deepest context kept."""
        row = np.zeros(len(code), np.int64)
        todo = np.arange(len(code))
        context = code >> np.uint64(8)
        for d in range(self.depth, 0, -1):
            at = self.find[d].find(context[todo] & np.uint64((1 << 8 * d) - 1))
            hit = at >= 0
            row[todo[hit]] = at[hit] + self.row[d]
            todo = todo[~hit]
            if not len(todo):
                break
        return self.logs[row * 256 + (code & np.uint64(255)).astype(np.int64)]


def _lookup(x: np.ndarray, shift: float, known: np.ndarray) -> np.ndarray:
    """ln Gamma(x + shift) of counts, from a table up to its end."""
    out = known[np.minimum(x, len(known) - 1)]
    big = np.flatnonzero(x >= len(known))
    out[big] = log_gamma(x[big] + shift)
    return out


_HALF, _ONE = (log_gamma(np.arange(1 << 12) + shift) for shift in (0.5, 1.0))


def _block(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """ln of the KT block probability of counts."""
    return _lookup(zero, 0.5, _HALF) + _lookup(one, 0.5, _HALF) - np.log(np.pi) - _lookup(zero + one, 1.0, _ONE)


def _estimate(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (one + 0.5) / (zero + one + 1)


class Decisions:
    """Counts of decisions in nested contexts of ``low`` to ``high`` bytes, weighted from the longest up.

    Rows are sorted by ``key``, (decision, context from its last byte back); ``kept[d]`` says
    of each row whether its context of d bytes is a node.  ``deeper`` has what rows' kept contexts
    of ``high`` + 1 bytes hold (zeros, ones, ln of weighted probability); without it ``high`` ends the tree.
    """

    def __init__(self, key: np.ndarray, zero: np.ndarray, one: np.ndarray, kept: dict[int, np.ndarray], low: int, high: int, deeper: tuple | None = None):
        self.low, self.high, self.kept = low, high, kept
        self.group, self.first, self.up, self.p, self.rest, self.weight = {}, {}, {}, {}, {}, {}
        for d in range(low, high + 1):
            part = key >> np.int64(8 * (high - d))
            new = np.append(True, part[1:] != part[:-1])
            self.first[d], self.group[d] = np.flatnonzero(new), np.cumsum(new) - 1
            self.up[d] = self.group[d - 1][self.first[d]] if d > low else None
        for d in range(high, low - 1, -1):
            size = len(self.first[d])
            z, o = np.add.reduceat(zero, self.first[d]), np.add.reduceat(one, self.first[d])
            block, self.p[d] = _block(z, o), _estimate(z, o)
            if deeper is None:
                below = block
            else:
                at, dz, do, db = deeper
                total = lambda x: np.bincount(at, x, size)
                rz, ro = z - total(dz).astype(np.int64), o - total(do).astype(np.int64)
                self.rest[d] = _estimate(rz, ro)
                below = np.logaddexp(block, _block(rz, ro) + total(db)) - np.log(2)
                self.weight[d] = np.exp(block - np.log(2) - below)
            node = kept[d][self.first[d]]
            self.zero, self.one, self.below = z * node, o * node, below * node
            if d > low:
                deeper = self.up[d], self.zero, self.one, self.below

    def down(self, fixed: np.ndarray, left: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From what shorter contexts give each row (probability, weight left, probability if no
        longer context is a node) to what the contexts of ``high`` bytes give it."""
        p = p.copy()
        for d in range(self.low, self.high + 1):
            row = self.group[d]
            if d in self.weight:
                w = self.weight[d][row]
                fixed, left = fixed + left * w * self.p[d][row], left * (1 - w)
                here = fixed + left * self.rest[d][row]
            else:
                here = fixed + left * self.p[d][row]
            p = np.where(self.kept[d], here, p)
        return fixed, left, p


def _frequent(part: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Of sorted rows, whether those of the same ``part`` hold ``least`` counts."""
    new = np.append(True, part[1:] != part[:-1])
    return (np.add.reduceat(n, np.flatnonzero(new)) >= least)[np.cumsum(new) - 1]


def _subtrees(depth: int, top: int, least: float, then):
    """Batches of (key, n, part) sorted by ``part`` to what ``then`` makes of whole parts: for each bit of the
    bytes it gets the order of the rows, the bit, the rows' keys and their ``Decisions``."""

    def work(code, n):
        context, byte = code >> np.int64(8), code & np.int64(255)
        back = np.zeros(len(code), np.int64)
        for k in range(depth):
            back = back << np.int64(8) | context >> np.int64(8 * k) & np.int64(255)
        order = np.argsort(back)
        code, n, back, byte = code[order], n[order], back[order], byte[order]
        kept = {d: _frequent(back >> np.int64(8 * (depth - d)), n, least) for d in range(top + 1, depth + 1)}

        def bits():
            for k in range(8):
                node, bit = (256 + byte) >> (8 - k), (byte >> (7 - k)) & 1
                by = np.argsort(node.astype(np.uint8), kind="stable")
                key, one = node[by] << np.int64(8 * depth) | back[by], (n * bit)[by]
                yield by, bit[by], key, Decisions(key, n[by] - one, one, {d: x[by] for d, x in kept.items()}, top + 1, depth)

        return then(code, n, bits())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("key", "n", "part")])
            size += len(batch)
            if size < _CHUNK:
                continue
            key, n, part = (np.concatenate(x) for x in zip(*held))
            cut = np.searchsorted(part, part[-1])
            held, size = [[key[cut:], n[cut:], part[cut:]]], len(key) - cut
            if cut:
                yield from work(key[:cut], n[:cut])
        if size:
            key, n, _ = (np.concatenate(x) for x in zip(*held))
            yield from work(key, n)
        W.trim()

    return run


def _tops(depth: int, top: int):
    """What goes up from subtrees: sums by (decision, context of ``top`` bytes), with those of kept longer contexts."""

    def then(code, n, bits):
        for by, bit, key, tree in bits:
            part = key >> np.int64(8 * (depth - top))
            new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            at = np.searchsorted(new, tree.first[top + 1], "right") - 1
            one = n[by] * bit
            sums = [np.add.reduceat(x, new) for x in (n[by] - one, one)] + [np.bincount(at, x, len(new)) for x in (tree.zero, tree.one, tree.below)]
            yield pa.RecordBatch.from_arrays([pa.array(part[new]), *(pa.array(x.astype(np.int64)) for x in sums[:4]), pa.array(sums[4])], ["at", "zero", "one", "deep_zero", "deep_one", "below"])

    return then


def _logs(depth: int, top: int, model):
    """The log10 probability of each code, from the top's state and its subtree."""

    def then(code, n, bits):
        at, *state = model.value
        out = np.zeros(len(code))
        for by, bit, key, tree in bits:
            row = np.searchsorted(at, key >> np.int64(8 * (depth - top)))
            p = np.clip(tree.down(*(x[row] for x in state))[2], 1e-15, 1 - 1e-15)
            out[by] += np.log10(np.where(bit, p, 1 - p))
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n), pa.array(out)], ["key", "n", "logp"])

    return then


def train_counts(mine: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n): counts in the training texts of every word of theirs, and of every byte with its context of any text."""
    counts = mine.select("text", "held_out").mapInArrow(_counts(depth), "kind int, key long, n long")
    return checkpointed(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")))


def code_logs(counts: DataFrame, depth: int = DEPTH, least: float = LEAST) -> DataFrame:
    """(key, n, logp): the log10 probability of every counted byte in its context, in the weighted tree of all of them."""
    top = min(TOP, depth - 1)
    part = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (top + 1)) - 1))
    codes = counts.filter("kind = 1").select("key", "n", part.alias("part")).repartition("part").sortWithinPartitions("part")
    up = codes.mapInArrow(_subtrees(depth, top, least, _tops(depth, top)), "at long, zero long, one long, deep_zero long, deep_one long, below double")
    rows = up.groupBy("at").agg(*(F.sum(c).alias(c) for c in up.columns[1:])).toArrow().sort_by("at")
    at, zero, one, deep_zero, deep_one, below = (c.to_numpy() for c in rows.columns)
    state = (np.zeros(0),) * 3
    if len(at):
        node, context, n = at >> np.int64(8 * top), at & np.int64((1 << 8 * top) - 1), zero + one
        whole = node == 1  # the first decision of a byte holds all bytes
        kept = {0: np.ones(len(at), bool)}
        for d in range(1, top + 1):
            kept[d] = _frequent(context[whole] >> np.int64(8 * (top - d)), n[whole], least)[np.searchsorted(context[whole], context)]
        tree = Decisions(at, zero, one, kept, 0, top, (np.arange(len(at)), deep_zero, deep_one, below))
        state = tree.down(np.zeros(len(at)), np.ones(len(at)), np.zeros(len(at)))
    model = counts.sparkSession.sparkContext.broadcast((at, *state))
    return checkpointed(codes.mapInArrow(_subtrees(depth, top, least, _logs(depth, top, model)), "key long, n long, logp double"))


def head_of(rows: DataFrame, value: str, most: int = HEAD) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent rows of (key, n), at most ``most`` of them, as (keys, values), and the least count among them.
    The cut is a count, found from a histogram of their logarithms (at most 1,024 rows)."""
    sizes = F.floor(F.log2("n") * 16).cast("int")
    histogram = rows.filter("n > 0").groupBy(sizes.alias("size")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect()
    room, least = most, None
    for r in sorted(histogram, key=lambda r: -r["size"]):
        if r["rows"] > room:
            break
        room -= r["rows"]
        least = r["least"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0), 0
    head = rows.filter(F.col("n") >= least).select("key", F.col(value).alias("value")).toArrow()
    return head.column("key").to_numpy().view(np.uint64), head.column("value").to_numpy(), least


def _outside(least: int) -> Column:
    return F.col("n") < least if least else F.lit(True)


def _by_text(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (text, key) once, with how often it occurs."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, np.int64)
    return doc[new], key[new], np.diff(np.append(new, len(key)))


def _scores(depth: int, model):
    """Batches of (doc_id, held_out, text) to one row per text, and one per word (kind 0) and per byte code (1) of it outside the heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, code_logs, head, logs = model()
        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, at = W.text_buffers(batch.column("text"))
            for i, j in W.groups(at, _RUN):
                d, a = W.mapped(data[at[i] : at[j]], W.LOWER), at[i : j + 1] - at[i]
                score, tails = np.zeros(j - i), []
                for in_doc, code in code_runs(d, a, depth):
                    where = codes.find(code)
                    met = where >= 0
                    score += np.bincount(in_doc[met], code_logs[where[met]], j - i)
                    tails.append(_by_text(in_doc[~met], code[~met]))
                code_doc, rare_code, code_times = (np.concatenate(x) for x in zip(*tails))
                starts, ends, first = W.word_bounds(d, a, W.SPACE)
                hashes = W.word_hashes(d, starts, ends)
                doc = W.doc_of(first)
                where = head.find(np.append(hashes, np.uint64(_END_WORD)))
                end, where = where[-1], where[:-1]
                known = where >= 0
                base = np.bincount(doc[known], logs[where[known]], j - i)
                n_known = np.bincount(doc[known], minlength=j - i)
                rows = serial + np.arange(i, j)
                rare_doc, rare = doc[~known], hashes[~known]
                if end >= 0:
                    base += logs[end]
                    n_known += 1
                else:
                    rare_doc, rare = np.append(rare_doc, np.arange(j - i)), np.append(rare, np.full(j - i, _END_WORD, np.uint64))
                rare_doc, rare, times = _by_text(rare_doc, rare)
                part = batch.slice(i, j - i)
                m, none = len(rare) + len(rare_code), pa.nulls
                kind = np.concatenate([np.full(j - i, 2), np.zeros(len(rare)), np.ones(len(rare_code))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, rows[rare_doc], rows[code_doc]])),
                        pa.array(kind),
                        pa.array(np.concatenate([W.signed(W.mix(rows.astype(np.uint64))), W.signed(rare), W.signed(rare_code)])),
                        pa.array(np.concatenate([np.zeros(j - i, np.int64), times, code_times])),
                        pa.concat_arrays([part.column("doc_id"), none(m, pa.int64())]),
                        pa.concat_arrays([part.column("held_out"), none(m, pa.bool_())]),
                        pa.array(np.append(np.diff(first) + 1, np.zeros(m, np.int64))),
                        pa.array(np.append(n_known, np.zeros(m, np.int64))),
                        pa.array(np.append(base, np.zeros(m))),
                        pa.array(np.append(score, np.zeros(m))),
                        pa.array(np.append(np.diff(a), np.zeros(m, np.int64))),
                    ],
                    ["row", "kind", "key", "times", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes"],
                )
            serial += len(batch)

    return run


def score_texts(docs: DataFrame, learn, depth: int = DEPTH, share: int | None = None, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte.

    ``learn`` is a condition on ``docs``; where it is not true a row is held out.
    With ``share`` a node holds 1 / ``share`` of all training bytes, which bounds the
    tree; without it, ``LEAST`` bytes.  Null and empty texts are the end token (and
    the end byte) alone.  Without training rows every count is 0 and the score is the
    KT prior.  Repeated rows get one row each; a null doc_id is kept.
    """
    mine = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (~F.coalesce(learn, F.lit(False))).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    counts = train_counts(mine, depth)
    words = counts.filter("kind = 0")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least_node = LEAST if share is None else (counts.filter("kind = 1").agg(F.sum("n")).first()[0] or 0) / share
    codes = code_logs(counts, depth, least_node)
    hashes, n, least = head_of(words, "n", head)
    known, known_logs, least_code = head_of(codes, "logp", head)
    denominator = tokens + 0.1 * (distinct + 1)
    model = shipped(docs.sparkSession, (Table(known), known_logs, Table(hashes), np.log10((n + 0.1) / denominator).astype(np.float64)))
    rows = mine.mapInArrow(
        _scores(depth, model), "row long, kind int, key long, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long"
    )
    tail = words.filter(_outside(least)).select("kind", "key", F.col("n").alias("c"), F.lit(0.0).alias("logp"))
    tail = tail.unionByName(codes.filter(_outside(least_code)).select(F.lit(1).alias("kind"), "key", F.lit(0).cast("long").alias("c"), "logp"))
    word = F.when(F.col("kind") == 0, F.col("times")).otherwise(0)
    met = rows.join(tail, ["kind", "key"], "left").select(
        "row", "doc_id", "held_out", "n_tokens", "n_bytes",
        (F.col("n_known") + F.when(F.col("c") > 0, word).otherwise(0)).alias("n_known"),
        (F.col("base") + word * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(denominator))).alias("base"),
        (F.col("score") + F.col("times") * F.coalesce("logp", F.lit(0.0))).alias("score"),
    )
    return met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
        (F.sum("score") / (F.sum("n_bytes") + 1) / F.lit(-float(np.log10(2)))).alias("bits_per_byte"),
    ).drop("row")
