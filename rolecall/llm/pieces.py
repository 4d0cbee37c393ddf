"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The machine is normaliser o (pieces | byte fallback)*: the normaliser puts one
word mark before the text and maps each space to it; each piece is a path that
reads its bytes and writes its id at a cost; each byte can also be read alone,
at a higher cost, and writes its fallback id.  Composed with an input this is a
lattice over the input's bytes, and the encoding is its tropical-semiring
shortest path; of equal paths the one whose last piece is longer wins, from the
end backwards.

A vocabulary of merge ranks has no probabilities.  The cost of the piece of
rank r is its Zipf code length ln(r + 1) + ln H, in units of 2**-16; costs are
integers, so sums are exact.

Between two bytes that no piece holds side by side every path has a state, so
inputs are cut there, equal parts of a batch are composed once, and the lattices
of all parts advance together, one byte place at a time.  A part of over ``LONG``
bytes (a run of one letter, or a script that pieces cover without a gap) is walked alone.

A literal word mark in a text is no space: it is read by byte fallback, so that
decoding returns every text exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .ctw import Table
from .rows import shipped

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the word mark U+2581 of the vocabulary's pieces.
MARK = "▁"
UNIT = 1 << 16
#: Bytes that no cut divides, from which a part is walked alone.
LONG = 256
#: Bytes of text that a task encodes at once.
RUN = 1 << 20
_FAR = np.int64(1) << 60


class Transducer:
    """The compiled machine: pieces by length and hash, costs, fallback ids and output bytes."""

    def __init__(self, pieces: list[tuple[int, bytes, int]], fallback: list[int], fallback_cost: int):
        """pieces: (id, bytes with 0x20 for the word mark, cost); fallback: the id of each byte."""
        self.fallback = np.array(fallback, np.int64)
        self.fallback_cost = fallback_cost
        by_length: dict[int, list[tuple[int, bytes, int]]] = {}
        for piece in pieces:
            by_length.setdefault(len(piece[1]), []).append(piece)
        self.lengths = sorted(by_length)
        self.tables, self.ids, self.costs = {}, {}, {}
        self.beside = np.zeros((256, 256), bool)
        top = max([*fallback, *(p[0] for p in pieces)]) + 1
        spell: list[bytes] = [b""] * top
        for b, i in enumerate(fallback):
            spell[i] = bytes([b])
        for n, some in by_length.items():
            data = np.frombuffer(b"".join(p[1] for p in some), np.uint8)
            at = np.arange(len(some)) * n
            self.tables[n] = Table(W.word_hashes(data, at, at + n))
            self.ids[n] = np.array([p[0] for p in some], np.int64)
            self.costs[n] = np.array([p[2] for p in some], np.int64)
            grid = data.reshape(-1, n)
            self.beside[grid[:, :-1].ravel(), grid[:, 1:].ravel()] = True
            for i, b, _ in some:
                spell[i] = b
        self.spelt = np.frombuffer(b"".join(spell), np.uint8)
        self.spelt_at = np.append(0, np.cumsum([len(b) for b in spell]))
        self.cost_of = {b: (i, c) for i, b, c in pieces}
        self.is_fallback = np.zeros(top, bool)
        self.is_fallback[self.fallback] = True

    def cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The states that every path has: starts of texts, and places that no piece crosses."""
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.beside.ravel().take(data[:-1].astype(np.int32) * 256 + data[1:])
        cut[at[:-1]] = True
        return np.flatnonzero(cut)

    def shortest(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shortest paths through the lattices of the parts [start, end): (ids of all parts
        in order, number of ids of each part, cost of each part)."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        n = size[order]
        # the parts' bytes by size, and sums of their polynomials, in powers of the place within the part
        data = spread(data, starts[order], n)
        s = np.append(0, np.cumsum(n))[:-1]
        local = np.arange(len(data)) - np.repeat(s, n)
        longest = int(n[0]) if len(n) else 0
        back_power = W.powers(W.inverse(W._BASE), longest + 1)
        total_hash = np.append(np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * W.powers(W._BASE, longest + 1)[local]))
        base = np.append(0, np.cumsum(n + 1))[:-1]
        total = int((n + 1).sum())
        best = np.full(total, _FAR)
        best[base] = 0
        step = np.zeros(total, np.int32)
        chosen = np.zeros(total, np.int64)
        alive = len(n)
        for t in range(1, longest + 1):
            alive = int(np.searchsorted(-n, -t, "right"))
            here, begin = base[:alive] + t, s[:alive]
            low, back = np.full(alive, _FAR), np.zeros(alive, np.int32)
            out = np.zeros(alive, np.int64)
            for size_l in reversed(self.lengths):
                if size_l > t:
                    continue
                raw = (total_hash[begin + t] - total_hash[begin + t - size_l]) * back_power[t - size_l]
                k = self.tables[size_l].find(W.mix(raw ^ np.uint64(size_l)))
                hit = np.flatnonzero(k >= 0)
                cost = best[here[hit] - size_l] + self.costs[size_l][k[hit]]
                better = cost < low[hit]
                won = hit[better]
                low[won], back[won], out[won] = cost[better], size_l, self.ids[size_l][k[won]]
            cost = best[here - 1] + self.fallback_cost
            won = cost < low
            low = np.where(won, cost, low)
            back[won] = 1
            out[won] = self.fallback[data[begin[won] + t - 1]]
            best[here], step[here], chosen[here] = low, back, out
        return self._walk(order, n, base, best, step, chosen)

    @staticmethod
    def _walk(order, n, base, best, step, chosen):
        """Follow the back steps of all lattices together and put their ids in input order."""
        count = np.zeros(len(n), np.int64)
        at = n.copy()
        live = np.flatnonzero(at > 0)
        while len(live):
            at[live] -= step[base[live] + at[live]]
            count[live] += 1
            live = live[at[live] > 0]
        counts = np.empty(len(n), np.int64)
        counts[order] = count
        first = np.append(0, np.cumsum(counts))
        ids = np.empty(first[-1], np.int64)
        put = first[1:][order] - 1
        at = n.copy()
        live = np.flatnonzero(at > 0)
        while len(live):
            place = base[live] + at[live]
            ids[put[live]] = chosen[place]
            put[live] -= 1
            at[live] -= step[place]
            live = live[at[live] > 0]
        cost = np.empty(len(n), np.int64)
        cost[order] = best[base + n]
        return ids, counts, cost

    def walk(self, data: bytes) -> tuple[list[int], int]:
        """The shortest path through the lattice of one long part, (ids, cost), place by place in
        plain Python: lattices that advance together are only fast while there are many."""
        n, known, longest = len(data), self.cost_of, self.lengths[-1]
        best, back, out = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for t in range(1, n + 1):
            low, size, piece = int(_FAR), 1, 0
            for k in range(max(0, t - longest), t):  # longer pieces first
                found = known.get(data[k:t])
                if found is not None and best[k] + found[1] < low:
                    low, size, piece = best[k] + found[1], t - k, found[0]
            if best[t - 1] + self.fallback_cost < low:
                low, size, piece = best[t - 1] + self.fallback_cost, 1, int(self.fallback[data[t - 1]])
            best[t], back[t], out[t] = low, size, piece
        ids, t = [], n
        while t:
            ids.append(out[t])
            t -= back[t]
        return ids[::-1], best[n]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text, cost of each text)."""
        n = len(at) - 1
        size = np.diff(at)
        marked = np.full(len(data) + n, 0x20, np.uint8)  # the normaliser: a mark before each text
        marked[np.arange(len(data)) + np.repeat(np.arange(n), size) + 1] = data
        bounds = at + np.arange(n + 1)
        starts = self.cuts(marked, bounds)
        ends = np.append(starts[1:], len(marked))
        # a long text is cut too: parts are taken in runs of bounded size
        done = [self._parts(marked, starts[i:j], ends[i:j]) for i, j in W.groups(np.append(starts, len(marked)), RUN)]
        flat, counts, cost = (np.concatenate([x[k] for x in done]) if done else np.zeros(0, np.int64) for k in range(3))
        part = np.searchsorted(starts, bounds)
        upto = np.append(0, np.cumsum(counts))
        paid = np.append(0, np.cumsum(cost))
        return flat, np.diff(upto[part]), np.diff(paid[part])

    def _parts(self, marked: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids, cost) of the parts [start, end), equal ones composed once."""
        _, one, same = np.unique(W.word_hashes(marked, starts, ends), return_index=True, return_inverse=True)
        s, e = starts[one], ends[one]
        short = e - s <= LONG
        counts, cost = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        flat, counts[short], cost[short] = self.shortest(marked, s[short], e[short])
        first = np.zeros(len(one), np.int64)
        first[short] = np.cumsum(counts[short]) - counts[short]
        for k in np.flatnonzero(~short):
            ids, cost[k] = self.walk(marked[s[k] : e[k]].tobytes())
            first[k], counts[k] = len(flat), len(ids)
            flat = np.append(flat, np.array(ids, np.int64))
        return spread(flat, first[same], counts[same]), counts[same], cost[same]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and their offsets: spellings joined, without the leading mark."""
        length = np.diff(self.spelt_at)[ids]
        data = spread(self.spelt, self.spelt_at[ids], length)
        at = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(counts))]
        keep = np.ones(len(data), bool)
        keep[at[:-1]] = False
        return data[keep], at - np.arange(len(at))


def spread(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + count[i]] for each i, joined."""
    total = np.append(0, np.cumsum(count))
    return values[np.arange(total[-1]) + np.repeat(start - total[:-1], count)]


def compiled(model: str = MODEL) -> Transducer:
    """The machine of a SentencePiece model file; the vocabulary is read, never trained or copied."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces, fallback = [], [0] * 256
    texts = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i))]
    rank = {i: r for r, i in enumerate(sorted(texts, key=lambda i: (-p.get_score(i), i)))}
    harmonic = np.log((1 / np.arange(1, len(texts) + 1)).sum())
    for i in range(p.get_piece_size()):
        if p.is_byte(i):
            fallback[int(p.id_to_piece(i)[3:5], 16)] = i
        elif i in rank:
            pieces.append((i, p.id_to_piece(i).replace(MARK, " ").encode(), round((np.log(rank[i] + 1) + harmonic) * UNIT)))
    dearest = max(c for _, _, c in pieces)
    return Transducer(pieces, fallback, dearest + 10 * UNIT)


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_ids, n_fallback, cost (nats), ids, exact.

    ``exact`` tells that decoding the ids returned every byte of the text.  Null and
    empty texts are the word mark alone; repeated rows and null ids get one row each.
    Texts are read once, in runs of about 1 MB, and within a longer text its parts in such
    runs; the compiled vocabulary is broadcast (its size is that of the model file).
    """
    machine = shipped(docs.sparkSession, compiled(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_buffers(batch.column("text"))
            for i, j in W.groups(at, RUN):
                d, a = data[at[i] : at[j]], at[i : j + 1] - at[i]
                ids, counts, cost = machine().encode(d, a)
                back, b = machine().decode(ids, counts)
                if len(back) == len(d) and (b == a).all():
                    wrong = np.append(0, np.cumsum(back != d))
                    exact = wrong[a[1:]] == wrong[a[:-1]]
                else:
                    exact = np.array([back[b[k] : b[k + 1]].tobytes() == d[a[k] : a[k + 1]].tobytes() for k in range(j - i)])
                first = np.append(0, np.cumsum(counts))
                spare = np.append(0, np.cumsum(machine().is_fallback[ids]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(counts), pa.array(spare[first[1:]] - spare[first[:-1]]), pa.array(cost / UNIT), W.lists(ids.astype(np.int32), counts, pa.int32()), pa.array(exact)],
                    ["doc_id", "n_ids", "n_fallback", "cost", "ids", "exact"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, n_fallback long, cost double, ids array<int>, exact boolean")


def decoded(ids: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text): the text of each row's ids; a row without ids is an empty text."""
    machine = shipped(ids.sparkSession, compiled(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            counts = lists.value_lengths().fill_null(0).to_numpy()
            texts = []
            for k, n in enumerate(counts):
                data, _ = machine().decode(lists[k].values.to_numpy().astype(np.int64), np.array([n])) if n else (np.zeros(0, np.uint8), None)
                texts.append(data.tobytes().decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
