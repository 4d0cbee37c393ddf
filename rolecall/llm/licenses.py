"""License scan by patience alignment.

Text and template are words without case and punctuation.  Words that occur
once in both are anchors; the longest subsequence of them in the same order is
kept, and the gaps between its members are aligned in the same way, where other
words may now be unique.  The coverage of a template is the share of its words
that are aligned.

A template is aligned in stretches of twice its length, one template length
apart, so that a notice that stands twice in a text is not ambiguous.  A stretch
whose words, each counted as often as the template has it, cannot reach the
threshold is skipped; that bound is exact.

Templates share sentences, so one span may reach the coverage of several.  It is
given to the one with the most words aligned: a BSD text of three clauses is not
also one of two, and of two notices that differ in a version the right one stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .ctw import Table
from .license_texts import TEXTS

COVERAGE = 0.8


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below: list[int] = []
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        below.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            piles.append(k)
        else:
            tops[p] = v
            piles[p] = k
    out = []
    k = piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = below[k]
    return out[::-1]


def patience(text: list, template: list) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), increasing in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        once_text = Counter(text[a:b])
        once_template = Counter(template[c:d])
        place = {w: c + k for k, w in enumerate(template[c:d]) if once_template[w] == 1}
        anchors = [(a + k, place[w]) for k, w in enumerate(text[a:b]) if once_text[w] == 1 and w in place]
        if not anchors:
            continue
        kept = [anchors[k] for k in longest_increasing([p[1] for p in anchors])]
        found.extend(kept)
        ends = [(a - 1, c - 1), *kept, (b, d)]
        gaps.extend((x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:]))
    return sorted(found)


def stretches(n: int, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of 2 * size words, size apart, over n words."""
    for a in range(0, max(1, n - size), size):
        yield a, min(n, a + 2 * size)


def best_spans(spans: list[tuple[int, float, int, int, str]]) -> list[tuple[int, float, int, int, str]]:
    """Of spans (words aligned, coverage, first word, end, template) those that no better one holds.

    Better is more words, then coverage, then the earlier span, then the name.  A span
    goes if half of it lies in a better one, or if it meets a better one of its template.
    """
    kept: list[tuple[int, float, int, int, str]] = []
    for span in sorted(spans, key=lambda x: (-x[0], -x[1], x[2], x[3], x[4])):
        _, _, s, e, name = span
        shared = [(min(e, y) - max(s, x), other) for _, _, x, y, other in kept]
        if not any(both > 0 and (2 * both >= e - s or other == name) for both, other in shared):
            kept.append(span)
    return kept


def scan(text: list, templates: dict[str, list], coverage: float, maybe=None) -> list[tuple[str, int, int, int, int]]:
    """(template, words aligned, first word, end, occurrences) of each template that
    reaches the coverage in a span of its own: its best span, and how many it has.
    ``maybe(name)`` may give the stretches worth a look."""
    spans = []
    for name, template in templates.items():
        need = coverage * len(template)
        have = Counter(template)
        for a, b in stretches(len(text), len(template)) if maybe is None else maybe(name):
            if sum(min(k, have[w]) for w, k in Counter(text[a:b]).items() if w in have) < need:
                continue
            pairs = patience(text[a:b], template)
            if pairs and len(pairs) >= need:
                spans.append((len(pairs), len(pairs) / len(template), a + pairs[0][0], a + pairs[-1][0] + 1, name))
    best: dict[str, tuple[str, int, int, int, int]] = {}
    for n, _, s, e, name in best_spans(spans):
        first = best.get(name, (name, n, s, e, 0))
        best[name] = (*first[:4], first[4] + 1)
    return [best[name] for name in templates if name in best]


def license_words(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = W.word_bounds(data, np.array([0, len(data)]), W.NON_WORD)
    return W.word_hashes(data, starts, ends, W.LOWER).tolist()


def licenses(docs: DataFrame, coverage: float = COVERAGE, texts: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of ``docs`` and template that reaches ``coverage``: doc_id,
    license, coverage, n_aligned, n_template, first_word, end_word, occurrences.

    Each span of a text goes to one template, the one with the most words aligned
    (``best_spans``); a tie goes to the higher coverage, the earlier span, the lesser
    name.  Texts are scanned whole and once, with no shuffle.  Null and empty texts give no
    rows; a repeated row gives its rows again; a null doc_id is kept.
    """
    templates = {k: license_words(v) for k, v in (texts or TEXTS).items()}
    vocabulary = sorted({w for t in templates.values() for w in t})
    table = Table(np.array(vocabulary, np.uint64))
    of = {k: np.array([w in set(t) for w in vocabulary] + [False]) for k, t in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_buffers(batch.column("text"))
            for i, j in W.groups(at):
                d, a = data[at[i] : at[j]], at[i : j + 1] - at[i]
                starts, ends, first = W.word_bounds(d, a, W.NON_WORD)
                hashes = W.word_hashes(d, starts, ends, W.LOWER)
                known = table.find(hashes)
                here = np.flatnonzero(known >= 0)
                todo: dict[int, dict[str, list[tuple[int, int]]]] = {}
                for name, template in templates.items():
                    size = len(template)
                    mine = here[of[name][known[here]]]
                    # words of the template in a row of 2 * size words: a bound for every stretch inside
                    near = np.searchsorted(mine, mine + 2 * size) - np.arange(len(mine))
                    for p in mine[near >= coverage * size].tolist():
                        k = int(np.searchsorted(first, p, "right")) - 1
                        lo, n = int(first[k]), int(first[k + 1] - first[k])
                        # the stretches that begin at most 2 * size words before p, or at p
                        for s in {max(0, (p - lo) // size - x) * size for x in (0, 1, 2)}:
                            if s < max(1, n - size):
                                todo.setdefault(k, {}).setdefault(name, []).append((s, min(n, s + 2 * size)))
                rows = []
                for k in sorted(todo):
                    text = hashes[first[k] : first[k + 1]].tolist()
                    for r in scan(text, {x: templates[x] for x in templates if x in todo[k]}, coverage, lambda x: sorted(set(todo[k][x]))):
                        rows.append((i + k, *r))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([r[1] for r in rows], pa.string()),
                        pa.array([r[2] / len(templates[r[1]]) for r in rows], pa.float64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([len(templates[r[1]]) for r in rows], pa.int64()),
                        *(pa.array([r[x] for r in rows], pa.int64()) for x in (3, 4, 5)),
                    ],
                    ["doc_id", "license", "coverage", "n_aligned", "n_template", "first_word", "end_word", "occurrences"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, coverage double, n_aligned long, n_template long, first_word long, end_word long, occurrences long")
