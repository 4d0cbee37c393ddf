"""The run-length index and the operator on it against plain dictionaries of strings."""

import hashlib
import random

import numpy as np
import pytest

from rolecall.llm import runindex

SCHEMA = "doc_id long, text string, th string, key int, pos int, spans string, source string"


def brute(texts, length):
    """For each text the bytes that a repeated string covers."""
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((k, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = b"\1" * length
    return gone


def expected(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), t, g in zip(rows, texts, brute(texts, length)):
        kept = bytes(b for b, x in zip(t, g) if not x)
        runs = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((doc_id, len(t), sum(g), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words(rng, n, kinds="abcdefgé"):
    return " ".join("".join(rng.choice(kinds) for _ in range(rng.randint(1, 6))) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    passage, line, base = words(rng, 90), words(rng, 30), words(rng, 200)
    rows = [(i, words(rng, rng.choice([1, 20, 60, 150]))) for i in range(30)]
    rows += [(i, words(rng, 20) + passage[rng.randint(0, 40) :] + words(rng, rng.randint(0, 30))) for i in range(30, 45)]
    rows += [(i, words(rng, 12) + line + words(rng, 12)) for i in range(45, 60)]
    for i in range(60, 75):
        at = rng.randrange(len(base))
        rows.append((i, base[:at] + "#" * rng.randint(0, 2) + base[at:]))
    rows += [(80, None), (81, ""), (82, "ab" * 400), (83, "x" * 260), (84, "abc" * 90 + words(rng, 40)), (85, "z" * 199), (86, "z" * 200), (87, (line + "!") * 4)]
    return rows + [rows[3], rows[3], (None, rows[40][1]), (None, None), (None, rows[20][1]), (20, rows[21][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "s", "z") for i, t in rows], SCHEMA).repartition(5)


def got(spark, rows, **kw):
    out = runindex.deduplicated(frame(spark, rows), texts=False, **kw).drop("th")
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("length, gram, group", [(200, 32, 1024), (60, 20, 1024), (60, 20, 3)])
def test_against_brute_force(spark, length, gram, group):
    rows = corpus()
    assert got(spark, rows, length=length, gram=gram, group=group) == expected(rows, length)


def test_anchor_with_many_contexts(spark):
    """One line in many surroundings is divided until its parts are small."""
    rng = random.Random(4)
    line = words(rng, 70)
    rows = [(i, words(rng, 8) + line[rng.randint(0, 60) : len(line) - rng.randint(0, 60)] + words(rng, 8)) for i in range(70)]
    assert got(spark, rows, group=5) == expected(rows, 200)


def test_slices_of_long_texts(spark, monkeypatch):
    """Texts over several slices: anchors and contexts at their borders count once."""
    rng = random.Random(6)
    data = np.frombuffer((words(rng, 3000) + "q" * 700 + words(rng, 300)).encode(), np.uint8)
    whole = [np.concatenate(c) for c in zip(*runindex.anchors(data, 200, 32))]
    for size in (400, 1000, 3001):
        monkeypatch.setattr(runindex, "_SLICE", size)
        parts = [np.concatenate(c) for c in zip(*runindex.anchors(data, 200, 32))]
        assert all((a == b).all() for a, b in zip(whole, parts))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(whole[1], whole[2])])
    assert (covered == np.arange(len(data) - 199)).all()


def test_index():
    """Suffixes, runs and statistics of small and of repetitive contexts."""
    rng = random.Random(2)
    for trial in range(30):
        kinds = b"ab" if trial % 2 else b"abcde\0\xff"
        base = bytes(rng.choice(kinds) for _ in range(40))
        contexts = [bytes(rng.choice(kinds) for _ in range(rng.randint(1, 30))) for _ in range(5)] + [base, base[:20] + b"x" + base[20:], base] * (trial % 3)
        at = np.append(0, np.cumsum([len(c) for c in contexts]))
        index = runindex.RunIndex(np.frombuffer(b"".join(contexts), np.uint8), at)
        found = index.statistics()
        suffixes = [(k, i) for k, c in enumerate(contexts) for i in range(len(c))]
        for k, i in suffixes:
            most = max([0, *(common(contexts[k][i:], contexts[q][j:]) for q, j in suffixes if (q, j) != (k, i))])
            assert found[index.first[k] + i] == most
    copies = runindex.RunIndex(np.frombuffer(base * 50, np.uint8), np.arange(51) * 40)
    assert len(copies.runs) < len(base) * 50 / 4


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_kept_bytes_and_spans(spark):
    rows = corpus(9)
    texts = {i: (t or "").encode() for i, t in rows[:60]}
    for r in runindex.deduplicated(frame(spark, rows[:60])).collect():
        spans = [(s["s"], s["e"]) for s in r["removed"]]
        assert len(spans) == r["n_spans"] and sum(e - s for s, e in spans) == r["n_removed"]
        t = texts[r["doc_id"]]
        assert bytes(r["kept"]) == b"".join(t[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t)]))


def test_no_documents(spark):
    assert got(spark, []) == []
