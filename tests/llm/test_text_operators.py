"""Each operator against a brute-force version on a small corpus with hard cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecall.llm import ctw, decontaminate, licenses, media, neardup, pieces, pii, quality, substrings, warc
from rolecall.llm import words as W

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words_and_hashes(corpus):
    import pyarrow as pa

    data, at = W.text_buffers(pa.array([t for _, t in corpus]))
    starts, ends, first = W.word_bounds(data, at, W.SPACE)
    hashes = W.word_hashes(data, starts, ends)
    seen = {}
    for k, (_, t) in enumerate(corpus):
        mine = [data[s:e].tobytes().decode() for s, e in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])]
        assert mine == SPACED.findall(t or "")
        for w, h in zip(mine, hashes[first[k] : first[k + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_winnow_keeps_a_common_gram():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(0, 1000, 10, dtype=np.uint64)
        kept = []
        for pad in (rng.integers(0, 50), rng.integers(0, 50)):
            h = W.mix(np.concatenate([rng.integers(0, 1000, pad, dtype=np.uint64), shared, rng.integers(0, 1000, 30, dtype=np.uint64)]))
            g = W.Grams(h)
            every = g.of(np.arange(len(h)), np.minimum(np.arange(len(h)) + 5, len(h)))
            kept.append(set(every[W.winnow(every, np.array([0, len(h)]), 5, 6)].tolist()))
        assert kept[0] & kept[1]


def test_winnow_breaks_ties_alike_in_texts_of_any_length(monkeypatch):
    rng = np.random.default_rng(2)
    h = W.mix(rng.integers(0, 40, 3000, dtype=np.uint64)) & ~np.uint64((1 << 24) - 1)
    first = np.array([0, 1000, 1000, 3000])
    whole = W.winnow(h, first, 5, 6)
    monkeypatch.setattr(W, "_PLACE", 9)
    assert (W.winnow(h, first, 5, 6) == whole).all()


def windows_of(items, n=10):
    out = {}
    for i, t in items:
        w = WORDS.findall(fold(t))
        for p in range(max(1, len(w) - n + 1)) if w else ():
            out.setdefault(tuple(w[p : p + n]), set()).add(i)
    return out


def contaminated(text, windows):
    w = WORDS.findall(fold(text))
    hit, items = set(), set()
    for n in {len(k) for k in windows}:
        for p in range(len(w) - n + 1):
            found = windows.get(tuple(w[p : p + n]))
            if found:
                hit.update(range(p, p + n))
                items |= found
    return len(w), len(hit), sorted(map(str, items))


@pytest.fixture(scope="module")
def items(spark, corpus):
    long = WORDS.findall(fold(corpus[84][1]))
    rows = [(1, " ".join(long[5:17]).upper()), (2, " ".join(long[40:44])), (3, " ".join(long[40:44])), (4, None), (5, ""), (6, "not there at all"), (7, corpus[45][1]), (8, "one")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination(docs, no_docs, corpus, items):
    rows, benchmark = items
    windows = windows_of(rows)
    want = sorted(((i, *contaminated(t, windows)) for i, t in corpus), key=str)
    got = decontaminate.contamination(docs, benchmark).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(map(str, r.item_ids))) for r in got), key=str) == want
    assert all(r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, r.item_ids))).encode()).hexdigest() and r.contaminated == (r.n_hit > 0) for r in got)
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    assert clean.count() == sum(1 for r in got if not r.contaminated)
    assert decontaminate.contamination(no_docs, benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())


def shingles(text, n):
    w = SPACED.findall(fold(text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(corpus, n, percent=80):
    rows = [(i, shingles(t, n)) for i, t in corpus if i is not None]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(rows):
        for j, t in rows[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, no_docs, corpus, n):
    want = brute_components(corpus, n)
    got = neardup.near_duplicates(docs, shingle=n).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    assert sorted(str((r.doc_id, r.n_shingles)) for r in got) == sorted(str((i, len(shingles(t, n)))) for i, t in corpus)
    assert neardup.near_duplicates(no_docs).count() == 0
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns


def test_near_duplicates_of_chained_variants(spark):
    """A chain of edits: neighbours are linked, ends are not, and stars alone would miss links."""
    rng = np.random.default_rng(3)
    text = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(120):
        for _ in range(rng.integers(1, 4)):
            text[rng.integers(0, 100)] = f"v{rng.integers(0, 10_000)}"
        rows.append((int(1000 - i * 3), " ".join(text)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, 4)


def test_repeated_passages(docs, no_docs, corpus):
    first = {}
    for i, t in corpus:
        w = SPACED.findall(t or "")
        for p in range(len(w) - 49):
            if i is not None:
                key = tuple(w[p : p + 50])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, t in corpus:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = substrings.repeated_passages(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == sorted(want, key=str)
    assert all(sum(s.e - s.s for s in r.removed) == r.n_removed for r in got)
    digests = substrings.repeated_passages(docs, texts=False).collect()
    assert sorted((str(r.doc_id), r.kept_sha256) for r in digests) == sorted((str(w[0]), hashlib.sha256(w[3].encode()).hexdigest()) for w in want)
    assert substrings.repeated_passages(no_docs).count() == 0
    copied = substrings.factors(docs).collect()
    text = defaultdict(list)
    for i, t in corpus:
        text[i].append(SPACED.findall(t or ""))
    for r in copied:  # every factor is a copy of its source
        assert r.ref_doc < r.doc_id and r.e - r.s >= 50
        assert any(a[r.s : r.e] == b[r.s - r.shift : r.e - r.shift] for a in text[r.doc_id] for b in text[r.ref_doc])
    assert copied


def kt_tree(train, depth, share, code):
    """Context-tree weighting of one coded bit sequence, by its definition, over dictionaries."""
    counts = defaultdict(Counter)
    for t in train:
        s = bytes(depth) + fold(t).encode() + b"\xff"
        for p in range(depth, len(s)):
            for d in range(depth + 1):
                counts[s[p - d : p]][s[p]] += 1
    total = sum(counts[b""].values())
    kept = {c for c in counts if sum(counts[c].values()) * share >= total or c == b""}
    kept = {c for c in kept if all(c[k:] in kept for k in range(len(c)))}

    def bits(counter):
        out = defaultdict(lambda: [0, 0])
        for b, n in counter.items():
            for level in range(8):
                out[(256 + b) >> (8 - level)][(b >> (7 - level)) & 1] += n
        return out

    def block(n):
        a, b = n
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    children, rest = defaultdict(list), {}
    for c in kept:
        if c:
            children[c[1:]].append(c)
    for c in kept:
        rest[c] = counts[c].copy()
        for x in children[c]:
            rest[c].subtract(counts[x])
    table = {c: bits(counts[c]) for c in kept}
    left = {c: bits(rest[c]) for c in kept}
    memo = {}

    def weighted(c, node):
        if len(c) == depth:
            return block(table[c][node])
        if (c, node) not in memo:
            split = block(left[c][node]) + sum(weighted(x, node) for x in children[c])
            memo[c, node] = np.logaddexp(block(table[c][node]), split) - math.log(2)
        return memo[c, node]

    def one(context, node, c=b""):
        n = table[c][node]
        here = (n[1] + 0.5) / (sum(n) + 1)
        if len(c) == depth:
            return here
        w = math.exp(block(n) - math.log(2) - weighted(c, node))
        longer = context[len(context) - len(c) - 1 :]
        if longer in kept:
            return w * here + (1 - w) * one(context, node, longer)
        m = left[c][node]
        return w * here + (1 - w) * (m[1] + 0.5) / (sum(m) + 1)

    def score(t):
        s = bytes(depth) + fold(t).encode() + b"\xff"
        out = 0.0
        for p in range(depth, len(s)):
            for level in range(8):
                q = one(s[p - depth : p], (256 + s[p]) >> (8 - level))
                out += math.log10(q if (s[p] >> (7 - level)) & 1 else 1 - q)
        return out

    return score


def test_scores_of_the_context_tree(spark, docs, no_docs, corpus):
    few = [(i, t) for i, t in corpus if t is None or len(t) < 600]
    rows = spark.createDataFrame(few, "doc_id long, text string")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = ctw.score_texts(rows, learn, depth=2, share=300, head=16).collect()
    train = [t for i, t in few if i is not None and zlib.crc32(str(i).encode()) % 10]
    score = kt_tree(train, 2, 300, None)
    c = Counter(w for t in train for w in [*SPACED.findall(fold(t)), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in few:
        w = [*SPACED.findall(fold(t)), None]
        want.append((str(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6), i is None or zlib.crc32(str(i).encode()) % 10 == 0))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.held_out) for r in got) == sorted(want)
    model = {}
    for r in got:
        if r.doc_id is not None and r.doc_id % 7 == 0:
            model[r.doc_id] = r.score
    assert model
    texts = dict(few)
    for i, s in model.items():
        if i not in (50, 96):
            assert s == pytest.approx(score(texts[i]), rel=1e-4), i
    assert ctw.score_texts(no_docs, learn).count() == 0
    assert ctw.score_texts(docs.limit(3), F.lit(False)).count() == 3


def test_codes_of_long_texts_come_in_slices(monkeypatch):
    data = np.random.default_rng(1).integers(0, 255, 1000).astype(np.uint8)
    at = np.array([0, 1000])
    want, _ = ctw.byte_codes(data, at, 5)
    for size in (7, 100, 999, 1000, 1001):
        monkeypatch.setattr(ctw, "_RUN", size)
        runs = list(ctw.code_runs(data, at, 5))
        assert (np.concatenate([c for _, c in runs]) == want).all() and all(len(c) <= max(size, 1) or size >= 1000 for _, c in runs)


def test_rare_contexts_stay_in_the_tree_of_a_large_corpus(spark, monkeypatch):
    monkeypatch.setattr(ctw, "_CHUNK", 50)
    train = ["abcdefgh qrstuv", "abcdefgh qrstuv", "xyzzy"] + ["the cat sat on the mat again %d" % (k % 7) for k in range(4000)]
    held = "abcdefgh qrstuv xyzzy mat, never seen"
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(train)] + [(-1, held)], "doc_id long, text string")
    want = kt_tree(train, 4, sum(len(t) + 1 for t in train) / ctw.LEAST, None)
    got = {r.doc_id: r.score for r in ctw.score_texts(rows, F.col("doc_id") >= 0, depth=4, head=40).collect()}
    for i in (-1, 0, 2, 3):
        assert got[i] == pytest.approx(want(held if i < 0 else train[i]), rel=1e-6), i


def test_distribution_of_the_tree_sums_to_one():
    rng = np.random.default_rng(2)
    contexts = [np.zeros(1, np.int64), np.array([97, 98]), np.array([97 * 256 + 97])]
    counts = [rng.integers(0, 50, (len(c), 256)).astype(float) for c in contexts]
    counts[1] = np.minimum(counts[1], counts[0] // 2)
    counts[2] = np.minimum(counts[2], counts[1][:1])
    tree = ctw.Tree(2, contexts, counts)
    assert np.allclose((10.0 ** tree.logs.reshape(-1, 256).astype(float)).sum(axis=1), 1, atol=1e-4)


def test_quality_network(spark, docs, no_docs):
    rng = np.random.default_rng(4)
    good = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(rng.integers(5, 200)))
    bad = lambda: " ".join("".join(rng.choice(list("ab"), 4)) + "$$$" for _ in range(rng.integers(5, 200)))
    rows = [(k, (good if k % 3 else bad)()) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    network = quality.fit(table, labels, F.col("doc_id") % 2 == 0)
    held = [r for r in quality.scores(table, network).collect() if r.doc_id % 2]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    out = quality.scores(docs, network).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    kept = quality.keep_good(docs, network)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    assert quality.scores(no_docs, network).count() == 0
    again = quality.fit(table, labels, F.col("doc_id") % 2 == 0)
    assert np.array_equal(network.table, again.table)


def test_network_against_a_naive_convolution():
    rng = np.random.default_rng(14)
    net = quality.Network(5, 3)
    net.bias += 0.2
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 7, 128, 129, 300, 1000)]
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    for text, p in zip(texts, got):
        halves = max(2, -(-len(text) // 128))
        data = text + bytes(halves * 128 + 8 - len(text))
        chunks = []
        for h in range(halves - 1):
            top = [max(sum(float(net.table[k, data[q + k], f]) for k in range(8)) for q in range(h * 128, h * 128 + 256, 4)) for f in range(5)]
            chunks.append([max(0.0, x + float(net.bias[f])) for f, x in enumerate(top)])
        columns = list(zip(*chunks))
        feature = [max(c) for c in columns] + [sum(c) / len(c) for c in columns] + [min(c) for c in columns]
        hidden = [max(0.0, sum(x * float(net.inner[k, h]) for k, x in enumerate(feature)) + float(net.inner_bias[h])) for h in range(3)]
        assert p == pytest.approx(1 / (1 + math.exp(-(sum(x * float(net.out[h]) for h, x in enumerate(hidden)) + float(net.shift[0])))), abs=1e-4)


def test_gradients_of_the_network():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 103, rng.integers(1, 600)).astype(np.uint8)) for _ in range(5)]
    windows, first = quality._rows(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    net = quality.Network(4, 3)
    net.bias += 0.5
    label, weight = np.array([0.0, 1, 0, 1, 1]), np.ones(5)
    at = np.append(0, np.cumsum([len(t) for t in texts]))

    def loss():
        p = net.score(np.frombuffer(b"".join(texts), np.uint8), at)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    params = [net.table, net.bias, net.inner, net.inner_bias, net.out, net.shift]
    for p, g in zip(params, net.gradients(windows, first, label, weight)):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[k], 1e-2
        p[k] = old + step
        up = loss()
        p[k] = old - step
        down = loss()
        p[k] = old
        assert (up - down) / (2 * step) == pytest.approx(g[k], rel=0.1, abs=1e-4)


def test_media_round_trip(docs, no_docs, corpus):
    got = media.features(media.store(docs)).collect()
    want = []
    for i, t in corpus:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        file = media.to_wav(payload)
        assert media.from_wav(file) == payload and file[:4] == b"RIFF"
        want.append((str(i), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == sorted(want)
    assert all(int(r.feature.split(":")[0]) == len(r.marks) for r in got)
    assert media.features(media.store(no_docs)).count() == 0


def test_fingerprint_against_brute_force():
    rng = np.random.default_rng(13)
    x = bytes(rng.integers(32, 122, 1500).astype(np.uint8))
    frames = 1 + -(-(len(x) - media.FRAME) // media.STEP)
    padded = np.append(np.frombuffer(x, np.uint8), np.zeros((frames - 1) * media.STEP + media.FRAME - len(x)))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / media.FRAME) for k in range(media.FRAME)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    level = np.array([abs(turn @ ((padded[f * media.STEP :][: media.FRAME] - 128) * window)) ** 2 for f in range(frames)])
    strongest = {}
    for f in range(frames):
        for b in range(len(media.BANDS) - 1):
            strongest[f, b] = max(range(media.BANDS[b], media.BANDS[b + 1]), key=lambda k: level[f, k])
    power = lambda f, b: level[f, strongest[f, b]] if 0 <= f < frames else 0
    peak = {(f, b) for f, b in strongest if power(f, b) > level[f, 1:].mean() and power(f, b) >= max(power(f - 1, b), power(f + 1, b))}
    want = sorted((f, strongest[f, b] << 10 | strongest[g, c] << 2 | (g - f)) for f, b in peak for g, c in peak if 1 <= g - f <= media.REACH and c - b in (0, 1))
    time, code = media.fingerprint(x)
    assert list(zip(time.tolist(), code.tolist())) == want and want


def test_spectral_peaks_of_a_tone():
    t = np.arange(8192)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 20 / media.FRAME)).astype(np.uint8).tobytes()
    bins, peak = media.peaks(tone)
    assert (bins[5:-5, 1] == 20).all()
    shifted = media.fingerprint(bytes([128]) * (4 * media.STEP) + tone)
    plain = media.fingerprint(tone)
    assert set(plain[1].tolist()) & set(shifted[1].tolist())


def test_transducer_against_all_paths():
    pieces_ = [(0, b"a", 5), (1, b"b", 5), (2, b"ab", 7), (3, b"ba", 6), (4, b" a", 8), (5, b" ", 4), (6, b"abb", 9), (7, b"  ", 5)]
    fst = pieces.Transducer(pieces_, list(range(100, 356)), 40)
    cost = {i: c for i, _, c in pieces_}
    spelt = {i: b for i, b, _ in pieces_}

    def best(s):
        table = [0] + [10**9] * len(s)
        for k in range(1, len(s) + 1):
            for i, b, c in pieces_:
                if s[:k].endswith(b):
                    table[k] = min(table[k], table[k - len(b)] + c)
            table[k] = min(table[k], table[k - 1] + 40)
        return table[-1]

    rng = np.random.default_rng(8)
    texts = [bytes(rng.choice(list(b"ab c\n"), rng.integers(0, 30))) for _ in range(200)]
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    ids, counts, paid = fst.encode(np.frombuffer(b"".join(texts), np.uint8), at)
    first = np.append(0, np.cumsum(counts))
    for k, t in enumerate(texts):
        mine = ids[first[k] : first[k + 1]].tolist()
        assert b"".join(spelt.get(i, bytes([i - 100]) if i >= 100 else b"") for i in mine) == b" " + t
        assert sum(cost.get(i, 40) for i in mine) == paid[k] == best(b" " + t)
    back, b = fst.decode(ids, counts)
    assert back.tobytes() == b"".join(texts) and (b == at).all()


def test_long_parts_are_walked_to_the_same_paths(monkeypatch):
    machine = pieces.compiled()
    text = np.frombuffer(("ab" * 700 + " cd " + "東京" * 800 + "x" * 3000).encode(), np.uint8)
    at = np.array([0, 10, 10, len(text)])
    monkeypatch.setattr(pieces, "LONG", 1 << 30)
    whole = machine.encode(text, at)
    monkeypatch.setattr(pieces, "LONG", 40)
    for one, two in zip(whole, machine.encode(text, at)):
        assert (one == two).all()
    monkeypatch.setattr(pieces, "RUN", 100)
    for one, two in zip(whole, machine.encode(text, at)):
        assert (one == two).all()


def test_encoding_round_trip(docs, no_docs, corpus):
    import sentencepiece

    got = pieces.encoded(docs).cache()
    rows = got.collect()
    assert len(rows) == len(corpus) and all(r.exact and r.n_ids == len(r.ids) for r in rows)
    texts = Counter(t or "" for _, t in corpus)
    assert Counter(r.text for r in pieces.decoded(got).collect()) == texts
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert Counter(library.decode(r.ids) for r in rows if r.n_ids < 5000) <= texts
    odd = docs.sparkSession.createDataFrame([(1, "▁ a ▁▁b\u0000\t\n 😀  ")], "doc_id long, text string")
    assert pieces.encoded(odd).first().exact
    assert pieces.encoded(no_docs).count() == 0


def brute_pii(text):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d)))
            return 12 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    spans = sorted((m.start(), o, k, m.end()) for o, (k, p) in enumerate(base.items()) for m in re.finditer(p, text or "") if valid(k, m[0]))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


PRIVATE = [
    "", None, "mail é😀 a.b@c.de, x@y.z_q@r.st a@b.c.d.e@f.g", "4111 1111 1111 1111 and 4111111111111112 5500-0000-0000-0004", "1.2.3.4.5.6.7.8 999.1.1.1 1.2..3.4.5.6 001.002.003.004",
    "+1 (555) 123-4567 +12 +44 20 7946 0958.", "x" * 50_000, "1" * 50_000, "a@" + "b." * 5_000 + "c", "@" * 1000, "+" * 1000 + "1 23456789", "é" * 100 + " q@w.er " + "1.1.1.1",
]


def test_personal_data(spark, no_docs):
    rows = [(k, t) for k, t in enumerate(PRIVATE)] + [(2, PRIVATE[2]), (None, PRIVATE[5])]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == sorted((str(i), brute_pii(t)) for i, t in rows)
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in got)
    assert pii.personal_data(no_docs).count() == 0


def test_disclosing_terms(spark):
    plain = [(k, f"the usual words of every day number{k} and so on") for k in range(60)]
    told = [(100 + k, f"the usual words, Zanzibar office of every day: boss@corp.example, item{k}") for k in range(4)]
    clean = [(200, "Zanzibarfest is something else"), (201, "words of every day")]
    docs = spark.createDataFrame(plain + told + clean, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    for k in range(4):
        text = dict(told)[100 + k]
        at = text.index("Zanzibar")
        assert f"term_remove:{at}:{at + 8}" in spans[100 + k] and "usual" not in spans[100 + k]
        s = text.index("usual")
        assert f":{s}:" not in spans[100 + k]
    assert spans[200] == spans[201] == "" and not any(spans[k] for k in range(60))
    new = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "Zanzibar" not in new[100] and "[EMAIL]" in new[100] and "@" not in new[100]
    assert new[200] == "Zanzibarfest is something else" and new[5] == dict(plain)[5]


def brute_disclosure(texts):
    """The added spans of each text, by the definition of the measure."""
    texts = {t or "" for t in texts} - {""}
    n = len(texts)
    base = {t: [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in brute_pii(t).split(",") if s] for t in texts}

    def entities(t):
        out = set()
        for kind, s, e in base[t]:
            v = t[s:e].lower()
            d = re.sub("[^0-9]", "", v)
            owner = {"email": v.split("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": d[:6], "phone": d[:4]}[kind]
            out |= {("value", kind, d if kind in ("card", "phone") else v), ("owner", kind, owner), "any"}
        return out

    def named(t, beside):
        for m in re.finditer(r"[^\W_]+", t):
            if not (beside and any(s < m.end() and m.start() < e for _, s, e in base[t])):
                w = m[0].lower()
                yield m, w
                if len(w) >= 12 and any(c.isdigit() for c in w):
                    yield m, ("x" if any(c.isalpha() for c in w) else "n", len(w))

    df_t, df_e, df_te = Counter(), Counter(), Counter()
    for t in texts:
        df_t.update({w for _, w in named(t, False)})
        df_e.update(entities(t))
        df_te.update({(e, w) for e in entities(t) for _, w in named(t, True)})

    def share(e, w):
        k, m, z = df_te[e, w], df_t[w], pii.Z
        if k < 2 or df_e[e] in (1, n):
            return None
        low = (k / m + z * z / 2 / m - z * math.sqrt(k / m * (1 - k / m) / m + z * z / 4 / m / m)) / (1 + z * z / m)
        of = lambda p: math.log(p * n / df_e[e]) / math.log(n / df_e[e])
        return of(k / m) if low > 0 and of(low) >= pii.GENERALISE else None

    out = {}
    for t in texts:
        spans = {}
        for m, w in named(t, True):
            found = [x for x in (share(e, w) for e in entities(t)) if x is not None]
            if found:
                spans[m.span()] = max(spans.get(m.span(), 0), max(found))
        out[t] = sorted((s, e, "term_remove" if x >= pii.REMOVE else "term_general") for (s, e), x in spans.items())
    return out


def test_disclosure_against_brute_force(spark):
    rng = np.random.default_rng(12)
    words = [f"w{k}é" if k % 3 else f"Wort{k}" for k in range(60)]
    rows = []
    for k in range(150):
        w = list(rng.choice(words[:40], rng.integers(3, 30)))
        if k % 5 == 0:
            w += [f"a{rng.integers(0, 9)}@mail{rng.integers(0, 3)}.example.org", *rng.choice(words[40:50], 2)]
        if k % 7 == 0:
            w += [f"10.{rng.integers(0, 3)}.7.{rng.integers(0, 3)}", "token", f"{rng.integers(10**15, 10**16):x}".zfill(16)]
        if k in (1, 12):
            w.append(words[55])
        if k % 11 == 0:
            w += ["+1 (555) 010-99", str(rng.integers(10, 99)), words[55]]
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
    rows += [(200 + k, t) for k, t in rows[:20]] + [(300, None), (301, ""), (None, rows[0][1])]
    want = brute_disclosure([t for _, t in rows])
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = Counter((str(i), t) for i, t in rows)
    assert len(got) == sum(texts.values())
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t or "")
    for r in got:
        mine = sorted((s.start, s.end, s.kind) for s in r.span_list if s.kind.startswith("term"))
        assert mine == want.get(by_id[r.doc_id][0], []), r.doc_id
    kinds = Counter(s.kind for r in got for s in r.span_list)
    assert kinds["term_general"] and kinds["term_remove"]


def test_sanitised_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a@b.org now", "q", 3, 16), (2, None, None, None, None), (2, None, None, None, None), (None, "", "w", 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `x.y` string, spans int, n_chars long").withColumnRenamed("spans", "__spans").withColumn("new", F.lit(5)).withColumn("row", F.lit("r")).withColumn("th", F.lit("t"))
    out = pii.sanitised(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.select("text", "`x.y`", "__spans", "n_chars", "row", "th").collect())) == sorted(
        map(str, spark.createDataFrame([("mail [EMAIL] now", "q", 3, 16, "r", "t"), (None, None, None, None, "r", "t"), (None, None, None, None, "r", "t"), ("", "w", 1, 0, "r", "t")], "text string, `x.y` string, __spans int, n_chars long, row string, th string").collect())
    )


def test_short_and_distant_and_numeric_terms_disclose(spark):
    plain = [(k, f"the usual words of every day number{k} and so on") for k in range(60)]
    told = [(100 + k, f"Li 48151623 {'the usual words of every day ' * 9}and so on, boss@corp.example, item{k}") for k in range(4)]
    docs = spark.createDataFrame(plain + told + told[:2] + [(300 + k, t) for k, t in told], "doc_id long, text string")
    rows = pii.personal_data(docs).collect()
    assert len(rows) == 70
    for r in rows:
        if r.doc_id < 100:
            assert r.spans == ""
        else:
            assert r.n_term == 2 and r.spans.startswith("term_remove:0:2,term_remove:3:11,email:")


def test_patience_alignment():
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    assert licenses.patience(list("xabycz"), list("abc")) == [(1, 0), (2, 1), (4, 2)]
    rng = np.random.default_rng(9)
    for _ in range(200):
        a, b = (rng.integers(0, 8, rng.integers(0, 15)).tolist() for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert licenses.patience(a, a) == [(k, k) for k in range(len(a))]


def test_license_scan(spark, docs, no_docs, corpus):
    mit = licenses.TEXTS["mit"]
    filler = "lorem ipsum the of to a " * 200
    rows = [(1, filler + mit.upper() + filler), (2, mit[: len(mit) // 2]), (3, licenses.TEXTS["mit-line"] + filler + licenses.TEXTS["mit-line"]), (4, None), (5, mit.replace("Software", "Library")), (None, "all rights reserved")]
    rows += corpus
    templates = {k: licenses.license_words(v) for k, v in licenses.TEXTS.items()}
    want = sorted((str(i), *r) for i, t in rows for r in licenses.scan(licenses.license_words(t or ""), templates, licenses.COVERAGE))
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license, r.n_aligned, r.first_word, r.end_word, r.occurrences) for r in got) == want
    found = {(str(r.doc_id), r.license): r for r in got}
    assert found["1", "mit"].coverage == 1 and found["3", "mit-line"].occurrences == 2 and ("5", "mit") in found and ("2", "mit") not in found
    assert licenses.licenses(no_docs).count() == 0


def test_a_license_span_goes_to_one_template(spark):
    """Every whole text is found as itself alone, and texts that stand side by side are all found."""
    filler = " lorem ipsum dolor sit amet" * 30
    rows = [(k, filler + " " + t + filler) for k, t in enumerate(licenses.TEXTS.values())]
    rows += [(1000, filler.join(licenses.TEXTS[k] for k in ("mit", "bsd-3-clause", "bsd-2-clause", "gpl-2.0-notice", "gpl-2.0-notice")))]
    rows += [(1001, licenses.TEXTS["gpl-2.0-notice"].replace("software:", "software;"))]
    got = {(r.doc_id, r.license): r for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k in got if k[0] < 1000} == set(enumerate(licenses.TEXTS))
    assert all(r.coverage > 0.95 for r in got.values())  # patience leaves a gap of words that none is unique in
    assert {k[1] for k in got if k[0] == 1000} == {"mit", "bsd-3-clause", "bsd-2-clause", "gpl-2.0-notice"} and got[1000, "gpl-2.0-notice"].occurrences == 2
    assert {k[1] for k in got if k[0] == 1001} == {"gpl-2.0-notice"}
    assert licenses.best_spans([(9, 0.9, 0, 10, "b"), (9, 0.9, 0, 10, "a"), (5, 1.0, 8, 13, "c"), (5, 1.0, 9, 14, "a")]) == [(9, 0.9, 0, 10, "a"), (5, 1.0, 8, 13, "c")]


def test_fixity_audit(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}</p>" * (k % 5)) for k in range(9000)] + [(3, "again", None), (None, None, "x")], "page_id long, url string, html string")
    assert warc.fixity(pages, pages.orderBy(F.rand(3))).filter("kind <> 'root' or not (hash_a <=> hash_b)").count() == 0
    other = pages.filter("page_id is null or page_id not in (17, 4096)").withColumn("html", F.when(F.col("page_id") == 8999, "y").otherwise(F.col("html"))).union(spark.createDataFrame([(20_000, "n", "n")], pages.schema))
    rows = warc.fixity(pages, other)
    assert sorted((r.kind, r.page_id) for r in rows.filter("kind <> 'root'").collect()) == [("changed", 8999), ("extra", 20_000), ("missing", 17), ("missing", 4096)]
    one = rows.filter("page_id = 17").first()
    before = pages.filter("page_id < 17").select(F.sum(F.octet_length(warc.record(F.col("url"), F.col("html"))))).first()[0]
    assert one.offset == before
    assert warc.fixity(pages.limit(0), pages.limit(0)).count() == 0
    assert warc.fixity(pages.limit(0), pages).filter("kind = 'extra'").count() == 9001


def test_each_damaged_record_is_one_row(spark):
    """Negative ids, records without an id, and an id with very many bodies."""
    pages = spark.createDataFrame([(k, f"u{k}", "x") for k in [-5000, -3, -2, -1, 0, 1, 2, 3, 4096]] + [(None, None, "x"), (None, "n", "y")], "page_id long, url string, html string")
    bodies = spark.range(10_000).select(F.lit(7).cast("long").alias("page_id"), F.lit("h").alias("url"), F.concat(F.lit("body"), "id").alias("html"))
    pages = pages.union(bodies)
    assert warc.fixity(pages, pages.repartition(3)).filter("kind <> 'root' or not (hash_a <=> hash_b)").count() == 0
    hit = (F.col("page_id").isNull() | F.col("page_id").isin(-5000, -3, -1, 0, 3, 7)) & F.col("html").isin("x", "body5000")
    rows = warc.fixity(pages, pages.withColumn("html", F.when(hit, "!").otherwise(F.col("html")))).filter("kind <> 'root'").collect()
    assert sorted((r.kind, str(r.page_id)) for r in rows) == sorted(("changed", str(k)) for k in (-5000, -3, -1, 0, 3, 7, None))
    gone = warc.fixity(pages, pages.filter("page_id >= -2")).filter("kind <> 'root'").collect()
    assert sorted((r.kind, str(r.page_id)) for r in gone) == [("missing", "-3"), ("missing", "-5000"), ("missing", "None")]


def test_many_terms_beside_many_entities(spark):
    """Thousands of terms beside hundreds of addresses in the same texts are one class beside another."""
    import time

    shared = " ".join(f"user{k}@host{k}.example.org word{k}a word{k}b word{k}c word{k}d word{k}e" for k in range(800))
    rows = [(1, shared), (2, shared + " end")] + [(k, f"plain text number {k}") for k in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pii.personal_data(docs.limit(1)).count()
    began = time.time()
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert got[1]["n_email"] == 800 and got[3]["n_term"] == 0
    assert time.time() - began < 60
    holds = pii.entities(pii.distinct_texts(pii._keyed(docs)))
    assert pii.disclosing(pii.distinct_texts(pii._keyed(docs)), holds, z=0.0).count() >= 8000
