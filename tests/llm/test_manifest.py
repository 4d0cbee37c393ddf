"""The manifest against trees built in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rolecall.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, path int, at int, leaf string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(made, i):
    out = []
    for level in made[:-1]:
        lo = i // 16 * 16
        out.append((level[lo:i], level[i + 1 : lo + 16]))
        i //= 16
    return out


def expected(rows, changed):
    by = {}
    for r in rows:
        tampered = leaf((*r[:4], r[4].translate(LOWER))) if changed(r[0]) and r[4] is not None else leaf(r)
        by.setdefault(r[1], []).append((r[0], leaf(r), tampered))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    made = {s: levels([x[1] for x in by[s]]) for s in names}
    top = levels([made[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, mine, now) in enumerate(by[s]):
            steps = path(made[s], i) + path(top, k)
            for left, right in steps:
                now = digest(*left, now, *right)
            out.append((doc_id, mine, made[s][-1][0], top[-1][0], digest(*(x for step in steps for side in step for x in side)), now, now == top[-1][0]))
    return sorted(out, key=str)


def documents():
    rows = [(i, f"s{i % 19}" if i % 3 else "hot", "en", i, f"Text {i} É") for i in range(1200)]
    rows += [(i, f"alone{i}é", None, None, None) for i in range(5000, 5015)]
    rows += [(i, "seventeen", "de", -i, "") for i in range(6000, 6017)]
    rows += [(7000, None, "en", 3, "A"), (7001, "", "en", 3, "A"), (None, "hot", "en", 1, "N"), (None, "hot", "en", 1, "O"), (5, "s5", "en", 5, "other"), (8000, "x" * 3000, "en", 1, "L" * 100_000)]
    return rows + [rows[0]] * 40 + [rows[7]] * 2


@pytest.mark.parametrize("rows", [documents(), documents()[:1], documents()[:16], documents()[-6:]], ids=["many", "one", "sixteen", "repeats"])
def test_against_trees(spark, rows):
    docs = spark.createDataFrame([(*r, "t", 1, 2, "l") for r in rows], SCHEMA).repartition(5)
    got = manifest.audited(docs, F.col("doc_id") % 5 == 0)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.columns == names
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, lambda i: i is not None and i % 5 == 0)


def test_some_requests(spark):
    """Proofs of a few leaves, without those of others; a changed sibling breaks them."""
    docs = spark.createDataFrame([(*r, "t", 1, 2, "l") for r in documents()], SCHEMA)
    made = manifest.manifest(manifest.leaves(docs))
    few = made.leaves.filter("doc_id in (3, 40, 5003)").select("tree", "place", "doc_id", "digest")
    got = manifest.proofs(made, few).select("doc_id", (manifest.folded(F.col("digest"), F.col("path")) == made.root).alias("ok"), F.size("path").alias("steps"))
    assert sorted(map(tuple, got.collect())) == [(3, True, 5), (40, True, 4), (5003, True, 2)]
    broken = manifest.proofs(made, few).select((manifest.folded(F.lit("0"), F.col("path")) == made.root).alias("ok"))
    assert broken.filter("ok").count() == 0


def test_no_documents(spark):
    got = manifest.audited(spark.createDataFrame([], SCHEMA), F.lit(True))
    assert got.count() == 0
