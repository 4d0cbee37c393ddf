"""Training-set preparation: contamination, categories, pairs, negatives, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scores, text
from ..functions.lineage import cut
from .linking import nearest_window


def content_hash(t: Column) -> Column:
    return F.sha2(F.coalesce(t, F.lit("")), 256)


def exact_contamination(documents: DataFrame, held_out: DataFrame) -> DataFrame:
    """Documents whose text equals a held-out text."""
    h = held_out.select(content_hash(F.col("text")).alias("h")).distinct()
    return documents.withColumn("h", content_hash(F.col("text"))).join(h, "h", "left_semi").drop("h")


def _hashed(rows: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """(key, size, x, y): two hashes of each distinct shingle, with how many there are.

    The outer form, as Spark would else make all shingles once more, in a filter on their number.
    """
    s = rows.select(key, text.lower_words(F.col("text")).alias("w")).select(key, text.shingles(F.col("w"), n).alias("s"))
    return s.select(key, F.size("s").alias(size), F.explode_outer("s").alias("s")).filter("s is not null").select(key, size, F.xxhash64("s").alias("x"), F.xxhash64(F.lit(1), "s").alias("y"))


def best_overlap(documents: DataFrame, held_out: DataFrame, n: int = C.NGRAM) -> DataFrame:
    """(doc_id, item_id, jaccard): for each document that shares a shingle with a held-out
    text, the one most like it, ties to the smaller id.

    Shingles are hashed, counted on each side and joined; only shared ones travel on.
    """
    dx, hx = _hashed(documents, "doc_id", "nd", n), _hashed(held_out, "item_id", "nh", n)
    both = dx.join(hx, ["x", "y"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("c"), F.first("nd").alias("nd"), F.first("nh").alias("nh"))
    j = both.select("doc_id", "item_id", (F.col("c") / (F.col("nd") + F.col("nh") - F.col("c"))).alias("jaccard"))
    return j.groupBy("doc_id").agg(F.max_by("item_id", F.struct("jaccard", -F.col("item_id"))).alias("item_id"), F.max("jaccard").alias("jaccard"))


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, level): every ancestor of every node of edges (child, parent), and how far up it is.

    Of several parents the first counts (by ``ord``, if there, then by name), so each
    node has one way up.  Paths are doubled: those of the longest length are joined
    with all, so d levels take log2(d) joins.  In a cycle the shortest way counts,
    and no node is its own ancestor.
    """
    order = F.struct(*(c for c in ("ord", "parent") if c in edges.columns))
    up = edges.filter("child is not null and parent is not null and child <> parent").groupBy("child").agg(F.min_by("parent", order).alias("parent"))
    reach = cut(up.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("level")))
    step = 1
    while True:
        far = reach.filter(F.col("level") == step).withColumnRenamed("ancestor", "at")
        beyond = reach.select(F.col("node").alias("at"), "ancestor", F.col("level").alias("more"))
        longer = cut(far.join(beyond, "at").filter("node <> ancestor").select("node", "ancestor", (F.col("level") + F.col("more")).alias("level")))
        if longer.isEmpty():
            return reach
        reach = cut(reach.union(longer).groupBy("node", "ancestor").agg(F.min("level").alias("level")))
        step *= 2


def ancestors(edges: DataFrame, targets: DataFrame, hops: int = 10) -> DataFrame:
    """(node, ancestor, depth): the first node of ``targets`` (node) on the way up from each
    child, along the first parent, within ``hops`` and without cycles."""
    met = closure(edges).filter(F.col("level") <= hops).join(targets.select(F.col("node").alias("ancestor")).distinct(), "ancestor", "left_semi")
    return met.groupBy("node").agg(F.min_by("ancestor", "level").alias("ancestor"), F.min("level").alias("depth"))


def dominant_category(skills: DataFrame, categories: DataFrame, fallback: str = "__no_skills__") -> DataFrame:
    """(cv_id, category): the most frequent category of a document's concepts, the first by name of equals."""
    known = skills.join(categories, "uri", "left").groupBy("cv_id", "category").agg(F.count("category").alias("n"))
    w = Window.partitionBy("cv_id").orderBy(F.desc("n"), F.asc_nulls_last("category"))
    return known.withColumn("r", F.row_number().over(w)).filter("r = 1").select("cv_id", F.coalesce("category", F.lit(fallback)).alias("category"))


def seeded(key: Column, seed: int) -> Column:
    """A hash order that stands for a shuffle, the same in every run and at every partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def placed(rows: DataFrame, category: str, h: str, key: str) -> DataFrame:
    """``rows`` with ``place`` (from 0) in the order of a hash column within their category, and its ``size``.

    Places are counted within each of 4,096 ranges of the hash, and the ranges are
    summed up, so that a category of most rows is ranked by many tasks.
    """
    at = rows.withColumn("_range", F.substring(h, 1, 3))
    counts = at.groupBy(F.col(category).alias("_c"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_c")
    counts = counts.select("_c", "_r", (F.sum("_n").over(w.orderBy("_r")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("size"))
    own = F.row_number().over(Window.partitionBy(category, "_range").orderBy(h, key)) - 1
    met = at.withColumn("_own", own).join(counts, F.col(category).eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")))
    return met.withColumn("place", (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_c", "_r", "_before")


def stratified_split(rows: DataFrame, key: str, category: str, fraction: float, seed: int = 0) -> DataFrame:
    """``rows`` with ``split``: of each category the first max(1, floor(n f)) in hash order validate; a lone member trains."""
    ranked = placed(rows.withColumn("h", seeded(F.col(key), seed)), category, "h", key)
    held = (F.col("size") >= 2) & (F.col("place") < F.greatest(F.lit(1), F.floor(F.col("size") * fraction)))
    return ranked.select(*rows.columns, F.when(held, "val").otherwise("train").alias("split"))


def sampled(rows: DataFrame, by: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """The k rows of each stratum that are first in hash order, numbered by ``draw``: the same at any
    partitioning.  Spark keeps k rows of a stratum in each task before it shuffles them."""
    w = Window.partitionBy(*by).orderBy(seeded(F.col(key), seed), key)
    return rows.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= k)


def sampled_similarity(rows: DataFrame, vectors: DataFrame, by: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """(*by, key, similarity): the cosine of anchor and concept (columns ``anchor``, ``uri``; ``vectors``:
    name, vec, unit length) in a sample of each stratum; only what is drawn meets its vectors."""
    v = lambda a, b: vectors.select(F.col("name").alias(a), F.col("vec").alias(b))
    both = sampled(rows, by, key, k, seed).join(v("anchor", "va"), "anchor").join(v("uri", "vu"), "uri")
    return both.select(*by, key, scores.dot(F.col("va"), F.col("vu")).alias("similarity"))


def positive_pairs(spans: DataFrame, windows: DataFrame, floor: float) -> DataFrame:
    """(doc_id, span, uri, window): confident spans (doc_id, span, uri, s, e, confidence) with each window
    (doc_id, window, w0, w1) that covers them, or else the nearest."""
    sure = spans.filter(F.col("confidence") >= floor)
    return sure.select("doc_id", "span", "uri").join(nearest_window(sure.select("doc_id", "span", "s", "e"), windows), ["doc_id", "span"])


def siblings(concepts: DataFrame) -> DataFrame:
    """(uri, sibling, category) of concepts with one category."""
    other = concepts.select(F.col("uri").alias("sibling"), "category")
    return concepts.select("uri", "category").join(other, "category").filter("uri <> sibling")


def hash_ring(concepts: DataFrame, seed: int = 0) -> DataFrame:
    """(uri, category, place, size, spot, total): each concept's place in the hash order of
    its category, and in that of all.

    Places among all are counted within each of 4,096 ranges of the hash, and the
    ranges, not the concepts, are summed up in order.
    """
    h = concepts.select("uri", "category").distinct().withColumn("h", seeded(F.col("uri"), seed)).withColumn("part", F.substring("h", 1, 3))
    parts = h.groupBy("part").agg(F.count("*").alias("n"))
    every = Window.orderBy("part")
    parts = parts.select("part", (F.sum("n").over(every) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ring = placed(h, "category", "h", "uri")
    ring = ring.withColumn("spot", F.row_number().over(Window.partitionBy("part").orderBy("h", "uri")) - 1).join(F.broadcast(parts), "part")
    return ring.select("uri", "category", "place", F.when(F.col("category").isNull(), 1).otherwise(F.col("size")).alias("size"), (F.col("spot") + F.col("before")).alias("spot"), "total")


def _steps(rows: DataFrame, own: str, size: str, count: int) -> DataFrame:
    """``rows`` with ``k`` and ``at``: up to ``count`` places of a ring of ``size`` that follow a place
    which ``first`` chooses; the row's own place is never met."""
    rest = F.col(size) - 1
    steps = F.explode(F.sequence(F.lit(0), F.least(F.lit(count), rest) - 1)).alias("k")
    return rows.filter(rest > 0).select("*", steps).withColumn("at", F.pmod(F.col(own) + 1 + F.pmod(F.col("first") + F.col("k"), rest), F.col(size)))


def _followers(ring: DataFrame, n: int) -> DataFrame:
    """(category, at, next): the n concepts from each place of a category's ring on, in ring order."""
    step = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    each = ring.select("category", "uri", "place", "size", step).select("category", F.pmod(F.col("place") - F.col("k"), F.col("size")).alias("at"), F.struct("k", "uri").alias("c"))
    return each.groupBy("category", "at").agg(F.array_sort(F.collect_list("c"))["uri"].alias("next"))


def hard_negatives(positives: DataFrame, concepts: DataFrame, n: int = 3, seed: int = 0, known: DataFrame | None = None) -> DataFrame:
    """(pair_id, uri, negative, strategy, rank): n other concepts for each positive: its known
    false positive (``known``: pair_id, negative) if there is one, then siblings of the same
    category, then any others.  There are fewer only where the taxonomy has no more.

    Categories and the whole taxonomy are put in hash order once; a positive takes the
    concepts that follow a place of its own in those rings, so no group is multiplied out.
    Every place of a ring knows what follows it, so a positive is one row that meets one
    row; only positives of categories too small for n siblings look up one by one.
    A concept without a category has no siblings; a positive of no known concept gets no rows.
    """
    ring = cut(hash_ring(concepts, seed))
    number = F.conv(F.substring(seeded(F.col("pair_id"), seed), 1, 8), 16, 10).cast("long")
    met = lambda rows: positives.select("pair_id", "uri").join(rows, "uri").withColumn("first", number)
    item = lambda o, k, uri: F.struct(F.lit(o).alias("o"), F.col(k).cast("int").alias("k") if isinstance(k, str) else k.cast("int").alias("k"), uri.alias("negative"))
    large, small = ring.filter(F.col("size") > n), ring.filter(F.col("size") <= n)
    at = F.pmod(F.col("place") + 1 + F.pmod("first", F.col("size") - 1), F.col("size"))
    p = met(large.select("uri", "category", "place", "size")).select("pair_id", "uri", "category", at.alias("at")).join(_followers(large, n + 1), ["category", "at"])
    others = F.slice(F.filter("next", lambda u: u != F.col("uri")), 1, n)
    rows = p.select("pair_id", "uri", F.transform(others, lambda u, k: item(1, k, u)).alias("found"))
    if not small.isEmpty():
        p, one = met(small), lambda o: F.array(item(o, "k", F.col("negative"))).alias("found")
        near = _steps(p, "place", "size", n).join(ring.select("category", F.col("place").alias("at"), F.col("uri").alias("negative")), ["category", "at"])
        # among 2 n + 1 others, n at least are neither a sibling taken before nor the known false positive
        any_ = _steps(p, "spot", "total", 2 * n + 1).join(ring.select(F.col("spot").alias("at"), F.col("uri").alias("negative")), "at")
        none = p.select("pair_id", "uri", F.array().cast(rows.schema["found"].dataType).alias("found"))
        rows = rows.unionByName(none).unionByName(near.select("pair_id", "uri", one(1))).unionByName(any_.select("pair_id", "uri", one(2)))
    if known is not None:
        own = F.when(F.col("negative") != F.col("uri"), F.array(item(0, F.lit(0), F.col("negative")))).otherwise(F.array())
        rows = rows.join(known, "pair_id", "left").select("pair_id", "uri", F.concat(own, "found").alias("found"))
    best = rows.groupBy("pair_id", "uri").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    best = best.withColumn("all", F.col("found")["negative"])
    first = F.slice(F.filter("found", lambda c, i: F.array_position(F.col("all"), c["negative"]) == i + 1), 1, n)
    ranked = best.select("pair_id", "uri", F.posexplode(first).alias("k", "c"))
    strategy = F.when(F.col("c.o") == 0, "known").when(F.col("c.o") == 1, "sibling").otherwise("any")
    return ranked.select("pair_id", "uri", F.col("c.negative").alias("negative"), strategy.alias("strategy"), (F.col("k") + 1).alias("rank"))


def pairs(positives: DataFrame, texts: DataFrame) -> DataFrame:
    """(pair_id, anchor, positive): positives (pair_id, anchor, uri) whose concept has a text."""
    return positives.join(texts, "uri").select("pair_id", "anchor", F.col("text").alias("positive"))


def triplets(positives: DataFrame, negatives: DataFrame, texts: DataFrame) -> DataFrame:
    """(pair_id, rank, anchor, positive, negative); a missing text drops the row."""
    p = pairs(positives, texts)
    q = negatives.join(texts, negatives["negative"] == texts["uri"]).select("pair_id", "rank", F.col("text").alias("negative"))
    return p.join(q, "pair_id").select("pair_id", "rank", "anchor", "positive", "negative")


def build_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): how often each value of each column occurs, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    return rows.select(each).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def top_values(stats: DataFrame, k: int = 20) -> DataFrame:
    """(field, value, n, share, rank): the k most frequent values of each field of ``build_stats``, with their share of all."""
    total = stats.groupBy("field").agg(F.sum("n").alias("all"), F.count("*").alias("values"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), F.asc_nulls_last("value"))  # Spark keeps k rows of a field in each task
    first = stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return first.join(F.broadcast(total), "field").select("field", "value", "n", (F.col("n") / F.col("all")).alias("share"), "rank", "values")


def corpus_profile(documents: DataFrame, by: list[str], figures: dict[str, Column]) -> DataFrame:
    """One row for each group and one for all (by is null): number of rows, and of each figure the mean, least, greatest and nulls."""
    each = [a for n, c in figures.items() for a in (F.avg(c).alias(f"mean_{n}"), F.min(c).alias(f"min_{n}"), F.max(c).alias(f"max_{n}"), F.count(F.when(c.isNull(), 1)).alias(f"no_{n}"))]
    return documents.groupingSets([[F.col(c) for c in by], []], *by).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *each)


def unseen(now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Rows that an earlier run has not done: an unchanged (id, hash) is skipped."""
    return now.join(before.select(*key).distinct(), key, "left_anti")


def resumed(now: DataFrame, before: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action) of each item of a run (key, digest) against an earlier one: ``skip`` if unchanged, ``redo`` if its digest
    differs, ``new``, or ``drop`` if it is there no more; null digests are never equal."""
    a, b = now.select(key, F.col(digest).alias("d"), F.lit(True).alias("here")), before.groupBy(key).agg(F.max(digest).alias("was"), F.lit(True).alias("done"))
    action = F.when(F.col("here").isNull(), "drop").when(F.col("done").isNull(), "new").when(F.col("d") == F.col("was"), "skip").otherwise("redo")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def split_rows(rows: DataFrame, documents: DataFrame, doc: str, category: str, fraction: float, seed: int = 0) -> DataFrame:
    """``rows`` with the split of their document, so that no document has rows in both; rows of unknown documents train."""
    split = stratified_split(documents.select(doc, category).dropDuplicates([doc]), doc, category, fraction, seed).select(doc, "split")
    return rows.join(split, doc, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def coverage(trained: DataFrame, needed: DataFrame) -> DataFrame:
    """(cv_id, needed, covered): how many of a document's concepts training has seen."""
    t = trained.select("uri", F.lit(1).alias("seen")).distinct()
    return needed.distinct().join(t, "uri", "left").groupBy("cv_id").agg(F.count("*").alias("needed"), F.count("seen").alias("covered"))
