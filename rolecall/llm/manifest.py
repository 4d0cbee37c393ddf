"""A Merkle manifest of a dataset: a content-addressed DAG, and proofs by descent.

Every row is a leaf; the leaves of a source stand in order and form a tree of
fan-out ``FAN`` up to its subroot, and the subroots, ordered by source, form the
tree of the root.  The DAG is kept as records digest -> children, one table for each
height.  A proof is asked by place: its base-``FAN`` digits, from the top, choose the
child at each record, and what was not chosen is a segment of the proof.  Requests
that share leading digits share the descent, so a record is read once for all leaves
below it, and the long upper parts of the proofs meet ``FAN`` leaves each, not all.
Segments are gathered from the root down and reversed, which gives leaf to root.

Places come from a range partitioning and a sum over partitions, so that a source
that holds most rows is ranked by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import few, quoted, written

_BITS = 4
FAN = 1 << _BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """Length in bytes, a colon and the value; ``-`` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**other: Column) -> Column:
    """The digest of a row of documents, with other values in the place of some."""
    return F.sha2(F.concat(*(field(other.get(c, F.col(c))) for c in FIELDS)), 256)


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(tree, doc_id, leaf, altered): the digest of each row, and that of its tampered form
    (A-Z of the text in lower case) where ``changed`` holds, else null."""
    mine = docs.select(*(F.col(quoted(c)).alias(c) for c in FIELDS), (F.lit(False) if changed is None else F.coalesce(changed, F.lit(False))).alias("changed"))
    # a source's key sorts as the source does, and nulls come first
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    altered = F.when(F.col("changed"), leaf(text=F.translate("text", _UPPER, _LOWER)))
    return mine.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), altered.alias("altered"))


def placed(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Rows in order of (tree, ``order``) with their position ``at`` and ``chunk``, as a table, and
    for each tree and chunk: lo (its first position), before (rows of the tree in earlier
    chunks), n (rows of the tree).  The place of a row is before + at - lo."""
    keys = ["tree", *order]
    table = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("at", 33)))
    parts = table.groupBy("tree", "chunk").agg(F.min("at").alias("lo"), F.count("*").alias("m"))
    tree = Window.partitionBy("tree")  # at most one row for each partition
    before = F.sum("m").over(tree.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return table, written(parts.select("tree", "chunk", "lo", F.coalesce(before, F.lit(0)).alias("before"), F.sum("m").over(tree).alias("n")))


def _place() -> Column:
    return F.col("before") + F.col("at") - F.col("lo")


@dataclass
class Forest:
    """Trees over numbered places.  ``records[h]`` is (digest, children) of height h + 1, and
    ``tops`` (tree, digest, height) holds the top of each tree."""

    records: list[DataFrame]
    tops: DataFrame


def forest(rows: DataFrame, most: int) -> Forest:
    """The trees over (tree, place, n, digest), where n counts the leaves of a tree, ``most`` at most.
    Every ``FAN`` consecutive nodes become one while a tree has several."""
    level, records, tops = rows, [], [_top(rows, 0)]
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("place", "digest")))
        above = level.filter("n > 1").groupBy("tree", F.shiftright("place", _BITS).alias("place")).agg(F.first("n").alias("n"), run.alias("run"))
        children = F.transform("run", lambda c: c["digest"])
        level = written(above.select("tree", "place", F.shiftright(F.col("n") + (FAN - 1), _BITS).alias("n"), F.sha2(F.concat_ws("", children), 256).alias("digest"), children.alias("children")))
        most = (most + FAN - 1) >> _BITS
        records.append(level.groupBy("digest").agg(F.first("children").alias("children")))
        tops.append(_top(level, len(records)))
    return Forest(records, written(reduce(DataFrame.union, tops)))


def _top(level: DataFrame, height: int) -> DataFrame:
    return level.filter("n = 1").select("tree", "digest", F.lit(height).alias("height"))


def descend(trees: Forest, tops: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (tree, place, ...) with ``path`` and the further columns of ``tops`` (tree,
    digest, height, path, ...).

    ``path`` gets a segment (left, right) for each height from the top down: the
    children before and after the chosen one.  Before the last step requests travel as
    distinct prefixes of their places.
    """
    carried = [c for c in tops.columns if c not in ("tree", "digest", "height", "path")]
    wanted = [requests.select("tree", F.shiftright("place", _BITS * h).alias("place")).distinct() for h in range(len(trees.records))]
    at = None
    for h in range(len(trees.records), -1, -1):
        here = tops.filter(F.col("height") == h).select("tree", F.lit(0).cast("long").alias("place"), "digest", "path", *carried)
        if at is not None:
            ask = wanted[h] if h else requests.withColumnRenamed("digest", "own") if "digest" in requests.columns else requests
            opened = at.join(trees.records[h], "digest").select("tree", F.col("place").alias("up"), "children", "path", *carried)
            digit = F.col("place").bitwiseAND(F.lit(FAN - 1).cast("long")).cast("int")
            joined = ask.withColumn("up", F.shiftright("place", _BITS)).join(opened, ["tree", "up"])
            segment = F.struct(F.concat_ws("", F.slice("children", F.lit(1), digit)).alias("left"), F.concat_ws("", F.slice("children", digit + 2, F.lit(FAN))).alias("right"))
            down = joined.withColumn("path", F.concat("path", F.array(segment)))
            if h == 0:
                if "digest" in requests.columns:
                    down = down.withColumnRenamed("own", "digest")
                down = down.select(*requests.columns, "path", *carried)
                whole = requests.join(here.drop("digest"), ["tree", "place"]).select(*requests.columns, "path", *carried)
                return down.union(whole)
            here = here.union(down.select("tree", "place", F.element_at("children", digit + 1).alias("digest"), "path", *carried))
        elif h == 0:
            return requests.join(here.drop("digest"), ["tree", "place"]).select(*requests.columns, "path", *carried)
        at = here


_PATH = "array<struct<left:string,right:string>>"


@dataclass
class Manifest:
    """``leaves`` is (tree, place, n, doc_id, digest, altered), a tree being the number of a source;
    ``sources`` the forest of sources, ``top`` the tree over their subroots."""

    leaves: DataFrame
    sources: Forest
    top: Forest
    root: str | None


def manifest(rows: DataFrame) -> Manifest:
    """The DAG over ``leaves``, in tables of the shared folder."""
    table, parts = placed(written(rows), "doc_id", "leaf")
    names, numbers = placed(parts.select(F.lit(0).alias("tree"), F.col("tree").alias("name")).distinct(), "name")
    numbers = names.join(F.broadcast(numbers), ["tree", "chunk"]).select(F.col("name").alias("tree"), _place().alias("number"))  # a row for each partition
    parts = written(parts.join(numbers, "tree"))
    mine = written(table.join(few(parts) or parts, ["tree", "chunk"]).select(F.col("number").alias("tree"), _place().alias("place"), "n", "doc_id", F.col("leaf").alias("digest"), "altered"))
    most, count = parts.agg(F.max("n"), F.countDistinct("number")).first()
    sources = forest(mine.select("tree", "place", "n", "digest"), most or 0)
    top = forest(sources.tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(count).cast("long").alias("n"), "digest"), count)
    root = top.tops.first()
    return Manifest(mine, sources, top, root["digest"] if root else None)


def proofs(made: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (rows of ``made.leaves``) with subroot and ``path``: the segments (left, right)
    from the leaf's own run up to the root's children."""
    start = made.top.tops.withColumn("path", F.array().cast(_PATH))
    asked = made.sources.tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("digest").alias("subroot"), F.col("height").alias("below"))
    asked = asked.join(requests.select(F.col("tree").alias("place")).distinct(), "place", "left_semi").select("tree", "place", "subroot", "below")
    tops = descend(made.top, start, asked).select(F.col("place").alias("tree"), F.col("subroot").alias("digest"), F.col("below").alias("height"), "path", "subroot")
    return descend(made.sources, tops, requests).withColumn("path", F.reverse("path"))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def audited(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``changed`` tells which rows are tampered with before their proof is checked; where
    it is null they are not.  Leaves of a source ascend by doc_id (null first), those
    of one doc_id by digest, so that repeated rows are leaves of their own.  A null
    source is a source and comes first; any field may be null; an empty table has no
    root and gives no rows.  Other columns are not looked at.
    """
    made = manifest(leaves(docs, changed))
    found = proofs(made, made.leaves.select("tree", "place", "doc_id", "digest", "altered"))
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    rows = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(made.root).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("altered", "digest"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
