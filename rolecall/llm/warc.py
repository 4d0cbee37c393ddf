"""WARC records and a Merkle fixity audit of replicas.

Records of an archive lie one after another, in order of record id.  The leaf
of a record is the SHA-256 of its bytes; an inner node covers an aligned range
of ``FANOUT ** level`` record places, and hashes its children's places and
hashes in offset order; the top of each archive is its root.  Two replicas are
compared from their roots down, and only the children of ranges that differ are
looked at on the next level, until single records are left.

All of it is DataFrame work: hashes are built in codegen, every node gathers at
most ``FANOUT`` children, and the descent joins a level to the few ranges that
still differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import few, written

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
LEVELS = 3
#: Places of an archive: FANOUT ** LEVELS.
ARCHIVE = FANOUT**LEVELS
#: The archive of records without an id; no 64-bit id has it.
NO_ID = 1 << 52
#: Digits of a leaf hash by which the bodies of one id are gathered, step by step.
_STEPS = (8, 6, 4, 2, 0)


def record(url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record of a page as bytes; a null url or body is empty."""
    body = F.coalesce(body.cast("string"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def manifest(pages: DataFrame) -> DataFrame:
    """(archive, place, bytes, leaf) of each record.

    The place of a record is its id within the archive of ids that holds it, so a
    lost or added record moves no other; negative ids lie in negative archives.
    Repeated rows of one id are one place, whose bytes add up and whose leaf is a
    tree of its own over the hashes of the bodies, by their leading digits, so that
    no step gathers more than some 256 of them.  Records without an id are one
    place of archive ``NO_ID``.
    """
    raw = record(F.col("url"), F.col("html"))
    rid = F.col("page_id").cast("long")
    archive = F.coalesce(F.shiftright(rid, FANOUT_BITS * LEVELS), F.lit(NO_ID)).alias("archive")
    rows = pages.select(archive, F.coalesce(rid.bitwiseAND(F.lit(ARCHIVE - 1).cast("long")), F.lit(0)).alias("place"), raw.alias("raw"))
    key = ["archive", "place"]
    leaves = rows.select(*key, F.octet_length("raw").cast("long").alias("bytes"), F.sha2("raw", 256).alias("leaf"))
    by_leaf = written(leaves.groupBy(*key, "leaf").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("copies")))
    ids = by_leaf.groupBy(*key).agg(F.sum("bytes").alias("bytes"), F.sum("copies").alias("copies"), F.min("leaf").alias("leaf"))
    many = written(ids.filter("copies > 1").select(*key))
    node = by_leaf.join(few(many) or many, key, "left_semi").select(*key, F.col("leaf").alias("at"), F.concat_ws("x", "leaf", "copies").alias("hash"))
    for digits in _STEPS:
        node = node.groupBy(*key, F.substring("at", 1, digits).alias("at")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("hash"))), 256).alias("hash"))
    return ids.join(node.drop("at"), key, "left").select(*key, "bytes", F.when(F.col("copies") > 1, F.col("hash")).otherwise(F.col("leaf")).alias("leaf"))


def _above() -> Column:
    return F.shiftright("place", FANOUT_BITS)


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels 0 to LEVELS of (archive, place, bytes, hash): leaves first, one root an archive last."""
    levels = [leaves.select("archive", "place", "bytes", F.col("leaf").alias("hash"))]
    for _ in range(LEVELS):
        children = F.sort_array(F.collect_list(F.struct("place", "hash")))
        text = F.concat_ws(";", F.transform(children, lambda c: F.concat_ws(":", c["place"].cast("string"), c["hash"])))
        levels.append(written(levels[-1].groupBy("archive", _above().alias("place")).agg(F.sum("bytes").alias("bytes"), F.sha2(text, 256).alias("hash"))))
    return levels


def _differing(one: DataFrame, two: DataFrame) -> DataFrame:
    a = one.select("archive", "place", F.col("hash").alias("hash_a"))
    b = two.select("archive", "place", F.col("hash").alias("hash_b"))
    return a.join(b, ["archive", "place"], "full_outer").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """(archive, place, hash_a, hash_b): the records in which two trees differ.

    A hash is null where that replica lacks the record.  Equal trees give no rows;
    a missing archive gives all its records.
    """
    open_ranges = _differing(one[-1], two[-1]).select("archive", "place")
    for level in range(LEVELS - 1, -1, -1):
        inside = [
            side[level].join(open_ranges.select("archive", F.col("place").alias("above")), (F.col("above") == F.shiftright(side[level]["place"], FANOUT_BITS)) & (side[level]["archive"] == open_ranges["archive"]), "left_semi")
            for side in (one, two)
        ]
        found = _differing(*inside)
        open_ranges = found.select("archive", "place")
    return found


def offsets(leaves: DataFrame) -> DataFrame:
    """Leaves with ``offset``: the bytes before a record in its archive (at most ARCHIVE places each)."""
    from pyspark.sql import Window

    w = Window.partitionBy("archive").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("offset", F.coalesce(F.sum("bytes").over(w), F.lit(0)))


def fixity(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each damaged record: archive, page_id, offset, length (in ``pages``, null
    if it has no such record), kind (changed, missing, extra), hash_a, hash_b; and for
    each archive whole or not, a row of kind ``root`` with both roots and its size.

    Null urls and bodies are empty ones.  Records without an id are one record of
    archive ``NO_ID`` with a null page_id.  Repeated rows of an id are one record.  Empty
    tables have no archives.  Other columns are not looked at."""
    mine, theirs = written(manifest(pages)), written(manifest(replica))
    one, two = tree(mine), tree(theirs)
    bad = audit(one, two)
    kind = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    places = offsets(mine).select("archive", "place", "offset", F.col("bytes").alias("length"))
    rows = bad.join(places, ["archive", "place"], "left").select(
        "archive", F.when(F.col("archive") != NO_ID, F.col("archive") * ARCHIVE + F.col("place")).alias("page_id"), "offset", "length", kind.alias("kind"), "hash_a", "hash_b"
    )
    a = one[-1].select("archive", F.col("bytes").alias("length"), F.col("hash").alias("hash_a"))
    roots = a.join(two[-1].select("archive", F.col("hash").alias("hash_b")), "archive", "full_outer")
    return rows.unionByName(roots.select("archive", F.lit(None).cast("long").alias("page_id"), F.lit(0).cast("long").alias("offset"), "length", F.lit("root").alias("kind"), "hash_a", "hash_b"))
