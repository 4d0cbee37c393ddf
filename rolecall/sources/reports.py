"""Reports as tables: pipe tables and bullet keys of texts, leaves of JSON with their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import report_text


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("path", F.posexplode(F.split(F.regexp_replace(report_text(F.col("text")), r"\r\n?", "\n"), "\n")).alias("k", "line"))


def pipe_tables(texts: DataFrame) -> DataFrame:
    """(path, table, row, column, value): cells of the pipe tables in texts (path, text).

    A table is a header line, a line of dashes and the lines with a pipe that follow;
    tables count from 1 in a text, rows from 0, and ``column`` is the header's cell.
    Cells without a header have none; blank cells are null.
    """
    piped = F.col("line").contains("|")
    rule = F.col("line").rlike(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$") & piped
    w = Window.partitionBy("path").orderBy("k")
    rows = _lines(texts).select("path", "k", "line", rule.alias("rule"), piped.alias("piped"), F.lag("line").over(w).alias("above"))
    rows = rows.withColumn("rule", F.col("rule") & F.coalesce(F.col("above").contains("|"), F.lit(False)))
    rows = rows.withColumn("table", F.count(F.when(F.col("rule"), 1)).over(w)).filter("table > 0")
    cells = lambda c: F.transform(F.split(F.regexp_replace(F.trim(c), r"^\||\|$", ""), r"(?<!\\)\|"), lambda x: F.nullif(F.trim(x), F.lit("")))
    at = Window.partitionBy("path", "table").orderBy("k")
    ended = F.max(F.when(F.col("piped"), 0).otherwise(1)).over(at)  # the first line without a pipe closes the table
    rows = rows.withColumns({"head": F.first(F.when(F.col("rule"), cells(F.col("above"))), True).over(at), "ended": ended}).filter("ended = 0 and not rule")
    numbered = rows.withColumn("row", F.row_number().over(at) - 1)
    body = numbered.select("path", "table", "row", "head", F.posexplode(cells(F.col("line"))).alias("c", "value"))
    return body.select("path", F.col("table").cast("int").alias("table"), "row", F.get("head", F.col("c")).alias("column"), "value")


def bullet_keys(texts: DataFrame) -> DataFrame:
    """(path, key, value) of lines ``- key: value``, bold marks off; of a repeated key the first."""
    line = F.regexp_replace("line", r"\*\*|`", "")
    pattern = r"^\s*[-*]\s+([^:]+?)\s*:\s*(.+?)\s*$"
    rows = _lines(texts).select("path", "k", F.regexp_extract(line, pattern, 1).alias("key"), F.regexp_extract(line, pattern, 2).alias("value")).filter("key <> ''")
    return rows.groupBy("path", "key").agg(F.min_by("value", "k").alias("value"))


def json_leaves(rows: DataFrame, deepest: int = 32) -> DataFrame:
    """(path, leaf, value): the leaves of JSON texts (path, text) with their place, as ``a.b[0].c``.

    Objects and arrays are opened level by level, all texts at once; a null or empty
    text has none, empty objects and arrays have none, what is no JSON is left out.
    """
    now = rows.select("path", F.try_parse_json("text").alias("v"), F.lit("").alias("leaf")).filter("v is not null")
    found = None
    for _ in range(deepest):
        kind = F.schema_of_variant("v")
        now = now.withColumn("kind", kind)
        part = now.filter("not startswith(kind, 'OBJECT') and not startswith(kind, 'ARRAY')").select("path", F.substring("leaf", 2, 1 << 30).alias("leaf"), F.col("v").cast("string").alias("value"))
        found = part if found is None else found.union(part)
        now = now.filter("startswith(kind, 'OBJECT') or startswith(kind, 'ARRAY')")
        if now.isEmpty():
            return found
        now.createOrReplaceTempView("_open_json")
        now = now.sparkSession.sql("select o.path, e.value as v, case when startswith(o.kind, 'ARRAY') then concat(o.leaf, '[', e.pos, ']') else concat(o.leaf, '.', e.key) end as leaf from _open_json o, lateral variant_explode(o.v) e")
    raise ValueError(f"JSON of more than {deepest} levels")


def unsourced(leaves: DataFrame, sources: DataFrame) -> DataFrame:
    """Leaves (path, leaf, value) that no source (path, leaf) stands for: a source of an object stands for all in it."""
    every = F.regexp_extract_all("leaf", F.lit(r"[^.\[\]]+|\[\d+\]"), 0)
    above = F.transform(F.sequence(F.lit(1), F.size(every)), lambda n: F.replace(F.array_join(F.slice(every, F.lit(1), n), "."), F.lit(".["), F.lit("[")))
    known = sources.groupBy("path").agg(F.collect_set("leaf").alias("_sources"))
    told = F.coalesce(F.arrays_overlap(above, "_sources"), F.lit(False))
    return leaves.join(known, "path", "left").filter(~told).select(*leaves.columns)  # the leaves are made once
