"""From text to lexical skill matches: sections, phrase hits, filters, aggregation.

``documents`` have doc_id and text; ``patterns`` have concept_uri, label,
label_kind (preferred or alt) and surface.  Every operator takes and returns
DataFrames; documents are keyed by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scores, text

WORD = r"[\p{L}\p{N}_]+"


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, start, end): lines with their places in the text."""
    each = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))
    return each.select("doc_id", "line_no", "line", start.alias("start"), (start + F.length("line")).alias("end"))


def header_table(spark, headers: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(h, label) for label, some in (headers or C.SECTION_HEADERS).items() for h in some]
    return spark.createDataFrame(rows, "key string, label string")


def sections(documents: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, label, start, end): text between whole-line headers.

    A header belongs to no section, what stands before the first is ``other``, an
    empty section stays; a text without headers is one ``other`` section.
    """
    keyed = lines(documents).withColumn("key", text.header_key(F.col("line")))
    marks = keyed.join(headers, "key").select("doc_id", "label", (F.col("end") + 1).alias("start"), F.col("start").alias("header_start"))
    size = documents.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    first = size.select("doc_id", F.lit("other").alias("label"), F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("header_start"))
    w = Window.partitionBy("doc_id").orderBy("header_start")
    every = first.unionByName(marks).withColumn("next", F.lead("header_start").over(w)).join(size, "doc_id")
    end = F.coalesce("next", "size")
    return every.select("doc_id", "label", F.least("start", end).alias("start"), F.greatest(F.least("start", end), end).alias("end"))


def words(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, word, start, end): lower-case words with their places."""
    t = F.coalesce("text", F.lit(""))
    gap = F.split(t, WORD, -1)
    each = documents.select("doc_id", F.posexplode(F.arrays_zip(gap.alias("gap"), F.regexp_extract_all(t, F.lit(WORD), 0).alias("word"))))
    each = each.select("doc_id", "pos", F.length("col.gap").alias("gap"), F.col("col.word").alias("word"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.length("word"), F.lit(0))).over(w)
    return each.select("doc_id", "pos", F.lower("word").alias("word"), (end - F.length("word")).alias("start"), end.alias("end")).filter("word is not null")


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """Patterns with the key (words joined by a space) that hits are joined on, and its length."""
    parts = F.regexp_extract_all(F.lower("surface"), F.lit(WORD), 0)
    return patterns.withColumn("key", F.concat_ws(" ", parts)).withColumn("n", F.size(parts)).filter("n > 0")


def phrase_hits(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every occurrence of every pattern, overlapping and nested ones too.

    Documents are read once, whatever the lengths of the patterns.  A word goes on only
    if it begins a pattern, with the lengths of those that it begins; then the run of
    words of each such length is looked up.  Spark broadcasts the first words and the
    patterns while they are small; beyond that only runs that may be hits are shuffled.
    """
    keys = pattern_keys(patterns)
    longest = keys.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    begins = keys.groupBy(F.substring_index("key", " ", 1).alias("first")).agg(F.collect_set("n").alias("sizes"))
    words = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0), F.lower)
    base = documents.select("doc_id", words.alias("w"))
    runs = F.arrays_zip(*(F.slice("w", k + 1, F.size("w")).alias(f"g{k}") for k in range(longest)))
    each = base.select("doc_id", F.posexplode(runs).alias("pos", "g")).join(begins, F.col("g.g0") == F.col("first"))
    each = each.select("doc_id", "pos", "g", F.explode("sizes").alias("n"))
    parts = F.slice(F.array(*(F.col(f"g.g{k}") for k in range(longest))), 1, F.col("n"))
    grams = each.select("doc_id", "pos", "n", F.when(~F.exists(parts, lambda p: p.isNull()), F.concat_ws(" ", parts)).alias("key"))
    return grams.join(keys.drop("n"), "key").select("doc_id", "pos", "n", "concept_uri", "label", "label_kind", "surface")


def match_kind(label_kind: Column) -> Column:
    return F.when(label_kind == "preferred", "exact").when(label_kind == "alt", "alt").otherwise("lemma")


def in_sections(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """Hits with the section that holds their start (half open); ``other`` where none does."""
    s = parts.select("doc_id", F.col("label").alias("section"), F.col("start").alias("s0"), F.col("end").alias("s1"))
    on = (hits["doc_id"] == s["doc_id"]) & (hits["start"] >= s["s0"]) & (hits["start"] < s["s1"])
    return hits.join(s, on, "left").select(hits["*"], F.coalesce("section", F.lit("other")).alias("section"))


def beside_text(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, text, hits): the hits of a document as one list, so that its text is moved once, not with each hit."""
    lists = hits.groupBy("doc_id").agg(F.collect_list(F.struct(*hits.columns)).alias("hits"))
    return lists.join(documents.select("doc_id", "text"), "doc_id")


def without_negated(hits: DataFrame, documents: DataFrame, cues: list[str]) -> DataFrame:
    """Hits (doc_id, start, ...) that no denial of ``cues`` stands before."""
    both = beside_text(hits, documents)
    return both.select(F.inline(F.filter("hits", lambda h: ~text.negated(F.col("text"), h["start"], cues))))


def without_entities(hits: DataFrame, entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Hits outside ``skills`` that overlap a proper-noun span are dropped, unless their surface is allowed."""
    safe = hits.join(allowed.select(F.lower("surface").alias("ok")).distinct(), F.lower("surface") == F.col("ok"), "left")
    e = entities.select(F.col("doc_id").alias("d"), F.col("start").alias("e0"), F.col("end").alias("e1"))
    on = (safe["doc_id"] == e["d"]) & (safe["start"] < e["e1"]) & (safe["end"] > e["e0"]) & (safe["section"] != "skills") & safe["ok"].isNull()
    return safe.join(e, on, "left_anti").drop("ok")


def suppressed(hits: DataFrame, rules: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits that a rule (surface, target_uri) with its optional context suppresses.

    ``rules``: surface, target_uri, case_sensitive, allowed_sections,
    forbidden_sections, surrounding_any, surrounding_none (arrays or null), window_chars.
    """
    r = rules.select(F.col("surface").alias("r_surface"), F.col("target_uri").alias("concept_uri"), "case_sensitive", "allowed_sections", "forbidden_sections", "surrounding_any", "surrounding_none", "window_chars")

    def holds(h: Column) -> Column:
        around = F.lower(F.substring(F.col("text"), F.greatest(h["start"] - h["window_chars"], F.lit(0)).cast("int") + 1, (h["end"] - h["start"] + 2 * h["window_chars"]).cast("int")))
        has = lambda c: F.exists(c, lambda t: F.contains(around, F.lower(t)))
        same = F.when(h["case_sensitive"], h["surface"] == h["r_surface"]).otherwise(F.lower(h["surface"]) == F.lower(h["r_surface"]))
        place = (h["allowed_sections"].isNull() | F.array_contains(h["allowed_sections"], h["section"])) & (h["forbidden_sections"].isNull() | ~F.array_contains(h["forbidden_sections"], h["section"]))
        return same & place & (h["surrounding_any"].isNull() | has(h["surrounding_any"])) & (h["surrounding_none"].isNull() | ~has(h["surrounding_none"]))

    both = beside_text(hits.join(r, "concept_uri"), documents)
    return both.select(F.inline(F.filter("hits", holds))).select(*hits.columns).distinct()


def skill_matches(hits: DataFrame) -> DataFrame:
    """One row for each document and concept: best kind, main section, distinct spans, frequency, confidence.

    ``hits``: doc_id, concept_uri, label, section, start, end, surface, match_kind.
    """
    kind = scores.weight_of(F.col("match_kind"), C.KIND_WEIGHTS)
    spans = hits.groupBy("doc_id", "concept_uri", "start", "end").agg(
        F.max_by(F.struct("match_kind", "section", "surface", "label"), F.struct(kind, F.col("section"))).alias("h")
    )
    best = lambda c, *by: F.max_by(c, F.struct(*by))
    weight = scores.weight_of(F.col("h.section"), C.SECTION_WEIGHTS)
    out = spans.groupBy("doc_id", "concept_uri").agg(
        F.min("h.label").alias("label"),
        best("h.surface", weight, -F.col("start"), -F.col("end")).alias("matched_text"),
        best("h.section", weight, -F.col("start"), -F.col("end")).alias("section"),
        best("h.match_kind", scores.weight_of(F.col("h.match_kind"), C.KIND_WEIGHTS)).alias("match_kind"),
        F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("spans"),
        F.count("*").alias("frequency"),
    )
    return out.withColumn("confidence", scores.confidence(F.col("section"), F.col("match_kind"), F.col("frequency")))
