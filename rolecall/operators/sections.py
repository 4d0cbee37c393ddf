"""Parts of a text: languages with their levels, slash-joined names, the blocks of a job text.

All are native expressions over one row's text; only small lists are shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import fold


def _any_of(words: list[str]) -> str:
    """Alternatives of a pattern, longer ones first; a blank stands for any run of blanks."""
    return "|".join(r"\s+".join(map(re.escape, w.split())) for w in sorted(words, key=lambda w: (-len(w), w)))


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def _matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern with the text before each, in order."""
    return F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, F.lit(pattern), 0))).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("value"))


def _with_places(rows: DataFrame, by: list[str], parts: str = "parts") -> DataFrame:
    """(by..., start, end, value) of every match in ``parts``.  The outer form, as Spark would else
    look for matches once more, in a filter before the rows are dealt."""
    each = rows.select(*by, F.posexplode_outer(parts).alias("k", "part")).filter("k is not null").select(*by, "k", F.length("part.gap").alias("gap"), F.col("part.value").alias("value"))
    w = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(w)
    return each.select(*by, (end - F.length("value")).cast("int").alias("start"), end.cast("int").alias("end"), "value")


# ---- languages and levels ----------------------------------------------------


def certificate(text: Column, words: dict[str, str] | None = None, acronyms: dict[str, str] | None = None) -> Column:
    """The level that the first certificate in a text stands for; a level written beside its name comes first."""
    words, acronyms = words or C.CERTIFICATE_WORDS, acronyms or C.CERTIFICATES
    word, level = _any_of(list(words)), "[ABCabc][12]"
    pattern = rf"\b(?:({level})\s+(?:{word})|({word})(?:\s*\(?\s*({level})\s*\)?)?|({_any_of(list(acronyms))}))"
    part = lambda g: F.nullif(F.regexp_extract(text, pattern, g), F.lit(""))
    return F.coalesce(_looked_up(part(4), acronyms), F.upper(part(1)), F.upper(part(3)), _looked_up(part(2), words))


def level_of(raw: Column, levels: dict[str, str] | None = None) -> Column:
    """The level that some words name: as a whole, by a certificate, by a letter and digit, or by a word among them."""
    levels = levels or C.LEVEL_WORDS
    key = F.lower(F.trim(raw))
    letter = F.upper(F.nullif(F.regexp_extract(key, r"\b([abc][12])\b", 1), F.lit("")))
    inside = F.coalesce(*(F.when(key.rlike(rf"\b(?:{_any_of([w])})\b"), F.lit(level)) for w, level in levels.items()))
    return F.coalesce(_looked_up(key, levels), certificate(raw), letter, inside)


def language_levels(parts: DataFrame, names: dict[str, list[str]] | None = None, levels: dict[str, str] | None = None, certified: str = "English", ahead: int = 160, look: int = 120) -> DataFrame:
    """(doc_id, language, surface, level, start, end) of language sections (doc_id, text, start, end).

    A known language name is followed within ``ahead`` characters by a level in
    brackets, or after a dash or colon up to a comma, semicolon or line end.  Without
    one, the language ``certified`` takes the level of a certificate in the next
    ``look`` characters.  Of a language named several times in a section the first counts.  Places are those of the
    name in the whole text.  Null and empty sections name nothing.
    """
    names = names or C.LANGUAGE_NAMES
    known = {fold_word(s): language for language, some in names.items() for s in some}
    pattern = rf"(?i)(?<![A-Za-z\-])(?:{_any_of(list(known))})(?![A-Za-z\-])"
    rows = parts.filter("start < end").select("doc_id", F.col("start").alias("at"), F.substring("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("part"))
    found = _with_places(rows.select("doc_id", "at", _matches(fold(F.col("part")), pattern).alias("parts")), ["doc_id", "at"])
    found = found.select("doc_id", "at", _looked_up(F.lower("value"), known).alias("language"), "start", "end")
    first = found.groupBy("doc_id", "at", "language").agg(F.min(F.struct("start", "end")).alias("place"))
    lists = first.groupBy("doc_id", "at").agg(F.collect_list(F.struct("language", "place.start", "place.end")).alias("found"))
    each = rows.join(lists, ["doc_id", "at"]).select("doc_id", "at", "part", F.inline("found"))
    tail = F.substring("part", F.col("end") + 1, F.lit(ahead))
    bracket, dash = r"^\s*\(\s*([^()]+?)\s*\)", r"^\s*[-–—:]\s*([A-Za-z0-9 +/]+?)\s*(?=[,;\n]|$)"
    taken = lambda g: F.coalesce(F.nullif(F.regexp_extract(tail, bracket, g), F.lit("")), F.nullif(F.regexp_extract(tail, dash, g), F.lit("")))
    after = F.col("end") + F.length(F.coalesce(taken(0), F.lit("")))
    level = F.coalesce(level_of(taken(1), levels), F.when(F.col("language") == certified, certificate(F.substring("part", after + 1, F.lit(look)))))
    return each.select(
        "doc_id", "language", F.substring("part", F.col("start") + 1, F.col("end") - F.col("start")).alias("surface"), level.alias("level"), (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end")
    )


def fold_word(word: str) -> str:
    """As ``fold`` of the lower-case word, for lists that the driver holds."""
    from ..functions.text import MARKED, PLAIN

    return word.lower().translate(str.maketrans(MARKED, PLAIN))


# ---- slash-joined names --------------------------------------------------------

#: Fixed value: two or more names joined by slashes.
SLASHED = r"(?U)(?<!\w)[\w.#+\-]++(?:/[\w.#+\-]++)++"


def slash_segmented(documents: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(doc_id, text, slashes): blanks stand around the slashes of runs (A/B/C) of which every
    part is one of ``surfaces`` (surface), in any case; other runs are as they were.

    ``slashes`` holds the places of these slashes in the old text, so that
    ``original_place`` maps a place of the new text back.  Distinct runs are looked up, not
    documents; a null text stays null.  Documents are dealt by their id first, as a small
    file would else be one task, and every later step keeps to that.
    """
    documents = documents.select("doc_id", "text").repartition("doc_id")
    slashed = F.when(F.contains("text", F.lit("/")), F.col("text"))
    runs = _with_places(documents.select("doc_id", _matches(slashed, SLASHED).alias("parts")), ["doc_id"])
    known = surfaces.select(F.lower(F.trim("surface")).alias("part")).filter("part <> ''").distinct().withColumn("known", F.lit(True))
    parts = runs.select("value").distinct().select("value", F.explode(F.split("value", "/")).alias("part")).withColumn("part", F.lower("part"))
    whole = parts.join(known, "part", "left").groupBy("value").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all")).filter("all").select("value")
    sizes = F.transform(F.split("value", "/"), lambda p: F.length(p))
    ends = F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) + i)
    inner = runs.join(whole, "value").select("doc_id", F.explode(F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: e + F.col("start"))).alias("slash"))
    lists = inner.groupBy("doc_id").agg(F.array_sort(F.collect_list("slash")).alias("slashes"))
    both = documents.join(lists, "doc_id", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, p: F.struct((p + 1).alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, p - a["at"]), F.lit(" / ")).alias("out"))
    new = F.aggregate("slashes", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return both.select("doc_id", F.when(F.col("slashes").isNull(), F.col("text")).otherwise(new).alias("text"), F.coalesce("slashes", F.array().cast("array<int>")).alias("slashes"))


def original_place(place: Column, slashes: Column) -> Column:
    """The place in the old text of a place in the new one; a new blank is at its slash."""
    before = F.size(F.filter(slashes, lambda p, i: p + 2 * i + 2 <= place))
    return F.least(place - 2 * before, F.coalesce(F.get(slashes, before), place))


# ---- job texts -------------------------------------------------------------------


def header_pattern(phrases: list[str]) -> str:
    """A line that is one of the phrases: decoration before it, and after it a remark in brackets or
    after an ampersand (60 characters at most) and one closing mark."""
    return rf"(?iU)^\s*(?:[^\w\s]+\s+)?(?:{_any_of(phrases)})\s*(?:[(&].{{0,60}})?\s*[:\-–.]?\s*$"


def job_rows(jobs: DataFrame, required: list[str], nice: list[str], others: list[str], shortest: int = 3, longest: int = 240) -> DataFrame:
    """(jd_id, title, required_skills, nice_to_have_skills) of job texts (jd_id, text).

    The title is the first line that is not blank.  The first header of a kind opens its
    block and any header closes it; lines lose their bullets, and count with
    ``shortest`` to ``longest`` characters.  Every line is a state of its own: that of
    the last header before it, found by position among the headers, so nothing runs
    line by line and no text is shuffled.  A text without a header has no skills; a
    null text has no title either.
    """
    lines = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    kind = lambda s: F.when(s.rlike(header_pattern(required)), "required").when(s.rlike(header_pattern(nice)), "nice").when(s.rlike(header_pattern(others)), "other")
    heads = F.filter(F.transform("lines", lambda s, i: F.struct((i + 1).alias("i"), kind(s).alias("kind"))), lambda h: h["kind"].isNotNull())
    rows = jobs.select("jd_id", lines.alias("lines")).withColumn("heads", heads)

    def block(name: str) -> Column:
        at = F.get(F.filter("heads", lambda h: h["kind"] == name), F.lit(0))["i"]
        close = F.coalesce(F.get(F.filter("heads", lambda h: h["i"] > at), F.lit(0))["i"], F.size("lines") + 1)
        plain = F.transform(F.slice("lines", at + 1, close - at - 1), lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"^[\-•▪●*]+\s*", ""))
        return F.coalesce(F.filter(plain, lambda s: F.length(s).between(shortest, longest)), F.array().cast("array<string>"))

    title = F.get(F.filter(F.transform("lines", lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != ""), F.lit(0))
    return rows.select("jd_id", title.alias("title"), block("required").alias("required_skills"), block("nice").alias("nice_to_have_skills"))
