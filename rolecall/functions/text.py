"""Text functions as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

#: Letters with marks and the letters they fold to; enough for the languages handled here.
MARKED = "àáâãäåăąçćčďèéêëęěğìíîïłñńňòóôõöőřśşșšťţțùúûüűůýÿźżžÀÁÂÃÄÅĂĄÇĆČĎÈÉÊËĘĚĞÌÍÎÏŁÑŃŇÒÓÔÕÖŐŘŚŞȘŠŤŢȚÙÚÛÜŰŮÝŹŻŽ"
PLAIN = "aaaaaaaacccdeeeeeegiiiilnnnoooooorsssstttuuuuuuyyzzzAAAAAAAACCCDEEEEEEGIIIILNNNOOOOOORSSSSTTTUUUUUUYZZZ"


def fold(text: Column) -> Column:
    """Letters without their marks."""
    return F.translate(text, MARKED, PLAIN)


def clean(text: Column, was_ocr: bool = False) -> Column:
    """Ligatures, spaces, unprintable characters, line ends, then trim; null is empty."""
    t = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), C.LIGATURES.items(), F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"[  -   　]+", " ")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"[^\x09\x0A\x0D\x20-\x7E\u0080-�]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    if was_ocr:
        t = F.regexp_replace(t, r"\brn(?=[a-z])", "m")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def keyword_hits(text: Column, keywords: list[str] | None = None) -> Column:
    lower = F.lower(text)
    return reduce(lambda a, b: a + b, (F.contains(lower, F.lit(k.lower())).cast("int") for k in keywords or C.KEYWORDS))


def quality(text: Column, pages: Column | int = 1, keywords: list[str] | None = None) -> Column:
    """Length gate times the mean of the letter share and the keyword share, four places."""
    words = keywords or C.KEYWORDS
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / n
    found = F.least(F.lit(1.0), keyword_hits(text, words) / len(words))
    length = F.least(F.lit(1.0), n / (C.CHARS_PER_PAGE * F.greatest(F.lit(1), pages if isinstance(pages, Column) else F.lit(pages))))
    return F.when(n > 0, F.round(length * (0.5 * letters + 0.5 * found), 4)).otherwise(0.0)


def likely_document(text: Column, keywords: list[str] | None = None, needed: int = C.KEYWORDS_NEEDED) -> Column:
    return keyword_hits(text, keywords) >= needed


def emails(text: Column) -> Column:
    """Plausible addresses, lower-case, each once, in text order."""
    edge = r"^[.,;:<>()\[\]{}\"']+|[.,;:<>()\[\]{}\"']+$"
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(C.EMAIL), 0), lambda e: F.lower(F.regexp_replace(e, edge, "")))
    return F.array_distinct(F.filter(found, plausible_email))


def plausible_email(e: Column) -> Column:
    parts = F.split(e, "@")
    return (F.size(parts) == 2) & (F.length(parts[0]) > 0) & parts[1].rlike(r"^[^.].*\.[^.]+$")


def effective_email(form: Column, manual: Column, extracted: Column) -> Column:
    """(email, source): form, then manual, then extracted; blank is absent."""
    norm = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    f, m, x = norm(form), norm(manual), norm(extracted)
    source = F.when(f.isNotNull(), "FORM").when(m.isNotNull(), "MANUAL").when(x.isNotNull(), "EXTRACTED").otherwise("NONE")
    return F.struct(F.coalesce(f, m, x).alias("email"), source.alias("source"))


def header_key(line: Column) -> Column:
    """A line as a header key, or null: trimmed, one run of closing punctuation off, 60 characters at most."""
    t = F.trim(F.regexp_replace(F.trim(line), r"(?U)[^\w\s]+\s*$", ""))
    return F.when((F.length(t) > 0) & (F.length(F.trim(line)) <= 60), fold(F.lower(t)))


def cue_pattern(cues: list[str]) -> str:
    """An expression for text that ends with one of the cues, phrases of words."""
    import re

    if not cues or isinstance(cues, str):
        raise ValueError("denials need a list of cues")
    phrases = "|".join(r"\s+".join(map(re.escape, cue.split())) for cue in cues)
    return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{phrases})\s*$"


def negated(text: Column, start: Column, cues: list[str], window: int = C.NEGATION_WINDOW) -> Column:
    """Does a cue end where a match starts (0-based), within the window before it?  Cues are the
    caller's, in small letters without marks."""
    before = fold(F.lower(F.substring(text, F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window)))))
    return before.rlike(cue_pattern(cues))


def junk_surface(surface: Column) -> Column:
    return (F.length(F.trim(surface)) < 2) | ~surface.rlike(r"\p{L}")


def surface_variants(surface: Column) -> Column:
    return F.array_distinct(F.array(F.trim(surface), fold(F.trim(surface))))


def alternative_labels(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"\s*[|\n;]\s*"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def first_wins(labels: Column, but: Column | None = None) -> Column:
    """Labels without case-insensitive repeats, first kept, and without ``but``."""
    skip = F.array(F.lower(but)) if but is not None else F.array().cast("array<string>")
    start = F.struct(skip.alias("seen"), F.array().cast("array<string>").alias("out"))
    step = lambda a, x: F.when(F.array_contains(a["seen"], F.lower(x)), a).otherwise(
        F.struct(F.array_append(a["seen"], F.lower(x)).alias("seen"), F.array_append(a["out"], x).alias("out"))
    )
    return F.aggregate(labels, start, step, lambda a: a["out"])


def context(text: Column, start: Column, end: Column, reach: int = 50) -> Column:
    """(before, after): up to ``reach`` characters, cut at the last sentence end on the
    left and the first on the right."""
    left = F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    right = F.substring(text, end + 1, F.lit(reach))
    return F.struct(F.regexp_replace(left, r"(?s)^.*[.!?\n]\s*", "").alias("before"), F.regexp_extract(right, r"(?s)^[^.!?\n]*", 0).alias("after"))


def anchor(text: Column, start: Column, end: Column, reach: int = 50, most: int = 256) -> Column:
    around = F.trim(F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, end + reach - F.greatest(start - reach, F.lit(0))))
    span = F.trim(F.substring(text, start + 1, end - start))
    return F.coalesce(F.nullif(F.left(around, F.lit(most)), F.lit("")), F.nullif(span, F.lit("")), F.lit("?"))


def concept_text(label: Column, alternatives: Column, description: Column, form: str = "bounded-a") -> Column:
    """The text a concept is encoded by: label, alternatives and the start of its description."""
    if form == "b":
        parts = [label, F.left(description, F.lit(300))]
    elif form == "c":
        parts = [label, F.array_join(F.slice(alternatives, 1, 3), ", "), F.left(description, F.lit(300))]
    else:
        parts = [label, F.array_join(F.slice(F.sort_array(alternatives), 1, 5), ", "), F.left(description, F.lit(300))]
    return F.concat_ws(". ", *(F.nullif(p, F.lit("")) for p in parts))


def evidence(surface: Column, section: Column) -> Column:
    plain = F.coalesce(F.trim(section), F.lit("")).isin("", "other", "unknown")
    return F.when(plain, surface).otherwise(F.concat(surface, F.lit(" ("), section, F.lit(")")))


def lower_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)


def grams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space.  The lambda sees one zipped element only: an
    array named inside a lambda would be computed or copied again for every run."""
    m = F.greatest(F.size(words) - n + 1, F.lit(0))
    zipped = F.arrays_zip(*(F.slice(words, k + 1, m).alias(f"g{k}") for k in range(n)))
    return F.transform(zipped, lambda s: F.concat_ws(" ", *(s[f"g{k}"] for k in range(n))))


def shingles(words: Column, n: int = C.NGRAM) -> Column:
    """Distinct n-grams of a column of words; fewer words are one shingle."""
    whole = F.when(F.size(words) > 0, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) >= n, F.array_distinct(grams(words, n))).otherwise(whole)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(C.TOKEN), 0)


def window_count(n: Column, size: int = C.WINDOW_TOKENS, stride: int = C.STRIDE_TOKENS) -> Column:
    """How many windows cover n tokens."""
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / stride)).cast("int")


def pair_id(*fields: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *(f.cast("string") for f in fields))), 1, 16)


def mail_link(to: Column, subject: Column) -> Column:
    kept = F.filter(to, lambda x: F.length(F.trim(x)) > 0)
    return F.concat(F.lit("mailto:"), F.array_join(F.transform(kept, F.url_encode), ","), F.lit("?subject="), F.replace(F.url_encode(subject), F.lit("+"), F.lit("%20")))


def report_text(text: Column) -> Column:
    """Dashes of all kinds as a hyphen, zero-width characters off."""
    return F.regexp_replace(F.regexp_replace(text, r"[‐-―−]", "-"), r"[​-‍﻿]", "")
