"""Personal data: patterns, and information-theoretic sanitisation, in native expressions only.

Base values (email, ip, card, phone) are found by pattern in every text.  Each
stands for protected entities at three levels: the value itself, its owner
(domain of an address, network of an ip, issuer of a card, area of a phone) and
personal data as such.  The corpus tells which other terms give an entity away.
With N texts, of which df_e hold the entity, df_t the term, and df_te both, the
share of texts with the term that hold the entity is at least p, the lower end of
Wilson's interval for df_te of df_t at ``Z`` standard deviations, and the term
discloses

    PMI(t; e) / IC(e) = ln(p N / df_e) / ln(N / df_e)

of the entity at least: near 1 when many texts hold the term and all hold the
entity, less when the evidence is thin.  In texts that hold the entity, terms that
surely disclose ``GENERALISE`` or more are generalised to a class; those of them
whose estimate (with df_te / df_t for p) is ``REMOVE`` or more are removed.  Texts
are counted once whatever their copies.  What stands in one text only is no
co-occurrence and has no estimate of its own; a term with digits and ``FORM`` or
more letters and digits is also counted by its form (letters or none, and
length), so that keys and numbers that never recur are told by what their like
stand beside.  Every term counts, short ones and numbers too, wherever it stands.

Matches and terms get their places from the lengths of what lies between them
(``split``) and of themselves (``regexp_extract_all``), summed in text order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import few, keyed, quoted, written

GENERALISE = 2 / 3
REMOVE = 0.95
Z = 2.4
FORM = 12

#: The four kinds in order.  A match begins at the start of its run of
#: characters or where the last match ended (\G); quantifiers never give back, so
#: that a long run is read once.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to be searched for a kind.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"[\p{L}\p{N}]+"
BETWEEN = r"[^\p{L}\p{N}]+"
TERM_KINDS = ("term_general", "term_remove")
#: Terms that also count by their form.
_FORMED = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{L}}*\p{{N}})[\p{{L}}\p{{N}}]{{{FORM},}}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum divisible by ten: every second digit from the right counts twice, less nine above nine."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    small = F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False))
        .otherwise(F.length(digits).between(9, 15))
    )


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """``parts`` (gap, value) in text order to (by..., start, end, value), in code points; one window for each text."""
    each = rows.select(*by, F.posexplode("parts")).select(*by, "pos", F.length("col.gap").alias("gap"), F.col("col.value").alias("value"))
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.length("value"), F.lit(0))
    end = F.sum(F.col("gap") + size).over(w)
    return each.select(*by, "pos", (end - size).cast("long").alias("start"), end.cast("long").alias("end"), "value").filter("value is not null and value <> ''")


def _parts(text: Column, pattern: str) -> Column:
    """Pairs of what lies before a match and the match; the last has a gap only."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("value"))


def _keyed(docs: DataFrame) -> DataFrame:
    return keyed(docs).withColumn("th", _text_key(F.col("text")))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(th, text): every text of keyed documents once, without null and empty ones.  Most texts
    have no copy and are passed on where they lie; only those with copies are brought together."""
    docs = docs.filter("text <> ''")
    copied = written(docs.groupBy("th").agg(F.count("*").alias("n")).filter("n > 1").select("th"))
    keys = few(copied)
    if keys is None:
        return docs.select("th", "text").dropDuplicates(["th"])
    alone = docs.join(keys, "th", "left_anti").select("th", "text")
    return alone.union(docs.join(keys, "th", "left_semi").select("th", "text").dropDuplicates(["th"]))


def entities(texts: DataFrame) -> DataFrame:
    """(th, kind, start, end, value) of every valid base match of distinct texts."""
    hit = {k: F.when(F.col("text").rlike(GUARDS[k]) if k != "email" else F.contains("text", F.lit("@")), F.col("text").rlike(PATTERNS[k])).otherwise(False) for k in KINDS}
    some = texts.filter(hit["email"] | hit["ip"] | hit["card"] | hit["phone"])
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), _parts(F.col("text"), PATTERNS[k]).alias("parts")) for k in KINDS)))
    rows = some.select("th", kinds.alias("k")).select("th", F.col("k.kind").alias("kind"), F.col("k.parts").alias("parts"))
    return _placed(rows, ["th", "kind"]).filter(_valid(F.col("kind"), F.col("value"))).drop("pos")


def protected(kind: Column, value: Column) -> Column:
    """The names of the entities that a base value stands for: value, owner, personal data as such."""
    value, digits = F.lower(value), _digits(value)
    owner = (
        F.when(kind == "email", F.substring_index(value, "@", -1))
        .when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.substring(digits, 1, 6))
        .otherwise(F.substring(digits, 1, 4))
    )
    exact = F.when(kind.isin("card", "phone"), digits).otherwise(value)
    return F.array(F.concat_ws(":", F.lit("value"), kind, exact), F.concat_ws(":", F.lit("owner"), kind, owner), F.lit("any"))


def _form(term: Column) -> Column:
    """The form of a long term with digits: letters among them or not, and its length."""
    return F.concat(F.when(term.rlike(r"\p{L}"), "#x").otherwise("#n"), F.length(term).cast("string"))


def _wilson(k: Column, n: Column, z: float) -> Column:
    """The lower end of Wilson's interval for k of n."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _set(name: str) -> list[Column]:
    """Two 64-bit fingerprints of a set of texts, whatever their order."""
    return [F.bit_xor(F.xxhash64(F.lit(k), "th")).alias(f"{name}{k}") for k in (1, 2)]


def _text_key(text: Column) -> Column:
    """128 bits, so that no two texts of any corpus share a key."""
    return F.md5(text)


def _beside(terms: DataFrame, found: DataFrame) -> DataFrame:
    """The terms that overlap no base match: in text order, each looks back to the
    furthest end and ahead to the next start of a match."""
    rows = terms.withColumn("base", F.lit(False)).unionByName(found.select("th", "start", "end", F.lit(None).cast("string").alias("value"), F.lit(True).alias("base")))
    order = "over (partition by th order by start, base desc"
    past = F.expr(f"max(case when base then end end) {order} rows between unbounded preceding and current row)")
    ahead = F.expr(f"lead(case when base then start end) ignore nulls {order})")
    rows = rows.withColumns({"past": past, "ahead": ahead})
    return rows.filter("not base and coalesce(past <= start, true) and coalesce(ahead >= end, true)").drop("base", "past", "ahead")


def disclosing(texts: DataFrame, found: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, z: float = Z) -> DataFrame:
    """(th, kind, start, end, value): the terms of distinct texts with base matches that give one of their entities away."""
    holds = found.select("th", F.explode(protected(F.col("kind"), F.col("value"))).alias("entity")).distinct()
    n = texts.count()
    df_e = holds.groupBy("entity").agg(F.count("*").alias("df_e"), *_set("e")).filter(F.col("df_e").between(2, n - 1))
    holds = written(holds.join(written(df_e), "entity"))  # no other entity can be told
    owners = holds.select("th").distinct()
    private = texts.join(few(owners) or owners, "th", "left_semi")
    terms = _beside(_placed(private.select("th", _parts(F.col("text"), TERM).alias("parts")), ["th"]).drop("pos"), found)
    # a form is a further name of the same place
    term = F.lower("value")
    names = F.explode(F.when(term.rlike(rf"^{_FORMED}$"), F.array(term, _form(term))).otherwise(F.array(term)))
    terms = written(terms.select("th", "start", "end", "value", names.alias("term")))

    beside = written(terms.select("th", "term").distinct())
    wanted = written(beside.groupBy("term").agg(F.count("*").alias("df_p"), *_set("t")).filter("df_p > 1"))
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), BETWEEN, -1))).alias("term"))
    forms = texts.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(_FORMED), 0), _form))).alias("term"))
    met = words.union(forms)
    if (names := few(wanted.select("term"))) is not None:  # else all terms are counted
        met = met.join(names, "term", "left_semi")
    df_t = met.groupBy("term").agg(F.count("*").alias("df_t"))
    df_t = written(wanted.join(df_t, "term"))
    # names that stand in the same texts are one class: a text meets classes of terms with classes of entities
    of_term, of_entity = ["t1", "t2", "df_t", "df_p"], ["e1", "e2", "df_e"]
    classed = written(beside.join(few(df_t) or df_t, "term"))
    both = classed.select("th", *of_term).distinct().join(holds.select("th", *of_entity).distinct(), "th")
    # p is df_te / df_t at most, and df_te is neither over df_e nor over the private texts with the term
    most = F.least("df_e", "df_p") * F.pow(n / F.col("df_e"), 1 - generalise) * (1 + 1e-9)
    both = written(both.filter(F.col("df_t") <= most))
    pairs = both.groupBy(*of_term, *of_entity).agg(F.count("*").alias("df_te")).filter("df_te > 1")
    share = lambda p: F.log(p * n / F.col("df_e")) / F.log(n / F.col("df_e"))
    sure = share(_wilson(F.col("df_te"), F.col("df_t"), z))
    scored = written(pairs.filter(sure >= generalise).select(*of_term, *of_entity, share(F.col("df_te") / F.col("df_t")).alias("share")))
    told = both.join(few(scored) or scored, [*of_term, *of_entity]).groupBy("th", *of_term).agg(F.max("share").alias("share"))
    told = classed.join(told, ["th", *of_term]).select("th", "term", "share")
    hit = terms.join(told, ["th", "term"]).groupBy("th", "start", "end", "value").agg(F.max("share").alias("share"))
    return hit.select("th", F.when(F.col("share") >= remove, TERM_KINDS[1]).otherwise(TERM_KINDS[0]).alias("kind"), "start", "end", "value")


def all_spans(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, z: float = Z) -> DataFrame:
    """(th, spans): base and added spans of each text of keyed documents that has any, by start and kind."""
    texts = distinct_texts(docs)
    found = written(entities(texts))
    every = found.unionByName(disclosing(texts, found, generalise, remove, z))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS + TERM_KINDS)), F.col("kind")).cast("int")
    return written(every.groupBy("th").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "value"))).alias("spans")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, z: float = Z) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, n_term,
    base_sha256, spans (text), span_list.

    Null and empty texts have no spans; repeated rows get one row each and count as
    one text; a null doc_id is kept; an entity that every text holds discloses nothing.
    """
    docs = _keyed(docs)
    spans = all_spans(docs, generalise, remove, z)
    rows = docs.select("doc_id", "th").join(spans, "th", "left").select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("span_list"))
    count = lambda *kinds: F.size(F.filter("span_list", lambda s: s["kind"].isin(*kinds))).cast("long")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        count(*TERM_KINDS).alias("n_term"),
        F.sha2(_joined(F.filter("span_list", lambda s: s["rank"] <= len(KINDS))), 256).alias("base_sha256"),
        _joined(F.col("span_list")).alias("spans"),
        "span_list",
    )


def sanitised(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, z: float = Z) -> DataFrame:
    """``docs`` with entities replaced by [KIND], generalised terms by [NUMBER], [NAME] or
    [WORD], and removed terms left out; of spans that overlap the first counts.  Other
    columns are unchanged, whatever their names, but ``n_chars``, if there, counts the new text.

    Null and empty texts stay as they are; repeated rows and null ids stay, one row each.
    """
    spans = all_spans(_keyed(docs), generalise, remove, z)
    word = lambda v: F.when(v.rlike("[0-9]"), "[NUMBER]").when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    token = lambda s: F.when(s["kind"] == TERM_KINDS[1], "").when(s["kind"] == TERM_KINDS[0], word(s["value"])).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    # the columns travel as one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns)).alias("row"), _text_key(F.col("text")).alias("th"))
    text = F.col("row")["text"]
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), token(s)).alias("out"))
    )
    new = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    keys = few(spans.select("th"))
    parts = [rows]
    if keys is not None:  # only texts with spans are shuffled to meet them
        parts = [rows.join(keys, "th", "left_semi"), rows.join(keys, "th", "left_anti")]
    joined = [parts[0].join(spans, "th", "left").select("row", F.when(F.col("spans").isNull(), text).otherwise(new).alias("new"))]
    joined += [p.select("row", text.alias("new")) for p in parts[1:]]
    both = reduce(DataFrame.union, joined)
    columns = [F.col("new").alias("text") if c == "text" else F.length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return both.select(*columns)
