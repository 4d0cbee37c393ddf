"""The language of a text, by the letter trigrams of known texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, SHORTEST, GAP = 300, 50, 0.1


def trigrams(text: Column) -> Column:
    """Every run of three letters, overlapping, in small letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?=(\p{L}{3}))"), 1)


def profiles(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """(lang, tri, share): the most frequent trigrams of each language of documents (lang, text), with
    their share of all its trigrams; ties go to the first in order."""
    counts = documents.filter("lang is not null").select("lang", F.explode(trigrams(F.col("text"))).alias("tri")).groupBy("lang", "tri").agg(F.count("*").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "tri"))
    return counts.withColumn("r", first).filter(F.col("r") <= size).join(F.broadcast(total), "lang").select("lang", "tri", (F.col("n") / F.col("all")).alias("share"))


def detected(documents: DataFrame, known: DataFrame, shortest: int = SHORTEST, gap: float = GAP) -> DataFrame:
    """(doc_id, language, gap): the language whose profile (lang, tri, share) a text's trigrams weigh most
    in, and by how much of the whole weight it leads.

    It is null, and the text undecided, under ``shortest`` characters, without any
    known trigram, or with a lead under ``gap``.  The profiles, a few hundred
    trigrams a language, become one row for each trigram and are broadcast.
    """
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not names:
        return documents.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("gap"))
    table = known.groupBy("tri").agg(*(F.coalesce(F.max(F.when(F.col("lang") == n, F.col("share"))), F.lit(0.0)).alias(f"w{k}") for k, n in enumerate(names)))
    each = documents.filter(F.length("text") >= shortest).select("doc_id", F.explode(trigrams(F.col("text"))).alias("tri")).join(F.broadcast(table), "tri")
    sums = each.groupBy("doc_id").agg(*(F.sum(f"w{k}").alias(f"w{k}") for k in range(len(names))))
    order = F.sort_array(F.array(*(F.struct(F.col(f"w{k}").alias("w"), F.lit(-k).alias("k")) for k in range(len(names)))), False)
    weight = reduce(lambda a, b: a + b, (F.col(f"w{k}") for k in range(len(names))))
    second = F.coalesce(F.get("o", F.lit(1))["w"], F.lit(0.0))
    best = sums.select("doc_id", order.alias("o"), weight.alias("all")).select("doc_id", ((F.get("o", F.lit(0))["w"] - second) / F.col("all")).alias("gap"), F.get(F.array(*map(F.lit, names)), -F.get("o", F.lit(0))["k"]).alias("found"))
    return documents.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.when(F.col("gap") >= gap, F.col("found")).alias("language"), "gap")
