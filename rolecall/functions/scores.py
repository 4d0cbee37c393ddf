"""Score functions as native column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def weight_of(key: Column, weights: dict[str, float], default: float = 0.0) -> Column:
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(weights.items())))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def saturation(frequency: Column) -> Column:
    return F.when(frequency < 1, 1.0).otherwise(1 + F.log(1 + frequency))


def confidence(section: Column, kind: Column, frequency: Column) -> Column:
    raw = weight_of(section, C.SECTION_WEIGHTS) * weight_of(kind, C.KIND_WEIGHTS) * saturation(frequency) / (1 + F.log(F.lit(2.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def banded(original: Column, similarity: Column, drop: float = C.DROP, keep: float = C.KEEP) -> Column:
    """(source, confidence) of a lexical candidate given its similarity."""
    if not drop <= keep:
        raise ValueError("drop must not exceed keep")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    source = F.when(similarity >= drop, "lexical_kept").otherwise("lexical_dropped")
    value = F.when(similarity >= keep, unit(0.5 * original + 0.5 * similarity)).when(similarity >= drop, unit(original * similarity / keep)).otherwise(original)
    return F.struct(source.alias("source"), value.alias("confidence"))


def projected(score: Column, t1: float = C.T1, t2: float = C.T2) -> Column:
    """strong, possible or no."""
    if not t2 < t1:
        raise ValueError("t2 must be below t1")
    return F.when(score >= t1, "strong").when(score >= t2, "possible").otherwise("no")


def display_band(score: Column) -> Column:
    percent = F.floor(score * 100 + 0.5)
    out = F.when(F.lit(False), "")
    for least, name in C.BANDS:
        out = out.when(percent >= least, name)
    return out.otherwise("unsuitable")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 for nothing of nothing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def set_prf(predicted: Column, gold: Column) -> Column:
    """Precision, recall, F1 of two sets; an empty prediction has precision 1, an empty gold set recall 1."""
    hit = F.size(F.array_intersect(predicted, gold))
    p = F.when(F.size(predicted) == 0, 1.0).otherwise(hit / F.size(predicted))
    r = F.when(F.size(gold) == 0, 1.0).otherwise(hit / F.size(gold))
    p = F.when((F.size(gold) == 0) & (F.size(predicted) > 0), 0.0).otherwise(p)
    r = F.when((F.size(predicted) == 0) & (F.size(gold) > 0), 0.0).otherwise(r)
    return F.struct(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def class_distance(a: Column, b: Column) -> Column:
    rank = lambda c: F.when(c == "strong", 2).when(c == "possible", 1).otherwise(0)
    return F.abs(rank(a) - rank(b))


def number(value: Column) -> Column:
    """A string as a number, or null where it is none."""
    return F.trim(value).try_cast("double")
