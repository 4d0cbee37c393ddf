"""Small overlay files (YAML) as tables: aliases, suppression rules, known false positives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULES = (
    "surface string, target_uri string, case_sensitive boolean, allowed_sections array<string>, forbidden_sections array<string>, "
    "surrounding_any array<string>, surrounding_none array<string>, window_chars int, reason string"
)


def _entries(spark: SparkSession, path: str, key: str, needed: list[str]) -> list[dict]:
    """The list under ``key`` of a YAML file that Spark reads whole; a malformed file is an error."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading overlays needs PyYAML") from e
    text = spark.read.text(path, wholetext=True).first()
    data = yaml.safe_load(text["value"]) if text else None
    rows = (data or {}).get(key) if isinstance(data, dict) or data is None else None
    if rows is None and data is None:
        return []
    if not isinstance(rows, list) or any(not isinstance(r, dict) or any(not r.get(n) for n in needed) for r in rows):
        raise ValueError(f"{path}: {key} must be a list of entries with {', '.join(needed)}")
    return rows


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(concept_uri, surfaces) for ``with_surfaces``."""
    rows = _entries(spark, path, "aliases", ["target_uri", "surfaces"])
    return spark.createDataFrame([(r["target_uri"], [str(s) for s in r["surfaces"]]) for r in rows], "concept_uri string, surfaces array<string>")


def suppression_rules(spark: SparkSession, path: str, window: int = 60) -> DataFrame:
    """Rules with their optional context, for ``suppressed``."""
    out = []
    for r in _entries(spark, path, "rules", ["surface_pattern", "target_concept_uri"]):
        c = r.get("context_required") or {}
        terms = ("allowed_sections", "forbidden_sections", "surrounding_terms_any", "forbidden_surrounding_terms_any")
        out.append((r["surface_pattern"], r["target_concept_uri"], bool(r.get("case_sensitive")), *(c.get(t) for t in terms), int(c.get("surrounding_window_chars", window)), r.get("reason")))
    return spark.createDataFrame(out, RULES)


def false_positives(spark: SparkSession, path: str) -> DataFrame:
    rows = _entries(spark, path, "entries", ["span_lemma", "wrong_uri"])
    return spark.createDataFrame([(r["span_lemma"].lower(), r["wrong_uri"], r.get("family"), r.get("reason")) for r in rows], "span_lemma string, wrong_uri string, family string, reason string")
