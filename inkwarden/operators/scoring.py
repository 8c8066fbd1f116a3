"""Findings to a score of 0..100 and a verdict per document.

Weights times confidences are summed as decimals, so that the result doesn't depend on the order in which
partitions are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.plans import phrases as P


def points(layer: Column, severity: Column) -> Column:
    """A finding's points before its confidence counts."""
    out = F
    for name, table in P.WEIGHTS.items():
        for level, weight in table.items():
            out = out.when((layer == name) & (severity == level), weight)
        out = out.when(layer == name, P.DEFAULT_WEIGHT[name])
    return out.otherwise(0)


def verdict(score: Column) -> Column:
    return F.when(score <= 20, "clean").when(score <= 44, "suspicious").otherwise("malicious")


def score(findings: DataFrame, documents: DataFrame, key: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: key, score int, verdict, n_findings, and what `also` aggregates over its findings.

    findings: key, layer, severity, category, confidence.  documents: key and, optionally, macro_present and
    ai_cleared (both false if missing); documents without findings score 0, or 30 with a macro.
    A document is cleared only if a semantic pass ended well and found nothing; that is for the caller
    to say, so a failed pass clears nothing.
    """
    flag = lambda n: F.coalesce(F.col(n), F.lit(False)) if n in documents.columns else F.lit(False)
    docs = documents.select(key, flag("macro_present").alias("macro"), flag("ai_cleared").alias("cleared"))
    worth = points(F.col("layer"), F.col("severity")).cast("decimal(5,0)") * F.col("confidence").cast("decimal(12,10)")
    critical = F.col("severity") == "critical"
    flags = {
        "critical": critical, "critical_semantic": critical & (F.col("layer") == "semantic"),
        "critical_direct": critical & (F.col("layer") != "semantic") & F.col("category").isin(*P.DIRECT_CATEGORIES),
    }
    # One aggregation: weak findings only count towards n.
    strong = F.col("confidence") >= P.CONFIDENCE_FLOOR
    capped = [F.least(F.coalesce(F.sum(F.when(strong & (F.col("layer") == n), worth)), F.lit(0)), F.lit(cap)).cast("decimal(20,10)").alias(n) for n, cap in P.CAPS.items()]
    sums = findings.groupBy(key).agg(*capped, *(F.bool_or(strong & c).alias(n) for n, c in flags.items()), F.count(F.lit(1)).alias("n"), *(c.alias(n) for n, c in (also or {}).items()))
    out = docs.join(sums, key, "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(20,10)"))
    halved = F.when(F.col("cleared"), F.lit(0.5).cast("decimal(2,1)")).otherwise(F.lit(1).cast("decimal(2,1)"))
    raw = F.least(F.floor((part("pattern") + part("heuristic")) * halved + part("semantic")).cast("int"), F.lit(100))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    at_least = lambda test, least, x: F.when(test, F.greatest(x, F.lit(least))).otherwise(x)
    plain = at_least(has("critical_semantic"), 45, at_least(has("critical"), 30, at_least(F.col("macro"), 30, raw)))
    cleared = F.when(has("critical_direct"), F.greatest(F.lit(21), F.least(F.lit(30), raw))).otherwise(F.least(raw, F.lit(20)))
    final = F.when(F.col("cleared"), cleared).otherwise(plain)
    return out.select(key, final.alias("score"), verdict(final).alias("verdict"), F.coalesce("n", F.lit(0)).cast("long").alias("n_findings"), *(also or {}))
