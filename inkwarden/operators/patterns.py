"""Pattern rules over surfaces: a theta join whose small side is held in the plan as literals.

A rule's regular expression runs only on surfaces that hold one of the rule's literal strings.  The scan
is a narrow projection; what is exploded are matching (surface, rule) pairs, then their matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.functions import text as T
from inkwarden.functions.plan import exploded
from inkwarden.plans.rules import FULL_CONFIDENCE, NOISE_CONFIDENCE, NOISY_ON_VISIBLE, RULES, Rule


def _matching(rules: Sequence[Rule], content: Column, low: Column) -> Column:
    """array<struct<rule_id,regex,severity,category>> of the rules that match."""

    def one(r: Rule) -> Column:
        test = content.rlike(r.java)
        if r.gate:
            gate = low.contains(r.gate[0])
            for literal in r.gate[1:]:
                gate = gate | low.contains(literal)
            test = gate & test
        row = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.java).alias("regex"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"))
        return F.when(test, row)

    return F.array_compact(F.array(*map(one, rules)))


def confidence(is_visible: Column, category: Column) -> Column:
    return F.when(is_visible & category.isin(*NOISY_ON_VISIBLE), NOISE_CONFIDENCE).otherwise(FULL_CONFIDENCE)


def rule_hits(surfaces: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """surfaces with a row for each matching rule: + rule_id, regex, severity, category."""
    low = surfaces.withColumn("__low", T.folded(F.col("content")))
    hits = exploded(low, _matching(rules, F.col("content"), F.col("__low")), "__n", "__r")
    return hits.select("*", "__r.*").drop("__low", "__n", "__r")


def pattern_findings(surfaces: DataFrame, key: str = "doc_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per match, never deduplicated: key, surface_ord, rule_id, match_ord, start, end and the
    finding's fields."""
    rows = exploded(rule_hits(surfaces, rules), T.match_spans(F.col("content"), F.col("regex")), "match_ord", "m")
    return rows.select(
        key, "surface_ord", "rule_id", "match_ord", F.col("m.start").alias("start"), F.col("m.end").alias("end"),
        F.lit("pattern").alias("layer"), "severity", "category",
        F.concat(F.lit("Pattern match: "), "category", F.lit(" in "), "location").alias("description"),
        T.evidence(F.col("content"), F.col("m.start"), F.col("m.end")).alias("evidence"),
        "location", confidence(F.col("is_visible"), F.col("category")).alias("confidence"), F.lit("").alias("reasoning"), F.lit("").alias("attack_vector"),
    )
