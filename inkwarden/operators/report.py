"""Findings of all layers, reports per document, and what a reader is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwarden.functions import text as T
from inkwarden.operators import heuristics, patterns, scoring, surfaces

LAYERS = ("pattern", "heuristic", "semantic")
FIELDS = ("layer", "severity", "category", "description", "evidence", "location", "confidence", "reasoning", "attack_vector")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)


def all_findings(extracted: DataFrame, semantic: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Pattern, heuristic and semantic findings, in this order: key, layer_ord, ord, then FIELDS."""
    found = patterns.pattern_findings(surfaces.surfaces(extracted, key), key)
    order = F.struct("surface_ord", "rule_id", "match_ord")
    parts = [found.select(key, F.lit(0).alias("layer_ord"), order.alias("ord"), *FIELDS)]
    zero = lambda c: F.struct(F.lit(0).alias("surface_ord"), F.lit(0).alias("rule_id"), F.col(c).cast("int").alias("match_ord"))
    parts.append(heuristics.heuristic_findings(extracted, key).select(key, F.lit(1).alias("layer_ord"), zero("ord").alias("ord"), *FIELDS))
    if semantic is not None:
        parts.append(semantic.select(key, F.lit(2).alias("layer_ord"), zero("ord").alias("ord"), *FIELDS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_findings(findings: DataFrame, most: int = 10, key: str = "doc_id") -> DataFrame:
    """The first `most` findings of a document by severity, layer and order: + rank, and n_more of the document."""
    w = Window.partitionBy(key).orderBy(severity_rank(F.col("severity")), "layer_ord", "ord")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return findings.withColumns({"rank": F.row_number().over(w), "n_more": F.greatest(n - most, F.lit(0))}).where(F.col("rank") <= most)


#: What a semantic layer adds to a report, and what stands there if none has run.
SEMANTIC_DEFAULTS = {
    "document_type": "unknown", "document_description": "", "risk_narrative": "", "attack_scenario": "", "remediation": None,
    "attack_sophistication": "", "semantic_layer_ran": False, "semantic_model": "", "semantic_passes": None,
}


def reports(documents: DataFrame, extracted: DataFrame, semantic: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """One report per document: file facts and semantic results from documents where it has them (file, file_hash,
    scan_duration_ms, ai_cleared, the columns of SEMANTIC_DEFAULTS), score, verdict, findings in order, sanitized
    text and its changes, exit code."""
    found = all_findings(extracted, semantic, key)
    facts = [c for c in ("file", "file_hash", "scan_duration_ms", "ai_cleared", *SEMANTIC_DEFAULTS) if c in documents.columns]
    flags = extracted.select(key, "macro_present", "visible_text").join(documents.select(key, *facts), key, "left")
    row = F.struct("layer_ord", "ord", F.struct(*FIELDS).alias("f"))
    # One aggregation for score and list, so that rules and checks run once.
    scored = scoring.score(found, flags, key, {"findings": F.transform(F.sort_array(F.collect_list(row)), lambda x: x.f)})
    out = flags.join(scored, key)
    none = F.filter(F.array(F.struct(*(F.lit(0.0 if n == "confidence" else "").alias(n) for n in FIELDS))), lambda x: F.lit(False))
    default = lambda v: F.array().cast("array<string>") if v is None else F.lit(v)
    filled = {n: F.coalesce(F.col(n), default(v)) if n in facts else default(v) for n, v in SEMANTIC_DEFAULTS.items()}
    out = out.withColumns({"findings": F.coalesce("findings", none)} | filled).withColumn("__s", T.sanitize(F.col("visible_text"), F.col("findings")))
    return out.withColumns({"sanitized_text": F.col("__s.text"), "sanitization_changes": F.col("__s.changes"), "exit_code": T.exit_code(F.col("verdict"))}).drop("__s", "visible_text")


def report_json(reports: DataFrame, key: str = "doc_id") -> DataFrame:
    return reports.select(key, F.to_json(F.struct("*")).alias("json"))


# Characters of a panel and of an item, items of a panel, reasonings.
PANEL, ITEM, LAYER_ITEM = 2000, 100, 120
MOST_HIDDEN, MOST_ITEMS, MOST_REASONINGS = 20, 10, 5


def panels(extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a reader who wants details is shown of a document: key and a text per kind of content, '' for none."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    lines = lambda items, most, row: F.array_join(F.transform(F.slice(items, 1, most), row), "\n")
    return extracted.select(
        key, F.when(F.col("visible_text") != "", T.left(F.col("visible_text"), PANEL)).otherwise("(empty)").alias("visible"),
        lines("hidden_text", MOST_HIDDEN, lambda h: text("[", h.method, "@", h.location, "]: ", T.left(h.content, ITEM))).alias("hidden"),
        T.left(F.array_join(F.transform("metadata", lambda m: text(m.key, ": ", m.value)), "\n"), PANEL).alias("metadata"),
        lines("actual_text_spans", MOST_ITEMS, lambda s: text("page", s.page, ": visual='", s.visual, "' -> extracted='", s.extracted, "'")).alias("substitutions"),
        lines("tracked_changes", MOST_ITEMS, lambda c: text("[", c.type, ":", c.author, "] ", T.left(c.content, ITEM))).alias("changes"),
        lines("ocg_hidden_text", MOST_ITEMS, lambda h: text("[", h.layer_name, "] ", T.left(h.content, LAYER_ITEM))).alias("layers"),
        lines("unicode_anomalies", MOST_ITEMS, lambda a: text(a.category, " ", a.codepoint, " x", a["count"])).alias("anomalies"),
    )


def reasonings(findings: Column) -> Column:
    """The first reasonings of semantic findings, each under its title."""
    own = F.filter(findings, lambda f: (f.layer == "semantic") & (f.reasoning != ""))
    return F.transform(F.slice(own, 1, MOST_REASONINGS), lambda f: F.concat(F.lit("["), f.severity, F.lit("] "), f.category, F.lit(" @ "), f.location, F.lit("\n"), f.reasoning))
