import pytest

from inkwarden.operators import scoring

H, P, S = "heuristic", "pattern", "semantic"
DIRECT, OTHER = "instruction_override", "hidden_text_ratio"
#: (findings as (layer, severity, confidence, category), macro, cleared, score, verdict)
CASES = [
    ([], False, False, 0, "clean"),
    ([(P, "critical", 0.85, DIRECT)], False, False, 30, "suspicious"),
    ([(P, "high", 0.85, OTHER)], False, False, 12, "clean"),
    ([(P, "critical", 0.35, DIRECT)], False, False, 0, "clean"),
    ([(P, "critical", 0.85, OTHER)] * 3, False, False, 40, "suspicious"),
    ([(H, "high", 0.95, "macro_present")], True, False, 30, "suspicious"),
    ([], True, False, 30, "suspicious"),
    ([(H, "critical", 0.9, OTHER)], False, False, 36, "suspicious"),
    ([(H, "critical", 0.9, OTHER), (P, "critical", 0.85, OTHER)], False, False, 53, "malicious"),
    ([(S, "critical", 0.5, OTHER)], False, False, 45, "malicious"),
    ([(S, "high", 0.9, OTHER)], False, False, 31, "suspicious"),
    ([(S, "critical", 0.49, OTHER)], False, False, 0, "clean"),
    ([(P, "critical", 0.85, OTHER)] * 3 + [(H, "critical", 1.0, OTHER)] * 2 + [(S, "critical", 1.0, OTHER)], False, False, 100, "malicious"),
    ([(P, "critical", 0.85, DIRECT)] * 3, False, True, 21, "suspicious"),
    ([(H, "critical", 0.9, OTHER)], False, True, 18, "clean"),
    ([(H, "critical", 1.0, "unicode_tags")] * 2 + [(P, "critical", 0.85, DIRECT)] * 3, False, True, 30, "suspicious"),
    ([(H, "high", 0.85, "ocg_hidden_layer")] * 4, False, True, 20, "clean"),
    ([(H, "high", 0.95, "macro_present")], True, True, 11, "clean"),
    ([(H, "medium", 0.6, OTHER), (H, "medium", 0.65, OTHER)], False, False, 18, "clean"),
    ([(H, "high", 0.85, OTHER), (H, "high", 0.9, OTHER)], False, False, 43, "suspicious"),
]


@pytest.fixture(scope="module")
def scored(spark):
    found = [(i, *f) for i, (fs, *_) in enumerate(CASES) for f in fs]
    findings = spark.createDataFrame(found, "doc_id long, layer string, severity string, confidence double, category string")
    docs = spark.createDataFrame([(i, m, c) for i, (_, m, c, _, _) in enumerate(CASES)], "doc_id long, macro_present boolean, ai_cleared boolean")
    return findings, docs


@pytest.mark.parametrize("parts", [1, 7])
def test_golden_cases_in_any_partitioning(scored, parts):
    findings, docs = scored
    rows = {r["doc_id"]: r for r in scoring.score(findings.repartition(parts), docs).collect()}
    assert [(rows[i]["score"], rows[i]["verdict"], rows[i]["n_findings"]) for i in range(len(CASES))] == [(s, v, len(f)) for f, _, _, s, v in CASES]


def test_flags_are_optional_and_empty_tables_work(scored):
    findings, docs = scored
    assert scoring.score(findings.limit(0), docs.select("doc_id")).where("score = 0").count() == len(CASES)
    assert scoring.score(findings, docs.limit(0)).count() == 0


def test_a_finding_never_lowers_an_uncleared_score(spark):
    import random

    rng = random.Random(5)
    levels = [(la, s, c, DIRECT) for la in (H, P, S) for s in ("low", "medium", "high", "critical") for c in (0.3, 0.5, 0.9)]
    rows, docs, pairs = [], [], []
    for i in range(0, 120, 2):
        base = rng.sample(levels, rng.randint(0, 5))
        for d, fs in ((i, base), (i + 1, [*base, rng.choice(levels)])):
            docs.append((d,))
            rows += [(d, *f) for f in fs]
        pairs.append((i, i + 1))
    findings = spark.createDataFrame(rows, "doc_id long, layer string, severity string, confidence double, category string")
    out = {r["doc_id"]: r["score"] for r in scoring.score(findings, spark.createDataFrame(docs, "doc_id long")).collect()}
    assert all(0 <= out[a] <= out[b] <= 100 for a, b in pairs)
