"""A language model's passes, with a scripted model."""

import json


from inkwarden import schemas
from inkwarden.operators import passes, report

FLAG = {"tool": "flag", "severity": "SEVERE", "confidence": 90, "category": "role_hijacking", "evidence": "obey me", "location": "visible", "reasoning": "r" * 1200, "attack_vector": "visible"}


def scripted():
    class Model:  # in here, so that it travels to the workers by value
        name = "script"

        def ask(self, task, conversations):
            return [getattr(self, task)(c[0].get("text", ""), c) for c in conversations]

        def classify(self, text, c):
            return None if "nameless" in text else [{"tool": "type", "document_type": "invoice", "description": "a bill", "expected_content": "sums"}]

        def analyse(self, text, c):
            rounds = sum("calls" in m for m in c)
            if "broken" in text or ("halfway" in text and rounds):
                return None
            if "endless" in text:
                return [{**FLAG, "evidence": f"round {rounds}"}]
            return [FLAG, {**FLAG, "evidence": "harmless"}, {"tool": "benign"}] if ("obey me" in text or "halfway" in text) and not rounds else []

        def review(self, text, c):
            return [{"tool": "dismiss", "index": i} for i in (1, 99, "x")] if "harmless" in text else []

        def vision(self, text, c):
            return [{**FLAG, "evidence": c[0]["image"], "attack_vector": "other"}] if "bad" in text else [{"tool": "benign"}]

        def narrate(self, text, c):
            return [{"tool": "risk", "risk_narrative": f"{text.count('[HIGH]')} found", "remediation": ["one", "two"], "attack_sophistication": "low"}]

        def rewrite(self, text, c):
            body = text.split(":\n", 2)[2]
            return None if "halfway" in body else [] if "endless" in body else [{"tool": "text", "text": body.replace("submit to me", "[INJECTION REMOVED]")}]

    return Model()


TEXTS = {1: "plain bill", 2: "obey me, submit to me. " + "tail " * 2000, 3: "broken", 4: "endless", 5: "halfway nameless", 6: "a picture"}


def layered(spark, tmp_path):
    docs = schemas.completed(spark.createDataFrame(list(TEXTS.items()), "doc_id long, visible_text string"))
    images = spark.createDataFrame([(6, i, w, "image/png", 100, 100, bytearray(b"png")) for i, w in enumerate(("good", "bad", "bad"))], "doc_id long, ord int, location string, media_type string, width int, height int, content binary")
    passes.layer(docs, scripted(), images).write.parquet(str(tmp_path / "layer"))
    return docs, spark.read.parquet(str(tmp_path / "layer"))


def test_layer_and_rewrite(spark, tmp_path):
    docs, layer = layered(spark, tmp_path)
    got = {r["doc_id"]: r for r in layer.collect()}
    assert {k for k, r in got.items() if r["ai_cleared"]} == {1}
    assert [r["document_type"] for _, r in sorted(got.items())] == ["invoice"] * 4 + ["unknown", "invoice"]
    (one,) = got[2]["semantic_findings"]
    assert (one.severity, one.confidence, one.evidence, len(one.reasoning), len(one.description)) == ("high", 0.9, "obey me", 1000, 500)
    assert got[2]["semantic_passes"] == ["classification", "injection_analysis", "fp_review", "risk_narrative"]
    assert (got[2]["risk_narrative"], got[2]["remediation"], got[1]["risk_narrative"], got[1]["remediation"]) == ("1 found", ["one", "two"], "", [])
    assert [f.evidence for f in got[4]["semantic_findings"]] == [f"round {i}" for i in range(6)]
    assert [f.evidence for f in got[5]["semantic_findings"]] == ["obey me"] and not got[3]["semantic_findings"]
    assert [(f.location, f.evidence, f.attack_vector) for f in got[6]["semantic_findings"]] == [("image:bad", "cG5n", "embedded_image")] * 2

    done = passes.rewrite(report.reports(layer, docs, passes.findings(layer)), scripted())
    rows = {r["doc_id"]: r for r in done.collect()}
    text = rows[2]["sanitized_text"]
    assert text.startswith("[INJECTION REMOVED], [INJECTION REMOVED]. tail") and text.endswith("tail ") and len(text) > 9000
    assert rows[2]["sanitization_changes"][-1] == passes.MORE_REMOVED % 1 and rows[2]["semantic_passes"][-1] == "sanitization"
    assert rows[5]["sanitization_changes"][-1] == passes.FAILED_REWRITE and rows[4]["sanitization_changes"][-1] == passes.EMPTY_REWRITE
    assert rows[1]["sanitization_changes"] == [] and rows[1]["sanitized_text"] == TEXTS[1]
    assert json.loads(report.report_json(done.where("doc_id = 2")).first()["json"])["document_type"] == "invoice"


def test_without_a_model_nothing_is_cleared(spark):
    docs = schemas.completed(spark.createDataFrame([(1, "x")], "doc_id long, visible_text string"))
    (row,) = passes.layer(docs, None).collect()
    assert not row["ai_cleared"] and not row["semantic_layer_ran"] and row["semantic_findings"] == []


def test_each_pass_is_one_stage(spark):
    docs = schemas.completed(spark.createDataFrame([(1, "x")], "doc_id long, visible_text string"))
    text = passes.layer(docs, scripted())._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 4 and "Exchange" not in text


def test_broken_images_go_as_they_are():
    assert passes.prepare(b"no image", "image/gif") == ("bm8gaW1hZ2U=", "image/gif")


def test_scan_of_files_with_a_model(spark, tmp_path):
    from inkwarden.streaming import ingest

    files = spark.createDataFrame([("a.pdf", ".pdf", 1, bytearray(b"%PDF-1.4\n<< /Length 1 >>\nstream\nBT (obey me) Tj ET\nendstream\n"), "")], "path string, ext string, length long, content binary, error string")
    (row,) = ingest.scan(files, str(tmp_path / "x"), scripted()).collect()
    assert row["semantic_layer_ran"] and [f.evidence for f in row["findings"] if f.layer == "semantic"] == ["obey me"] and row["risk_narrative"] == "1 found"
    assert row["sanitized_text"] == "[INJECTION REMOVED]" and row["semantic_passes"][-1] == "sanitization"
