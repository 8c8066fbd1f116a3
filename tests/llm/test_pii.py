"""Added and rejected spans, reliabilities, and the test tables' secrets."""

import pytest
from inkwarden.llm import pii, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
HEX = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def corpus(spark, extra):
    rows = []
    for i in range(40):
        rows += [f"please write to joe{i}.doe@mail.example.com about it", f"the server at 93.{i + 1}.7.{i + 2} answers", f"call +1 (212) 555-01{i % 90 + 10} now", f"visa 4111 1111 1111 1111 is case {i}"]
        rows += [f"release version 1.{i}.{i + 3} and part 300.{i}.999.1 are out", f"order {4111111111111110 - 10 * i + 2} left", f"user{i}@localhost rang", f'token = "{HEX[:-2]}{i:02d}" stays here']
        rows += [f"commit {HEX[:-2]}{i:02d} of the tree", f"mail jane{i} [at] example [dot] com today", f"isbn 212-555-01{i % 90 + 10} on page {i}", f"phone (212) 555-02{i % 90 + 10} or so"]
    return spark.createDataFrame(list(enumerate(rows + extra)), "doc_id long, text string").repartition(3)


def test_added_and_rejected_spans(spark):
    extra = ['password: "hunter2hunter2AA99" ok', "commit 1f86d081884c7d659a2feaa0c55ad015a3bf4f1b end", "version 3.14.159 only", "phone (212) 555-0188 please", "mail ann [at] example [dot] org now", None, ""]
    docs = corpus(spark, extra)
    found = {r["doc_id"]: r for r in pii.fit_detect(docs).collect()}
    cut = lambda i: [(s["kind"], found[i]["text"][s["start"] : s["end"]], s["base"]) for s in found[i]["pii"]]
    at = 480
    assert cut(at) == [("secret", "hunter2hunter2AA99", False)]
    assert cut(at + 1) == [] and cut(at + 2) == []
    assert cut(at + 3) == [("phone", "(212) 555-0188", False)]
    assert cut(at + 4) == [("email", "ann [at] example [dot] org", False)]
    assert found[at + 5]["pii"] == [] == found[at + 6]["pii"]
    for i in range(0, 480, 12):
        assert [k for k, _, base in cut(i) + cut(i + 1) + cut(i + 2) + cut(i + 3) if base] == ["email", "ip", "phone", "card"]
        assert not cut(i + 4) and all(base for *_, base in cut(i + 5)) and not cut(i + 6) and cut(i + 7)[0][0] == "secret" and not cut(i + 8)


def test_reliabilities_tell_true_from_false_candidates(spark):
    model = pii.fit(corpus(spark, []))
    for kind in pii.KINDS:
        good, bad = model.reliability[kind]["v_near=1" if kind == "secret" else "v_check=1"]
        assert good > 0.7 and bad < 0.7 and good > bad + 0.2, (kind, good, bad)
    lonely = pii.fit_counts({(0, 1, 1, 1, 0, 1, 2, 1, 0): 200, (2, -1, -1, -1, 0, 1, 2, 4, 0): 100, (2, 1, 1, 1, 0, 1, 2, 4, 0): 100})
    assert lonely.reliability["email"]["v_form=1"][1] < 0.25  # email shows no false candidate; card does


def test_secrets_of_the_test_tables(spark):
    out = queries.op1_pii(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id")
    with_secret, found, n_added = out.select(F.count_if(F.col("text").contains('token = "')), F.count_if(F.col("text").contains('token = "') & F.col("spans").contains("secret:")), F.count_if(F.col("spans").contains("secret:"))).first()
    assert with_secret == found == n_added > 0


@pytest.mark.parametrize("n", [200_000])
def test_long_texts_of_loose_candidates(spark, n):
    rows = list(enumerate(("1." * n, "a@" * n, "x" * n + "1", "00" * n, "[at]" * (n // 4), "a1b2" * (n // 4))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert pii.detect(docs, pii.fit_counts({})).count() == 6
