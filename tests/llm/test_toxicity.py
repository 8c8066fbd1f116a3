"""Held-out accuracy of the toxicity model, on the test tables and on texts made up here."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwarden.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(4), spark.read.parquet(f"{SF}/labels.parquet")


def rates(docs, labels, model):
    held = toxicity.score(docs.join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0), model)
    rows = held.selectExpr("lang", "toxic", "toxicity >= 0.5 as said").collect()
    share = lambda toxic, lang=None: np.mean([r["said"] for r in rows if r["toxic"] == toxic and lang in (None, r["lang"])])
    return share(1), 1 - share(0), {lang: share(1, lang) for lang in ("en", "de", "fr", "es")}


def test_held_out_recall_whatever_the_share_of_negative_labels(spark, tables):
    docs, labels = tables
    models = []
    for dropped in (0, 50, 90, 100):
        some = labels.where((F.col("toxic") == 1) | (F.pmod(F.xxhash64("doc_id"), F.lit(100)) >= dropped))
        models.append(toxicity.fit(docs, some) if not models or dropped == 100 else models[0])
    assert np.array_equal(models[0].weights, models[-1].weights) and models[0].bias == models[-1].bias
    recall, clean, by_language = rates(docs, labels, models[0])
    assert recall >= 0.9 and clean >= 0.98, (recall, clean)
    assert min(by_language.values()) >= 0.8, by_language


def test_few_positives(spark, tables):
    docs, labels = tables
    few = labels.where("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(120)
    recall, clean, _ = rates(docs, labels, toxicity.fit(docs, few))
    assert recall >= 0.7 and clean >= 0.97, (recall, clean)


def invented(n, share, seed, forms):
    rng = random.Random(seed)
    parts = ["th", "an", "er", "in", "on", "re", "ea", "st", "ou", "ing"]
    rows = []
    for i in range(n):
        toxic = rng.random() < share
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(30, 200))]
        if toxic:
            for _ in range(max(2, len(words) // 50)):
                words[rng.randrange(len(words))] = "grolve" + rng.choice(forms)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_stems_teach_their_unseen_forms_and_repeated_rows_score_alike(spark):
    rows = invented(2500, 0.1, 3, ["th", "an", "er", "in"])
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    unseen = spark.createDataFrame(invented(400, 0.5, 4, ["on", "ea", "ou"]), "doc_id long, text string, toxic int")
    out = toxicity.score(unseen, model).collect()
    assert np.mean([(r["toxicity"] >= 0.5) == r["toxic"] for r in out]) > 0.97
    by_id = {}
    for r in toxicity.score(df.where("doc_id < 50"), model).collect():
        assert by_id.setdefault(r["doc_id"], r["toxicity"]) == r["toxicity"]


def test_long_empty_and_clashing(spark):
    rows = [(1, "vile words " * 300_000, 1), (2, None, 0), (3, "", 0), (4, "", 0)]
    df = spark.createDataFrame([(*r, 0.5, 1, 2, 3) for r in rows], "doc_id long, text string, toxic int, toxicity double, p int, u int, half int")
    model = toxicity.Model(np.full(1 << toxicity.BITS, 1.0, np.float32), -1.0)
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score(df, model).collect()}
    assert out[1] > 0.99 and out[2] == out[3] == out[4]
    fitted = toxicity.fit(df, df.select("doc_id", "toxic"))
    assert all(0 <= r["toxicity"] < 0.5 for r in toxicity.score(df, fitted).collect())
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), df.select("doc_id", "toxic").limit(0))).count() == 0


def test_prior_of_the_corpus():
    rng = np.random.default_rng(2)
    pos = rng.normal(3, 1, 400)
    unl = np.r_[rng.normal(3, 1, 300), rng.normal(-3, 1, 2700)]
    assert abs(toxicity.corpus_prior(pos, unl) - 0.1) < 0.02
