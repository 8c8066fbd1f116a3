"""Recall against full Smith-Waterman on edited copies, and seeds that very many items share."""

import random

import numpy as np
import pytest
from inkwarden.llm import decontaminate
from inkwarden.llm.hashing import Hashes

SF = "/root/testdata/sf0.001"


def edited(words, rate, rng, word):
    out = []
    for w in words:
        if rng.random() >= rate:
            out.append(w)
            continue
        kind = rng.randrange(3)
        out += [word()] if kind == 0 else [w, word()] if kind == 1 else []
    return out


def full(docs, items):
    """(doc, item) of all pairs with an alignment of half the perfect score, by the whole table."""
    ids: dict = {}
    coded = lambda text: np.array([ids.setdefault(w, len(ids)) for w in decontaminate.item_words(text)], np.int32)
    texts = {i: coded(t) for i, t in docs}
    out = set()
    for name, item in items:
        a = coded(item)
        for (i, _), (score, _) in zip(docs, decontaminate.align([(a, b) for b in texts.values()]), strict=True):
            if score >= len(a):  # half of 2 per word
                out.add((i, name))
    return out


@pytest.mark.parametrize("percent", [5, 10, 20, 30])
def test_recall_against_full_alignment(spark, percent):
    rng = random.Random(percent)
    word = lambda: f"z{rng.randrange(3000)}"
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:20]
    docs = []
    for k in range(200):
        _, text = items[k % len(items)]
        docs.append((k, " ".join([word() for _ in range(rng.randint(0, 40))] + edited(text.split(), percent / 100, rng, word) + [word() for _ in range(rng.randint(0, 40))])))
    want = full(docs, items)
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got <= want and len(want) >= 100
    assert len(got) >= 0.97 * len(want), (len(got), len(want))


def test_a_run_that_all_items_share_finds_no_passage(spark):
    rng = random.Random(2)
    tail = lambda: " ".join(f"q{rng.randrange(10**6)}" for _ in range(12))
    rows = [(i, f"which of the following {tail()}") for i in range(20_000)] + [(20_000, "which of the following")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    seeds = decontaminate.rare_seeds(bench.withColumnsRenamed({"item_id": "item"}))
    block = decontaminate.Block(seeds.where("item < 20000").collect())
    shared = set(decontaminate.seed_hashes(decontaminate.item_words("which of the following"), Hashes()).tolist())
    assert not shared & set(block.seeds.tolist()) and max(map(len, block.places)) <= decontaminate.RARE
    docs = [(i, f"text {i} asks which of the following is it then") for i in range(300)] + [(900, f"well {rows[17][1]} ok")]
    out = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    found = {(r["doc_id"], r["item_id"]) for r in out.collect()}
    # The item that is nothing but the shared run keeps it: it has no rarer one.
    assert found == {(i, 20_000) for i, _ in docs} | {(900, 17)}


def test_long_texts_ties_and_clashing_columns(spark):
    rng = random.Random(3)
    item = " ".join(f"i{k}" for k in range(25))
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long} {item}", 0, 0, "t"), (1, "other", 0, 0, "t"), (2, item, 0, 0, "t")], "doc_id long, text string, id int, item int, t string")
    bench = spark.createDataFrame([(7, item, 0.0), (8, item, 0.0), (7, item, 0.0)], "item_id long, text string, score double")
    out = sorted((r["doc_id"], r["item_id"], r["score"], r["first_word"], r["end_word"]) for r in decontaminate.leaks(docs, bench).collect())
    assert out == [(1, 7, 1.0, 200_000, 200_025), (1, 8, 1.0, 200_000, 200_025), (2, 7, 1.0, 0, 25), (2, 8, 1.0, 0, 25)]
