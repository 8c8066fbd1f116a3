"""Repeated rows at volume, crowded minimisers, common passages."""

import random

import brute
import numpy as np
import pytest
from inkwarden.llm import substring


def result(df, **kw):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df, **kw).collect()}


def test_very_many_repeated_rows(spark):
    """100 000 rows alike in key and text, and as many with that text under keys of their own."""
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(9999)}" for _ in range(120))
    same = spark.range(100_000).selectExpr("7L AS doc_id", f"'{text}' AS text")
    other = spark.range(100_000).selectExpr("id + 100 AS doc_id", f"'{text}' AS text")
    out = substring.remove_repeats(same.union(other)).groupBy("n_words", "n_removed").count().collect()
    assert sorted((r["n_words"], r["n_removed"], r["count"]) for r in out) == [(120, 0, 100_000), (120, 120, 100_000)]


@pytest.mark.parametrize("room", [1024, 7])
def test_a_passage_that_all_documents_quote(spark, room):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(n)] for n in (55, 70, 120)]
    rows = []
    for i in range(400):
        parts = [word() for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            cut = rng.randint(0, 10)
            parts += p[cut:] + [word() for _ in range(rng.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df, room=room, shard_words=2000) == brute.repeats(rows)


def test_clashing_columns_and_very_long_texts(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, "head " + " ".join(long[70_000:70_100]) + " tail"), (3, " ".join(long[100:]))]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, id int, th int, mh int, part int, gone int")
    out = result(df)
    assert [out[i][1] for i in (1, 2, 3)] == [0, 100, 149_900]


def test_shards_search_streamed_segments_that_they_do_not_hold():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 9, 90).astype(np.uint64)
    contents = [base, np.r_[base[20:], rng.integers(50, 60, 5).astype(np.uint64)], rng.integers(100, 200, 60).astype(np.uint64)]
    found = substring.shard_repeats(contents, np.array([1, 5, 6]), np.array([True, False, False]), np.array([False, True, True]), np.array([True, False, False]))
    assert found == [(1, 0, 70, False), (0, 0, 90, True)]
