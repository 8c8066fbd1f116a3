"""Token counts of texts outside the plain letters, and the bounded tables."""

import pytest
from inkwarden.llm import token_counts

P = pytest.importorskip("public_tokenizers")

ODD = [
    "she said “well, it’s done” – and left…", "日本語 の テキスト です。 mixed words", "emoji 😀 and 👩‍👩‍👧 end", "a b  c 　d  e", "x ² y ½ z", "Привет мир, как дела?", " leading", "trailing ", "two  spaces“ ”",
    "​ zero ​ width", "tab\t“x”\n\n“y”  \n", "don’t 's 't “'s", "a \x1c b \x85 c", "ﬁ ligature ﬀ", "é combining e ́x", "<|endoftext|> “inside”", "नमस्ते दुनिया", "a “b c” d" * 50, "퟿  private", "٣ ४ digits ５",
]


def test_odd_texts_equal_the_library(spark):
    path = P.path("byte_bpe_50k.json")
    tokenizer = token_counts.load(path)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    out = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, path).collect()}
    assert out == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(ODD)}


def test_random_mixtures_equal_the_library():
    import random

    path = P.path("byte_bpe_50k.json")
    tokenizer = token_counts.load(path)
    lengths, special = token_counts.Lengths({}, tokenizer, 100), token_counts.special_strings(tokenizer)
    rng = random.Random(3)
    letters = list("ab'st 1\n\t.,  ") + ["“", "’", "é", "漢", " ", " ", "²", "😀", "‍", "ñ", "́", " ", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        assert token_counts.count(text, lengths, special) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_long_texts_and_an_empty_sample(spark):
    path = P.path("byte_bpe_50k.json")
    tokenizer = token_counts.load(path)
    texts = ["word " * 200_000, "“word” " * 20_000, None, ""]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    out = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, path, fit_rows=0).collect()}
    assert out == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
