"""Whole licences found in edited and repeated forms."""

import random

import pytest
from inkwarden.llm import license_texts, licenses


def whole(label):
    return max((t for x, t in license_texts.TEMPLATES if x == label), key=len)


def test_every_template_covers_itself_and_edited_copies():
    scanner, rng = licenses.Scanner(), random.Random(1)
    for label, text in license_texts.TEMPLATES:
        words = text.split()
        said = scanner.scan(f"some words before {text.upper()} and after")
        assert said["score"] == 1.0 and label in said["labels"].split(",")
        if len(words) > 100:
            for k in range(0, len(words), 25):
                words[k] = f"x{rng.randrange(99)}"
            said = scanner.scan(" ".join(words))
            assert said["score"] >= 0.8 and label in said["labels"].split(","), (label, said["score"])


def test_a_clause_that_the_template_repeats_does_not_break_the_chain():
    clause = "all rights to the thing are given"
    template = f"first part of it {clause} then the middle part comes {clause} and this is the end of the whole"
    scanner = licenses.Scanner(phrases=(), templates=(("t", template),))
    words = template.split()
    words[len(words) // 2 - 1] = "changed"
    assert scanner.scan(" ".join(words))["score"] > 0.8
    tail = " ".join(template.split()[-20:])
    (span,) = scanner.scan(f"{clause} {tail}")["spans"] or [None]
    assert span is None or span["coverage"] <= 1


def test_clean_words_and_half_a_licence():
    scanner = licenses.Scanner()
    half = " ".join(whole("isc").split()[:50])
    assert "isc" not in scanner.scan(half)["labels"] and 0.3 < scanner.scan(half)["score"] < 0.8
    assert scanner.scan("the software is good and the license is long")["labels"] == ""


def test_long_repeated_and_clashing(spark):
    text = "word " * 200_000 + whole("mit") + " word" * 200_000
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, "", "x"), (3, None, "x"), (4, "the " * 300_000, "x")], "doc_id long, text string, license string")
    rows = [(r["doc_id"], r["labels"], r["score"]) for r in licenses.scan(df).select("doc_id", "license.*").collect()]
    assert sorted(rows)[:4] == [(1, "mit", 1.0), (1, "mit", 1.0), (2, "", 0.0), (3, "", 0.0)]


def test_templates_from_a_folder(tmp_path):
    (tmp_path / "Own-1.0").write_text("This is the whole text of a licence that nobody uses, clause by clause.")
    scanner = licenses.Scanner(templates=license_texts.templates_from(str(tmp_path)))
    assert scanner.scan("see: this is the whole text of a licence that nobody uses clause by clause")["labels"] == "own-1.0"


@pytest.mark.parametrize("n", [300])
def test_ends_hold_all_places(n):
    rng = random.Random(n)
    template = [rng.randint(1, 3) for _ in range(n)]
    machine = licenses.Automaton([template])
    for _ in range(200):
        at, size = rng.randrange(n - 8), rng.randint(1, 8)
        piece = template[at : at + size]
        state = 0
        for token in piece:
            state = machine.next[state][token]
        assert machine.ends[state][0] == [k + size for k in range(n - size + 1) if template[k : k + size] == piece]
