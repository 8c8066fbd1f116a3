"""Operators against plain Python on small tables: edge cases, ties, repeated rows, clashing columns."""

import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from inkwarden.llm import decontaminate, licenses, mixing, pii, quality, simhash, substring, token_counts, toxicity, urls  # noqa: E402

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def words(n, salt=0):
    return " ".join(f"{LONG[(i * 7 + salt) % len(LONG)]}{(i * 31 + salt * 17) % 97}" for i in range(n))


PASSAGE = words(60, 5)
TEXTS = [
    None, "", "   \t\n ", "one", "one two", "Ünïcode ñandú 漢字 \U0001f600 ok", words(80), words(80), words(300, 1) + " " + PASSAGE, PASSAGE + " " + words(200, 2),
    "x " * 400, "a b c d e a b c d e f", "write to joe.doe@mail.example.com or +1 (212) 555-0153, 10.0.0.256 and 10.0.0.25", "4111 1111 1111 1111 and 4111 1111 1111 1112 and 0004111111111111111",
    "a@b.c_d@e.f @x.y a@b a..b@c-d.e.f", "1.2.3.4.5.6.7.8 1.2.3 +12345678 +1-2 ++49 30 1234567", "Released under the MIT License. Licensed under the Apache License, Version 2.0. CC BY-NC 4.0",
    "UNDER the mit_license under the mit license", "line\nline\n\n \nline\nother", "a#b $ % & | < > * ok", "<|endoftext|> it's we'll  two  spaces\n\n\nend\u00a0x\u2028y \u00b2 1234", "tab\tsep\x0bvt\x0cff\rcr\x1cfs\x85nel", words(5000, 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "s", 1, "n_words", "pii") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, size string, source string, fp int, n_words string, pii string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, size string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_pii_spans(docs, empty):
    model = pii.fit(docs)
    found = by_id(pii.detect(docs, model).select("doc_id", "pii"))
    for i, t in enumerate(TEXTS):
        got = [(s["kind"], s["start"], s["end"]) for s in found[i]["pii"]]
        assert [g for g, s in zip(got, found[i]["pii"], strict=True) if s["base"]] == brute.pii(t), t
        assert got == sorted(got, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
    assert pii.detect(empty, pii.fit(empty)).count() == 0


def test_pii_redaction(docs):
    out = by_id(pii.redact(pii.detect(docs, pii.fit(docs), out="__s"), spans="__s").select("doc_id", "text"))
    assert out[12]["text"].startswith("write to [EMAIL] or [PHONE], ")
    assert out[0]["text"] is None and out[3]["text"] == "one"


@pytest.mark.parametrize("block", [4, 1024])
def test_redaction_equals_plain_replacement(spark, block):
    import random

    rng, rows = random.Random(6), []
    for i in range(80):
        text = "".join(rng.choice("ab\u00e9\U0001f600 ") for _ in range(rng.randint(0, 60)))
        spans = [(rng.choice(pii.KINDS), a, min(len(text), a + rng.randint(1, 12)), True) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 6)))] if text else []
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "doc_id long, text string, pii array<struct<kind:string,start:int,end:int,base:boolean>>")
    out = by_id(pii.redact(df, block=block))
    for i, text, spans in rows:
        want, at = "", 0
        for kind, a, b, _ in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
            if a >= at:
                want += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert out[i]["text"] == want + text[at:], (text, spans)


def test_very_long_texts_take_time_in_proportion(spark):
    parts = [f"w{i * 7919 % 30011}" for i in range(60_000)]
    parts[::30] = [f"joe{i}.doe@mail{i % 7}.example.com" for i in range(len(parts[::30]))]
    rows = list(enumerate((" ".join(parts), "a" * 400_000, "1.2.3." * 30_000 + " +1" + " " * 100_000 + "x", "@" * 50_000 + ".a" * 50_000 + "a@b" + ".c" * 50_000, "spam " * 60_000)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = by_id(pii.redact(pii.detect(df, pii.fit_counts({}), out="s"), spans="s"))
    assert found[0]["text"].count("[EMAIL]") == 2000 and found[1]["text"] == rows[1][1] and found[2]["text"].count("[IP]") == 22_500
    out = by_id(quality.judge(df, quality.DecisionList()))
    assert [out[i]["n_words"] for i in range(5)] == [60_000, 1, 3, 1, 60_000] and out[4]["n_repeat_words"] == 60_000
    assert by_id(substring.remove_repeats(df))[4]["n_removed"] == 0


def test_pii_learns_that_contexts_vouch():
    counts = {(3, 1, 1, 1, 1, 1, 2, 2, 2): 500, (3, -1, 1, 1, 1, 1, 2, 2, 2): 100, (3, -1, -1, -1, -1, -1, 2, 3, 0): 500}
    model = pii.fit_counts(counts)
    weight = lambda votes: model.bias + sum(model.weights[3, n, v] for n, v in zip((*pii.VOTES, *pii.SHAPE), votes, strict=True))
    assert weight((-1, 1, 1, 1, 1, 2, 2, 2)) > 0 > weight((-1, -1, -1, -1, -1, 2, 3, 0))


def test_quality_counts(docs, empty):
    out = by_id(quality.judge(docs, quality.DecisionList()))
    for i, t in enumerate(TEXTS):
        assert tuple(out[i][c] for c in quality.COUNTS[:5]) == brute.quality(t), t
        n, _, _, _, rep = brute.quality(t)
        assert out[i]["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert out[i]["kept"] == (not out[i]["base_failed"])
    assert quality.judge(empty, quality.DecisionList()).where("kept").count() == 0


def test_quality_list_learns_a_conjunction(spark):
    rows = []
    for i in range(600):
        row = {f: float((i * 37 + k * 11) % 100) for k, f in enumerate(quality.FEATURES)}
        rows.append(row | {"key": i, "bad": int(row["symbol_share"] > 60 and row["upper_share"] > 40)})
    rules = quality.learn_rules(rows)
    assert rules.rules and rules == quality.learn_rules(rows[::-1])
    hit = [any(quality._holds(r, rule) for rule in rules.rules) for r in rows]
    assert sum(h == r["bad"] for h, r in zip(hit, rows, strict=True)) > 0.97 * len(rows)
    assert quality.learn_rules([]).rules == []


def test_quality_without_labels(docs, spark):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert quality.learn(docs, labels).rules == []


def test_token_counts_equal_the_library(docs, empty):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    tokenizer = token_counts.load(path)
    out = by_id(token_counts.token_counts(docs, path))
    for i, t in enumerate(TEXTS):
        assert out[i]["n_tokens"] == len(tokenizer.encode(t or "", add_special_tokens=False).ids), t
    assert token_counts.token_counts(empty, path).count() == 0


def test_simhash(docs, empty):
    out = by_id(simhash.near_duplicates(docs))
    rows = [(i, brute.fingerprint(t)) for i, t in enumerate(TEXTS)]
    want = brute.components(rows)
    for i, f in rows:
        assert (out[i]["fingerprint"], out[i]["component_id"]) == (f"{f:016x}", want[i])
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("room", [512, 3])
def test_simhash_links_chains_and_crowded_buckets(spark, room):
    """A ball of fingerprints around one, chains of three bits a step, and far ones; room 3 crowds all buckets."""
    import itertools
    import random

    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {base}
    prints |= {base ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 64, 5), 2)}
    step = rng.getrandbits(64)
    for _ in range(30):
        step ^= sum(1 << b for b in rng.sample(range(64), 3))
        prints.add(step)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    rows = list(enumerate(sorted(prints)))
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in rows]
    ids = spark.createDataFrame(signed, "fp long, rep long")
    edges = simhash.links(ids, room=room)
    roots = {r["a"]: r["b"] for r in simhash.components(edges).collect()}
    assert {i: roots.get(i, i) for i, _ in rows} == brute.components(rows)


def test_simhash_null_and_repeated_keys(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "only nulls here now")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in out) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_licenses(docs, empty):
    out = by_id(licenses.scan(docs).select("doc_id", "license.*"))
    for i, t in enumerate(TEXTS):
        n, places, labels = brute.license_places(t)
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(places, default=None), max(places, default=None)), t
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert out[16]["score"] == 1.0 and out[6]["score"] == 0.0
    assert licenses.scan(empty).count() == 0


def test_automaton_finds_every_factor():
    templates = [[1, 2, 3, 1, 2], [2, 3, 4], [4, 4, 4, 1], [1, 2, 3, 1, 2]]
    machine = licenses.Automaton(templates)
    factors = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    import itertools

    for n in range(1, 5):
        for s in itertools.product(range(1, 5), repeat=n):
            assert (machine.maximal(list(s), n) != []) == (s in factors), s


@pytest.mark.parametrize("room", [1024, 1])
def test_substring_dedup(docs, empty, room):
    out = by_id(substring.remove_repeats(docs, room=room, shard_words=300))
    for i, want in brute.repeats(list(enumerate(TEXTS))).items():
        assert (out[i]["n_words"], out[i]["n_removed"], out[i]["kept_sha256"]) == want
        if out[i]["n_removed"]:
            assert hashlib.sha256(out[i]["kept_text"].encode()).hexdigest() == want[2]
    assert substring.remove_repeats(empty).count() == 0


def test_substring_random_texts(spark):
    """Few words, so that windows repeat in many ways."""
    import random

    rng = random.Random(1)
    parts = [" ".join(rng.choice("abc") for _ in range(40)) for _ in range(4)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    out = by_id(substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in out.items()} == brute.repeats(rows)


def test_substring_null_and_repeated_keys(spark):
    rows = [(None, PASSAGE), (4, PASSAGE), (4, PASSAGE), (9, PASSAGE + " tail"), (4, "other text")]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in out) == [(-1, 0), (4, 0), (4, 0), (4, 0), (9, 60)]


def test_wavelet_matrix_ranks():
    import numpy as np

    rng = np.random.default_rng(3)
    text = np.r_[rng.integers(1, 9, 300), 0]
    index = substring.FMIndex(text)
    for pattern in ([1], [2, 3], [5, 5, 1], list(text[10:30])):
        low, high = np.array([0]), np.array([len(text)])
        for symbol in pattern[::-1]:
            low, high = index.back(np.array([symbol]), low, high)
        count = sum(list(text[i : i + len(pattern)]) == list(pattern) for i in range(len(text)))
        assert high[0] - low[0] == count


def test_decontamination(spark, empty):
    item = words(30, 3)
    edited = " ".join(w if i % 9 else "changed" for i, w in enumerate(item.split()))
    rows = [(1, words(50, 1) + " " + item.upper() + " " + words(40, 2)), (2, words(50, 4) + " " + edited), (3, words(90, 6)), (4, None), (5, ""), (None, item), (1, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (10, item), (11, words(25, 8)), (12, None), (13, "too short")], "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(out) == {(1, 10), (2, 10), (None, 10)}
    assert out[1, 10]["score"] == 1.0 and 0.6 < out[2, 10]["score"] < 1.0
    assert (out[2, 10]["first_word"], out[2, 10]["end_word"]) == (51, 80)
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs, bench, block=2).count() == 3


def test_alignment_scores_equal_a_plain_table():
    import random

    import numpy as np

    rng = random.Random(2)

    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    pairs = [([rng.randint(0, 3) for _ in range(rng.randint(1, 12))], [rng.randint(0, 3) for _ in range(rng.randint(1, 20))]) for _ in range(60)]
    got = decontaminate.align([(np.array(a, np.int32), np.array(b, np.int32)) for a, b in pairs])
    assert [s for s, _ in got] == [plain(a, b) for a, b in pairs]


def test_mixing(spark, empty):
    rows = [(i, f"s{i % 4}" if i % 5 else None, words(1 + (i * 7919) % 60, i)) for i in range(900)] + [(7, "s3", "a b c")] * 5 + [(None, None, None), (None, "s9", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    total = sum(len((t or "").split()) for _, _, t in rows)
    by_source = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        s = by_source.setdefault(r["source"], [r["target"], 0, 0])
        s[1] += r["taken"]
        s[2] += r["size"]
    assert list(map(str, sorted(by_source, key=str))) == ["None", "s0", "s1", "s2", "s3", "s9"]
    assert abs(sum(t for t, _, _ in by_source.values()) - total) < 1e-6
    for target, taken, size in by_source.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 60
    weights = dict(zip(["s0", "s1", "s2", "s3", "s9", None], mixing.WEIGHTS * 2, strict=True))
    free = [t / weights[s] for s, (t, _, size) in by_source.items() if t < 3 * size - 1e-6]
    assert max(free) - min(free) < 1e-6
    assert mixing.mix(empty).count() == 0


def test_mixing_keeps_expectations(spark):
    rows = [(i, "a" if i % 2 else "b", words(10 + i % 7)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    total = 0
    for seed in range(12):
        total += sum(r["copies"] for r in mixing.mix(docs, seed=1000 * seed).collect() if r["source"] == "a")
    rate = next(r["target"] / r["source_size"] for r in mixing.mix(docs).collect() if r["source"] == "a")
    assert abs(total / 12 / 20 - rate) < 0.08


def test_toxicity_learns_from_positives_and_unlabelled(spark, empty):
    rows = [(i, words(40, i) + (" vile nasty" if i % 6 == 0 else "")) for i in range(1500)] + [(None, "vile"), (9001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 1500, 2)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    right = sum((out[i] >= 0.5) == (i % 6 == 0) for i in range(1500))
    assert right > 1470 and 0 <= out[9001] < 0.5
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r["toxicity"] < 0.5 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(empty, model).count() == 0


def test_urls(spark):
    rows = [
        (1, "https://A.Example.COM/en/x?q=/y", "a.example.com", "/en/x", "example.com/en/", "block"), (2, "http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "x://net/es/1#f", "net", "/es/1", "net/es/", "block"), (4, "http://shop.com", "shop.com", "", None, None), (5, "http://shop.com/", "shop.com", "/", "com/", "allow"),
        (6, None, "", "", None, "allow"), (7, "no scheme", "", "", None, "allow"), (8, "http://internet/es/", "internet", "/es/", None, None), (9, "http://goldencasino.example.org/de/1", "goldencasino.example.org", "/de/1", None, "block"),
        (10, "http://a.b?x://c/d", "a.b", "", None, None), (11, "http://library.example.org/de/1", "library.example.org", "/de/1", None, "allow"), (12, "", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, u, *_ in rows], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, _, host, path, rule, verdict in rows:
        r = out[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict is None or r["verdict"] == verdict, (i, r)


def test_decontamination_with_each_fourth_word_changed(spark):
    item = words(30, 3)
    edited = " ".join(w if i % 4 != 3 else f"changed{i}" for i, w in enumerate(item.split()))
    docs = spark.createDataFrame([(1, words(50, 1) + " " + edited), (2, words(90, 6))], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, "three short words")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()] == [(1, 10)]


def test_decontamination_of_common_words_does_not_depend_on_the_corpus(spark):
    item = "the of and to in a is that it was for on are as with his they at be this " + words(8, 3)
    leak = "x y z the of and to q1 q2 q3 that it was for q4 q5 as with his they at be this end"
    filler = " ".join("the of and to in a is that it was for on are as with his they at be this".split()[::-1] * 400)
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    for copies in (0, 30):
        docs = spark.createDataFrame([(1, leak)] + [(100 + i, filler) for i in range(copies)], "doc_id long, text string")
        assert 1 in {r["doc_id"] for r in decontaminate.leaks(docs, bench, threshold=0.4).collect()}


def test_simhash_links_through_null_keys(spark):
    """Two prints near a third and far from each other meet only through the row without a key."""
    import random

    rng = random.Random(1)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    edits = [" ".join(base)]
    for _ in range(3000):
        now = list(base)
        now[rng.randrange(120)] = f"w{rng.randrange(9999)}"
        edits.append(" ".join(now))
    full = [(simhash.fingerprint(t), t) for t in edits]
    full = [(f, t) for f, t in full if (f ^ full[0][0]) >> 62 == 0]
    near = [(f, t) for f, t in full if 0 < (f ^ full[0][0]).bit_count() <= 3]
    a, b = next((x, y) for x in near for y in near if (x[0] ^ y[0]).bit_count() > 3)
    docs = spark.createDataFrame([(7, a[1]), (None, full[0][1]), (9, b[1])], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {7}
