"""Exact token counts without a shuffle: a two-tier lookup beside each text.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum of its
pre-tokens' lengths.  Tier one is a broadcast table of frequent pre-tokens with their lengths:
the tokenizer's own vocabulary, which merge training picked by frequency, and the commonest
pre-tokens of a bounded sample of the corpus.  Tier two is a bounded cache in each Python
worker that asks the tokenizer once for every pre-token that tier one misses.  The tables decide
only how fast a count is found, never what it is.

Where a text holds characters that library and `re` may split apart differently, it is cut at single spaces
between other characters, which are always a pre-token's beginning; pieces with such characters are asked for
whole, through the same cache, and the others go by pre-tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarden.llm.runtime import bound_batches, text_of

#: Characters on which Python and the tokenizer agree beyond any Unicode version: printable ASCII,
#: tab, line ends, and Latin letters and signs up to U+017F without the superscripts and fractions,
#: which are numbers there.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ſ]*")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_SPACE = "\t\n\r\x20\xa0"
PRE_TOKEN = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: White space by any account, and characters that only some count as such.
_BLANK = "\\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"
CUT = re.compile(f"(?<=[^{_BLANK}])(?=\x20[^{_BLANK}])")


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(tokenizer) -> list[str]:
    """Strings that the library cuts out of a text before it splits into pre-tokens."""
    return sorted(x.content for x in tokenizer.get_added_tokens_decoder().values())


class Lengths(dict):
    """Pre-token to length: starts as tier one; tier two is filled by misses and starts anew
    when it is full, so that a worker's memory stays bounded."""

    def __init__(self, table: dict[str, int], tokenizer, room: int):
        super().__init__(table)
        self.tokenizer, self.room, self.cache = tokenizer, room, {}

    def __missing__(self, pre_token: str) -> int:
        found = self.cache.get(pre_token)
        if found is None:
            found = len(self.tokenizer.encode(pre_token, add_special_tokens=False).ids)
            if len(pre_token) <= 64:
                if len(self.cache) >= self.room:
                    self.cache.clear()
                self.cache[pre_token] = found
        return found


def count(text: str, lengths: Lengths, special: list[str]) -> int:
    if any(s in text for s in special):
        return len(lengths.tokenizer.encode(text, add_special_tokens=False).ids)
    if PLAIN.fullmatch(text):
        return sum(map(lengths.__getitem__, PRE_TOKEN.findall(text)))
    return sum(sum(map(lengths.__getitem__, PRE_TOKEN.findall(x))) if PLAIN.fullmatch(x) else lengths[x] for x in CUT.split(text))


def frequent_lengths(df: DataFrame, path: str, text: str = "text", fit_rows: int = 2000, entries: int = 65_536) -> dict[str, int]:
    """Tier one: at most `entries` pre-tokens of 64 characters at most.  The vocabulary is bounded by the
    tokenizer file; of about fit_rows texts, spread over the corpus by their hash, executors count the pre-tokens,
    and only the commonest reach the driver.  They only warm a cache."""
    tokenizer = load(path)
    rate = min(1.0, fit_rows / max(1, df.count()))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                if PLAIN.fullmatch(t):
                    counts.update(w for w in PRE_TOKEN.findall(t) if len(w) <= 64)
            if len(counts) > entries:
                yield pd.DataFrame(counts.items(), columns=["w", "n"])
                counts.clear()
        yield pd.DataFrame(counts.items(), columns=["w", "n"]).astype({"w": "str", "n": "int64"})

    sample = df.select(text_of(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    common = sample.mapInPandas(tally, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(entries).select("w").collect()
    words = dict.fromkeys(r["w"] for r in common)
    for word in tokenizer.get_vocab():
        shown = word.replace("\u0120", " ")
        if len(shown) <= 64 and shown.isascii() and PRE_TOKEN.fullmatch(shown):
            words.setdefault(shown)
    words, table = list(words)[:entries], {}
    for at in range(0, len(words), 4096):
        part = words[at : at + 4096]
        table.update(zip(part, (len(e.ids) for e in tokenizer.encode_batch(part, add_special_tokens=False)), strict=True))
    return table


def token_counts(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", fit_rows: int = 2000, cache_entries: int = 200_000) -> DataFrame:
    """df with `out`, the tokens of each whole text as `tokenizers` counts them for the file at
    `path`, which every executor must be able to read.

    Null texts count as empty (0 tokens); repeated rows each keep their row; an empty table gives an
    empty table; a column already named `out` is replaced; no row leaves its partition.
    """
    spark = df.sparkSession
    bound_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(df, path, text, fit_rows))
    state: list = []

    @F.pandas_udf("long")
    def lengths_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not state:
            tokenizer = load(path)
            state.extend([Lengths(table.value, tokenizer, cache_entries), special_strings(tokenizer)])
        lengths, special = state
        for texts in batches:
            yield pd.Series([count(t, lengths, special) for t in texts], dtype="int64")

    return df.withColumn(out, lengths_of(text_of(text)))
