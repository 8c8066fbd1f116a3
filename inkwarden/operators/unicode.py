"""Invisible, directional, tag and look-alike characters of a text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Characters and the counts up to which they are noise.
ZERO_WIDTH = (0x200B, 0x200C, 0x200D, 0xFEFF)
SOFT_HYPHEN = (0x00AD,)
BIDI = (*range(0x202A, 0x202F), *range(0x2066, 0x206A))
NOISE = {0x00AD: 40, 0x200B: 8, 0x200C: 6, 0x200D: 6, 0xFEFF: 2}
LETTERS = ("Ll", "Lu", "Lt", "Lm", "Lo")
# Typography that compatibility normalisation changes too.
BENIGN = (
    "\u00a0\u00ad«»²³¹¼½¾·•‣․‐‑‒–—―"
    "‘’‚‛“”„‟…′″‴‹›\u2060"
    "ﬀﬁﬂﬃﬄﬅﬆ\u200b\u200c\u200d\ufeff"
)
TAG_FIRST = 0xE0000
_TAGS = r"[^\x{E0020}-\x{E007E}]"
_BIDI_CLASS = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
_ANY = r"[\x{AD}\x{200B}-\x{200D}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{E0000}-\x{E007F}]"
WINDOW = 60


def count_of(text: Column, cp: int) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(chr(cp)), F.lit("")))).cast("int")


def tag_count(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^\x{E0000}-\x{E007F}]+", ""))


def decode_tags(text: Column) -> Column:
    """Tag characters as the ASCII that they stand for; other characters are dropped."""
    tags = "".join(chr(TAG_FIRST + c) for c in range(0x20, 0x7F))
    return F.translate(F.regexp_replace(text, _TAGS, ""), tags, "".join(map(chr, range(0x20, 0x7F))))


def bidi_context(text: Column, cp: int) -> Column:
    """struct(logical, visual) of every occurrence with WINDOW characters on both sides: logical without
    directional characters, visual with what follows the first of them reversed; joined by ' | '."""
    mark = chr(cp)
    pieces = F.transform(F.split(text, mark, -1), lambda p: F.char_length(p))
    starts = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n + 1).alias("at"), F.concat(acc.out, F.array(acc["at"] + n)).alias("out")), lambda acc: acc.out,
    )
    plain = lambda s: F.regexp_replace(s, _BIDI_CLASS, "")
    trim = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    segment = lambda at: F.substring(text, F.greatest(at - WINDOW, F.lit(0)) + 1, F.least(at, F.lit(WINDOW)) + WINDOW)

    def visual(s: Column) -> Column:
        local = F.locate(mark, s) - 1
        return trim(F.concat(F.substring(plain(s), F.lit(1), local), F.reverse(F.substring(s, local + 2, F.char_length(s)))))

    joined = lambda f: F.array_join(F.filter(F.transform(F.transform(starts, segment), f), lambda x: x != ""), " | ")
    return F.struct(joined(lambda s: trim(plain(s))).alias("logical"), joined(visual).alias("visual"))


@F.pandas_udf(ArrayType(StringType()))
def look_alikes(texts: pd.Series) -> pd.Series:
    """Letters that compatibility normalisation changes, in order of first use, as 'x'→'y'.  Spark has no
    normalisation function, so this runs in Python, in Arrow batches."""

    def one(text: str) -> list[str]:
        if not text or unicodedata.is_normalized("NFKC", text):
            return []
        changed = ((c, unicodedata.normalize("NFKC", c)) for c in dict.fromkeys(text) if c not in BENIGN and unicodedata.category(c) in LETTERS)
        return [f"{c!r}→{n!r}" for c, n in changed if n != c]

    return texts.map(one)


def anomalies(text: Column, location: str = "document", letters: Column | None = None) -> Column:
    """array of schemas.ANOMALY.  letters: the column of look_alikes, if these are wanted."""
    none = F.array().cast("array<string>")

    def row(char, codepoint, category, count, logical=None, visual=None, examples=None) -> Column:
        return F.struct(
            F.lit(char).alias("char"), F.lit(codepoint).alias("codepoint"), F.lit(category).alias("category"), F.lit(location).alias("location"), count.cast("int").alias("count"),
            (F.lit("") if logical is None else logical).alias("logical_text"), (F.lit("") if visual is None else visual).alias("visual_text"), (none if examples is None else examples).alias("examples"),
        )

    found = []
    for category, points in (("zero_width", ZERO_WIDTH), ("soft_hyphen", SOFT_HYPHEN), ("bidi_override", BIDI)):
        for cp in points:
            n, context = count_of(text, cp), bidi_context(text, cp) if category == "bidi_override" else None
            more = (context.logical, context.visual) if context is not None else ()
            found.append(F.when(n > NOISE.get(cp, 0), row(chr(cp), f"U+{cp:04X}", category, n, *more)))
    found.append(F.when(tag_count(text) > 0, row(chr(TAG_FIRST + 0x41), "U+E0000", "unicode_tag", tag_count(text), F.trim(decode_tags(text)))))
    if letters is not None:
        found.append(F.when(F.size(letters) > 0, row("(multiple)", "NFKC", "homoglyph", F.size(letters), examples=F.slice(letters, 1, 10))))
    # Nearly all texts have none of these characters: one look decides.
    some = text.rlike(_ANY)
    if letters is not None:
        some = some | (F.size(letters) > 0)
    rows = F.array_compact(F.array(*found))
    return F.when(some, rows).otherwise(F.filter(F.array(row("", "", "", F.lit(0))), lambda x: F.lit(False)))
