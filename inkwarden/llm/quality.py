"""Quality rules: a learned decision list over text statistics, in built-in expressions only.

The statistics are Spark columns.  Sequential covering on the driver grows threshold conjunctions for
rejected documents on two thirds of a bounded sample of labelled rows, prunes each on the remaining
third, and stops when a rule isn't precise enough there.  The list becomes one CASE expression.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.llm.runtime import GAPS, fenced, text_of

SYMBOLS = "[#*$%&|<>]+"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "line_words")


def _removed(text: Column, pattern: str) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")


def text_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df with the eight counts of COUNTS (long), each named prefix + its name, of every whole text.

    Words are runs of anything but ASCII white space.  n_repeat_words counts the words inside 5-word
    windows whose words occur twice or more in the text; windows are compared by 64-bit hash.  Null
    and empty texts have zeros; columns of these names are replaced; no row moves.
    """
    p = "__stat_"
    while any(c.startswith(p) for c in df.columns):
        p = f"_{p}"
    out = df.withColumn(p + "t", text_of(text))
    trimmed = F.btrim(F.col(p + "t"), F.lit(" \t\n\x0b\f\r"))
    out = out.withColumn(p + "words", F.when(F.char_length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, GAPS)))
    words = F.col(p + "words")
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(words[i + k] for k in range(WINDOW))))
    nothing = F.array().cast("array<bigint>")
    lines = F.filter(F.split(F.col(p + "t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({p + "hash": F.when(F.size(words) >= WINDOW, hashes).otherwise(nothing), p + "lines": lines})
    # Only texts with some window twice go through the sort below.
    h = F.col(p + "hash")
    twice = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    out = out.withColumn(p + "sorted", F.coalesce(twice, F.array().cast("array<struct<h:bigint,i:int>>")))
    s = F.col(p + "sorted")
    equal = lambda x, i: (F.when(i > 0, s[F.greatest(i - 1, F.lit(0))].h == x.h).otherwise(False)) | (F.when(i < F.size(s) - 1, s[F.least(i + 1, F.size(s) - 1)].h == x.h).otherwise(False))
    out = out.withColumn(p + "at", F.sort_array(F.transform(F.filter(s, equal), lambda x: x.i)))
    at = F.col(p + "at")
    steps = F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda i: F.least(F.lit(WINDOW), at[i] - at[i - 1]))
    covered = F.when(F.size(at) == 0, 0).when(F.size(at) == 1, WINDOW).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda a, x: a + x))
    t, all_lines = F.col(p + "t"), F.col(p + "lines")
    counts = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": _removed(t, SYMBOLS),
        "n_dup_lines": (F.size(all_lines) - F.size(F.array_distinct(all_lines))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_lines": F.size(all_lines).cast("long"),
        "n_upper": _removed(t, "[A-Z]+"),
        "n_marks": _removed(t, "[!?.,;:]+"),
    }
    out = out.withColumns({prefix + k: v for k, v in counts.items()})
    return fenced(out, [prefix + k for k in COUNTS]).drop(*(p + x for x in ("t", "words", "hash", "lines", "sorted", "at")))


def feature_columns(prefix: str = "") -> dict[str, Column]:
    c = {k: F.col(prefix + k).cast("double") for k in COUNTS}
    share = lambda a, b: c[a] / F.greatest(c[b], F.lit(1.0))
    return {
        "n_words": c["n_words"], "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "mark_share": share("n_marks", "word_chars"), "line_words": share("n_words", "n_lines"),
    }


@dataclass
class DecisionList:
    """Ordered rules; each is a conjunction of (feature, '<=' or '>', threshold) that rejects."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def keeps(self, prefix: str = "") -> Column:
        cols = feature_columns(prefix)
        out = F
        for rule in self.rules:
            test = F.lit(True)
            for name, way, at in rule:
                test = test & (cols[name] <= at if way == "<=" else cols[name] > at)
            out = out.when(test, F.lit(False))
        return out.otherwise(F.lit(True)) if self.rules else F.lit(True)


def _holds(row: dict, rule: list) -> bool:
    return all(row[n] <= at if way == "<=" else row[n] > at for n, way, at in rule)


def _split_points(values: list[float], most: int = 24) -> list[float]:
    v = sorted(set(values))
    if len(v) > most:
        ranked = sorted(values)
        v = sorted({ranked[i * (len(ranked) - 1) // most] for i in range(most + 1)} | {v[i * (len(v) - 1) // most] for i in range(most + 1)})
    return [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]


def learn_rules(rows: list[dict], precision: float = 0.9, most_rules: int = 12, most_tests: int = 4) -> DecisionList:
    """Sequential covering; rows hold FEATURES, `bad` and a stable `key`.  Both parts of the split
    and every tie are decided by the rows alone, so a rerun learns the same list."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["key"]).encode()), str(r["key"])))
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    out = DecisionList()
    while len(out.rules) < most_rules:
        rule: list[tuple[str, str, float]] = []
        inside = grow
        p = sum(r["bad"] for r in inside)
        n = len(inside) - p
        if p < 3:
            break
        while n and len(rule) < most_tests:
            best = (0.0, None)
            for name in FEATURES:
                # One pass over the sorted values gives the gain of every threshold, both ways.
                ordered = sorted((r[name], r["bad"]) for r in inside)
                points, k, pl, nl = _split_points([v for v, _ in ordered]), 0, 0, 0
                for at in points:
                    while k < len(ordered) and ordered[k][0] <= at:
                        pl, nl, k = pl + ordered[k][1], nl + 1 - ordered[k][1], k + 1
                    for way, a, b in (("<=", pl, nl), (">", p - pl, n - nl)):
                        if a:
                            gain = a * (math.log2(a / (a + b)) - math.log2(p / (p + n)))
                            if gain > best[0] + 1e-12:
                                best = (gain, (name, way, at))
            if best[1] is None:
                break
            rule.append(best[1])
            inside = [r for r in inside if _holds(r, [best[1]])]
            p = sum(r["bad"] for r in inside)
            n = len(inside) - p
        if not rule:
            break

        def worth(r: list) -> tuple[float, int, int]:
            hit = [x for x in prune if _holds(x, r)]
            a = sum(x["bad"] for x in hit)
            return ((2 * a - len(hit)) / max(1, len(hit)), a, len(hit))

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule = rule[:-1]
        _, good, hits = worth(rule)
        if not hits or good / hits < precision:
            break
        out.rules.append(rule)
        grow, prune = [r for r in grow if not _holds(r, rule)], [r for r in prune if not _holds(r, rule)]
    return out


def learn(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = 20_000) -> DecisionList:
    """Learn from at most fit_rows labelled rows, those of the smallest hash of the key.  Rows with
    a null key or label teach nothing; a key labelled twice counts by its lowest label, a document
    that repeats counts once.  Without labels the list is empty and keeps everything."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(label).alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__k"), "__k").limit(fit_rows)  # the bound that makes the broadcast safe
    docs = df.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(chosen), "__k")
    found = text_statistics(docs, "__t").select("__k", "__y", *(v.alias("f_" + k) for k, v in feature_columns().items()))
    rows = [{"key": r["__k"], "bad": int(r["__y"] == 0)} | {k: r["f_" + k] for k in FEATURES} for r in found.dropDuplicates(["__k"]).collect()]
    return learn_rules(rows)


def judge(df: DataFrame, rules: DecisionList, text: str = "text", prefix: str = "") -> DataFrame:
    """df with COUNTS, base_failed (fewer than 10 words, or over a fifth of the words in repeated
    windows), rule_keeps (the list's verdict) and kept (false if base_failed, else the list's verdict).

    Null and empty texts have zero counts and fail the base rule.  Repeated rows are judged alike.  All new
    names begin with prefix; columns of these names are replaced.
    """
    out, c = text_statistics(df, text, prefix), lambda n: F.col(prefix + n)
    failed = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    out = out.withColumns({prefix + "base_failed": failed, prefix + "rule_keeps": rules.keeps(prefix)})
    return out.withColumn(prefix + "kept", ~c("base_failed") & c("rule_keeps"))
