"""Column functions over text.  All are JVM expressions; lengths and offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "[INJECTION REMOVED]"
TRUNCATED = "\n[... truncated ...]"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def left(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def truncate(c: Column, n: int, marker: str = TRUNCATED) -> Column:
    return F.when(F.char_length(c) > n, F.concat(left(c, n), F.lit(marker))).otherwise(c)


def folded(c: Column) -> Column:
    """For substring tests that must hold wherever a case-insensitive match does.  The four letters that match
    an ASCII letter without lower-casing to it are spelled out: lower(upper(c)) would fold them too, but
    Catalyst simplifies that to lower(c)."""
    return F.lower(F.translate(c, "\u0130\u0131\u017f\u212a", "iisk"))


def match_spans(text: Column, pattern: Column) -> Column:
    """array<struct<start,end,match>> of all non-overlapping matches, leftmost first.

    Splitting and extracting by one pattern interleave without a separator that the text might hold.
    """
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))
    # The array ends with the piece after the last match, which pairs with null.
    both = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc.at + x.p
        end = begin + F.coalesce(F.char_length(x.m), F.lit(0))
        found = F.array(F.struct(begin.alias("start"), end.alias("end"), x.m.alias("match")))
        return F.struct(end.alias("at"), F.when(x.m.isNull(), acc.out).otherwise(F.concat(acc.out, found)).alias("out"))

    return F.aggregate(both, start, step, lambda acc: acc.out)


def evidence(text: Column, start: Column, end: Column, around: int = 30) -> Column:
    """The match with `around` characters on both sides; the left edge moves on to a word's beginning."""
    cut, look = F.greatest(start - around, F.lit(0)), 64
    run = lambda before: F.char_length(F.regexp_extract(F.reverse(before), r"^[\p{L}\p{N}]*", 0))
    first = F.greatest(cut - look, F.lit(0))
    near = run(F.substring(text, first + 1, cut - first))
    # Only a word longer than that sends the search through all of the text before.
    word = F.when(near < look, near).otherwise(run(F.substring(text, F.lit(1), cut)))
    return strip(F.substring(text, cut - word + 1, end + around - cut + word))


def percent(x: Column) -> Column:
    """Whole percents, half to even, as in '12%'."""
    return F.concat(F.bround(x * 100).cast("long").cast("string"), F.lit("%"))


def duration(ms: Column) -> Column:
    """ms below a second, seconds below a minute, minutes and seconds above."""
    seconds = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.format_string("%dms", ms.cast("long")))
        .when(ms < 60_000, F.format_string("%.1fs", ms / F.lit(1000.0)))
        .otherwise(F.format_string("%dm %ds", F.floor(seconds / 60), seconds % 60))
    )


def score_bar(score: Column, width: int = 30) -> Column:
    """As in '[######----] 60/100'."""
    full = F.floor(score / 100 * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full), F.lit("] "), score.cast("string"), F.lit("/100"))


def score_color(score: Column) -> Column:
    return F.when(score <= 20, "green").when(score <= 60, "yellow").otherwise("red")


def exit_code(verdict: Column) -> Column:
    """2 malicious, 1 suspicious or failed (null), 0 clean."""
    return F.when(verdict == "malicious", 2).when(verdict == "clean", 0).otherwise(1)


def coerce_confidence(raw: Column) -> Column:
    """A provider's confidence as 0..1: no number gives 0.65, percents are divided by 100."""
    text = F.trim(raw.cast("string"))
    number = F.when(~F.lower(text).rlike("[df]$") | F.lower(text).rlike("inf$"), text.try_cast("double"))
    number = F.when(F.isnan(number), None).otherwise(number)
    # least and greatest skip nulls, so these are told apart first.
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(number > 1, number / 100).otherwise(number)))
    return F.when(number.isNull(), 0.65).otherwise(clamped)


def coerce_severity(raw: Column) -> Column:
    v = F.lower(F.trim(raw.cast("string")))
    return (
        F.when(v.isin("low", "medium", "high", "critical"), v)
        .when(v == "moderate", "medium").when(v == "severe", "high").when(v == "extreme", "critical").when(v == "info", "low")
        .otherwise("medium")
    )


def coerce_list(raw: Column) -> Column:
    """A JSON list's strings, else the text itself as a list of one, else an empty list."""
    parsed = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>"))
    return F.coalesce(parsed, F.when(F.trim(raw) != "", F.array(raw)), F.array().cast("array<string>"))


def budget_join(parts: Column, limit: Column | int, separator: str = "\n", marker: str = TRUNCATED.strip(), empty: str = "(none)") -> Column:
    """Parts in order while their summed length stays within limit, then the marker; '(none)' for no part."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        used = acc.used + F.char_length(p)
        fits = acc.open & (used <= limit)
        out = F.when(fits, F.concat(acc.out, F.array(p))).when(acc.open, F.concat(acc.out, F.array(F.lit(marker)))).otherwise(acc.out)
        return F.struct(used.alias("used"), fits.alias("open"), out.alias("out"))

    joined = F.aggregate(parts, start, step, lambda acc: F.array_join(acc.out, separator))
    return F.when(F.size(parts) == 0, F.lit(empty)).otherwise(joined)


def proxy_hop(header: Column, trusted: Column | int, peer: Column) -> Column:
    """The client's address: the trusted-th from the right of a forwarding header, else the peer."""
    trusted = F.lit(trusted) if isinstance(trusted, int) else trusted
    hops = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((trusted > 0) & (F.size(hops) >= trusted), F.element_at(hops, F.greatest(trusted, F.lit(1)) * -1)).otherwise(peer)


def sanitize(text: Column, findings: Column, marker: str = MARKER) -> Column:
    """Ordered fold over findings (struct with severity, category, evidence): each evidence, stripped and not
    empty, that the text still holds is replaced throughout.  struct(text, changes): a line for each
    evidence that was replaced, in order, with its first 80 characters."""
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("changes"))

    def step(acc: Column, f: Column) -> Column:
        e = strip(f.evidence)
        hit = (e != "") & acc.text.contains(e)
        shown = F.concat(left(e, 80), F.when(F.char_length(e) > 80, "…").otherwise(""))
        line = F.concat(F.lit("Exact match removed ["), F.upper(f.severity), F.lit("] "), f.category, F.lit(": "), shown)
        return F.struct(F.when(hit, F.replace(acc.text, e, F.lit(marker))).otherwise(acc.text).alias("text"), F.when(hit, F.concat(acc.changes, F.array(line))).otherwise(acc.changes).alias("changes"))

    return F.aggregate(findings, start, step)


def tokens_only_in(a: Column, b: Column, least: int = 50, most: int = 2000) -> Column:
    """Lower-case words of three or more ASCII letters that a has and b has not, sorted and joined;
    empty below `least` characters, cut at `most`."""
    words = lambda c: F.transform(F.regexp_extract_all(c, F.lit("[a-zA-Z]{3,}"), F.lit(0)), F.lower)
    joined = F.array_join(F.array_sort(F.array_except(words(a), words(b))), " ")
    return F.when(F.char_length(joined) >= least, left(joined, most)).otherwise(F.lit(""))


def host_suffix(url: Column) -> Column:
    """The URL's authority, lower-cased, without any leading run of 'w' and '.'."""
    authority = F.lower(F.regexp_extract(url, r"(?i)^[a-z]+://([^/?#]*)", 1))
    return F.regexp_replace(authority, r"^[w.]+", "")


def query_of(url: Column) -> Column:
    """What follows the first question mark."""
    return F.regexp_extract(url, r"(?s)\?(.*)$", 1)


def replacement_count(text: Column, marker: str = MARKER) -> Column:
    """How often the marker stands in a text: before and after a rewrite this must not fall."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("int")
