"""Personal data and secrets by weak supervision, in built-in expressions only.

Patterns propose candidate spans: exact ones (always reported) and looser ones, many of them false: version
numbers, quads with parts over 255, x@y, digit runs that fail their checksum, long random words.  Regex,
checksum, gazetteer, context and edge labelers vote on each.  The corpus-wide counts of candidates by kind,
votes and shape, at most a few thousand rows, go to the driver, where expectation-maximisation estimates each
labeler's reliability without any label, and a logistic span classifier is trained on the resulting
probabilities.  The classifier's weights become a Spark expression that decides on the looser candidates.

A kind that shows hardly any false (or true) candidates can't tell how often a labeler errs; its rates lean on
those of all kinds together, as a few candidates more would.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.llm.runtime import fenced, materialize, text_of, unused

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

#: Exact patterns.  Possessive where nothing is lost by it, so that no text costs quadratic time; \G lets
#: a match begin where the one before it ended.
EXACT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates.  Cards: whatever the exact pattern finds that fails its test.  Secrets have loose ones only:
#: quoted values that a name is set to, and long words of letters and digits.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(](?:at|AT)[\])]\x20?|\x20?@\x20?)[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{1,63}+)*+",
    "ip": r"(?<![0-9.])[0-9]{1,5}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,5}+){2,7}+(?![0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9.+])(?:00[1-9][0-9\x20.-]{7,18}+|\(?[0-9]{3}\)?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4})(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+",
}

#: Gazetteers: endings of host names; first digits of cards; openings of keys; words near a kind; words near other things.
ENDINGS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info"
OPENINGS = "akia|asia|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk-|sk_live_|pk_live_|eyj|aiza|ya29"
NEAR = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel)\b",
    "ip": r"\b(?:ip|address|host|server|login|from|adresse)\b",
    "card": r"\b(?:card|visa|mastercard|credit|debit|pan|karte|carte|tarjeta)\b",
    "phone": r"\b(?:phone|tel|call|fax|mobile|cell|whatsapp|telefon|tel[eé]fono)\b",
    "secret": r"(?:token|secret|passw(?:or)?d|passwort|pwd|api[_-]?key|access[_-]?key|credential|bearer|contrase)",
}
OTHER = r"\b(?:version|v|isbn|issn|order|invoice|serial|ticket|build|release|figure|section|page|no|ref|hash|sha|sha1|sha256|md5|commit|digest|checksum|uuid)\b"
#: What stands between a name and the quoted value that it is set to.
ASSIGNED = r"[A-Za-z0-9_]\x20?(?:=|:|=>|:=)\x20?[\x22\x27`]$"
PRIOR_WIDTH = 40

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
VALID_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
VOTES = ("v_form", "v_check", "v_list", "v_near", "v_edge")
SHAPE = ("size", "digits", "gaps")


def _luhn(digits: Column) -> Column:
    doubled = F.translate(digits, "0123456789", "0246813579")
    n = F.length(digits)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.when((n - i) % 2 == 1, doubled).otherwise(digits), i, F.lit(1)).cast("int"))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def valid(kind: str, m: Column) -> Column:
    """Whether an exact match of the pattern passes its kind's test."""
    d = _digits(m)
    if kind == "ip":
        return m.rlike(VALID_IP)
    if kind == "card":
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    return F.length(d).between(8, 15) if kind == "phone" else F.lit(True)


def _starts(lengths: Column) -> Column:
    """Running sums before each element, in blocks so that long arrays cost little more than their size."""
    block = 256
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("t"), none.alias("a"))
    first = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")),
        lambda b: F.aggregate(F.slice(lengths, b * block + 1, F.lit(block)), start, lambda acc, x: F.struct((acc.t + x).alias("t"), F.concat(acc.a, F.array(acc.t)).alias("a"))),
    )
    both = F.aggregate(first, start, lambda acc, x: F.struct((acc.t + x.t).alias("t"), F.concat(acc.a, F.transform(x.a, lambda v: v + acc.t)).alias("a")))
    return F.when(F.size(lengths) == 0, none).otherwise(both.a)


def _found(df: DataFrame, name: str, text: str, pattern: str, guard: Column) -> DataFrame:
    """df with array `name` of struct(s, e, m, before, after): code point offsets and text of the pattern's
    matches, up to PRIOR_WIDTH characters between the match and the one before, and the next character.  All
    come from the pieces between matches, so that no text is searched from its start for each match."""
    p, none = f"{name}_", F.array().cast("array<string>")
    df = df.withColumns({p + "m": F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), p + "p": F.when(guard, F.split(text, pattern, -1)).otherwise(none)})
    df = df.withColumn(p + "l", F.transform(F.col(p + "m"), lambda m, i: F.char_length(m) + F.char_length(F.col(p + "p")[i])))
    df = df.withColumn(p + "t", _starts(F.col(p + "l")))
    piece, total, at = F.col(p + "p"), F.col(p + "l"), F.col(p + "t")
    spans = F.transform(F.col(p + "m"), lambda m, i: F.struct(
        (at[i] + F.char_length(piece[i])).alias("s"), (at[i] + total[i]).alias("e"), m.alias("m"),
        F.right(piece[i], F.lit(PRIOR_WIDTH)).alias("before"), F.left(piece[i + 1], F.lit(1)).alias("after"),
    ))
    return df.withColumn(name, spans).drop(p + "m", p + "p", p + "l", p + "t")


def candidates(df: DataFrame, text: str = "text", out: str = "pii_candidates") -> DataFrame:
    """df with the array `out` of candidate spans: k (position in KINDS), s, e, base, the votes of
    VOTES (1 for, -1 against, 0 none) and the classes of SHAPE.  Every base span is among them."""
    t, base, every = unused(df, "__pii_text", "__pii_base", "__pii_all")
    exact = dict(zip(BASE_KINDS, unused(df, *(f"__x_{k}" for k in BASE_KINDS)), strict=True))
    rough = dict(zip(LOOSE, unused(df, *(f"__l_{k}" for k in LOOSE)), strict=True))
    df = df.withColumn(t, text_of(text))
    col = F.col(t)
    has_digit, low = col.rlike("[0-9]"), F.lower(col)
    guards = {"email": col.contains("@"), "ip": col.rlike(r"[0-9]\.[0-9]"), "card": has_digit, "phone": col.contains("+")}
    for kind in BASE_KINDS:
        df = _found(df, exact[kind], t, EXACT[kind], guards[kind])
    guards = {
        "email": guards["email"] | low.rlike(r"[\[(]at[\])]"), "ip": col.rlike(r"[0-9](?:\.|\[\.\]|\(\.\))[0-9]"), "phone": col.rlike(r"[0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9\x20.-]{7}"),
        "secret": has_digit & col.rlike(r"[A-Za-z0-9_+/=-]{16}"),
    }
    for kind in LOOSE:
        df = _found(df, rough[kind], t, LOOSE[kind], guards[kind])

    def tagged(name: str, kind: str, is_base: bool, keep) -> Column:
        tag = lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x.s.alias("s"), x.e.alias("e"), x.m.alias("m"), F.lit(is_base).alias("base"), x.before.alias("before"), x.after.alias("after"))
        return F.transform(F.filter(F.col(name), keep), tag)

    passes = lambda kind: lambda x: valid(kind, x.m)
    df = df.withColumn(base, F.concat(*(tagged(exact[k], k, True, passes(k)) for k in BASE_KINDS)))
    free = lambda x: ~F.exists(F.col(base), lambda b: (b.s < x.e) & (b.e > x.s))
    loose = F.concat(
        tagged(rough["email"], "email", False, free),
        tagged(rough["ip"], "ip", False, free),
        tagged(exact["card"], "card", False, lambda x: F.length(_digits(x.m)).between(13, 19) & ~valid("card", x.m) & free(x)),
        tagged(rough["phone"], "phone", False, lambda x: ~x.m.startswith("+") & free(x)),
        tagged(rough["secret"], "secret", False, lambda x: x.m.rlike("[0-9]") & x.m.rlike("[A-Za-z]") & free(x)),
    )
    df = df.withColumn(every, F.concat(F.col(base), loose))

    def voted(x: Column) -> Column:
        kind_is = lambda k: x.k == KINDS.index(k)
        d, before, after = _digits(x.m), x.before, x.after
        by_kind = lambda f: F.when(kind_is("email"), f("email")).when(kind_is("ip"), f("ip")).when(kind_is("card"), f("card")).when(kind_is("phone"), f("phone")).otherwise(f("secret"))
        listed = {
            "email": F.lower(x.m).rlike(rf"(?:\.|[\[(]dot[\])])\x20?(?:{ENDINGS})$"), "ip": x.m.rlike(r"^(?!0|10\.|127\.|192\.168\.|22[4-9]|2[3-9][0-9])[0-9]"),
            "card": d.rlike("^(?:3[47]|4|5[1-5]|2[2-7]|6)"), "phone": d.rlike("^(?:1?[2-9][0-9]{2}[2-9]|[2-9]|00)"), "secret": F.lower(x.m).rlike(f"^(?:{OPENINGS})") | F.lower(before).rlike(NEAR["secret"]),
        }
        checked = {
            "email": x.m.rlike(r"\.|[\[(](?:dot|DOT)[\])]"), "ip": F.regexp_replace(x.m, r"\[\.\]|\(\.\)", ".").rlike(VALID_IP), "card": F.when(F.length(d) <= 19, _luhn(d)).otherwise(False),
            "phone": F.length(d).between(10, 13), "secret": (F.length(d) >= 4) & (F.length(F.regexp_replace(x.m, "[^A-Za-z]+", "")) >= 4) & ~x.m.rlike("[/_=+-].*[/_=+-].*[/_=+-].*[/_=+-]"),
        }
        sign = lambda c: F.when(c, 1).otherwise(-1)
        near = F.lower(before)
        return F.struct(
            *(x[f].alias(f) for f in ("k", "s", "e", "base")),
            sign(F.when(kind_is("secret"), before.rlike(ASSIGNED)).otherwise(x.base)).alias("v_form"),
            sign(by_kind(checked.get)).alias("v_check"),
            sign(by_kind(listed.get)).alias("v_list"),
            F.when(by_kind(lambda k: near.rlike(NEAR[k])), 1).when(near.rlike(OTHER), -1).otherwise(0).alias("v_near"),
            sign(~before.rlike(r"[\p{L}\p{N}_/#-]$") & ~after.rlike(r"[\p{L}\p{N}_=/#@]")).alias("v_edge"),
            F.least(F.floor((x.e - x.s) / 6), F.lit(5)).cast("int").alias("size"),
            F.floor(4 * F.length(d) / F.greatest(x.e - x.s, F.lit(1))).cast("int").alias("digits"),
            F.least(F.length(F.regexp_replace(x.m, r"[^\x20().-]+", "")), F.lit(3)).alias("gaps"),
        )

    return fenced(df.withColumn(out, F.transform(F.col(every), voted)), [out]).drop(t, base, every, *exact.values(), *rough.values())


@dataclass
class Model:
    """Reliabilities by kind, labeler and truth, and the span classifier's weights by feature."""

    reliability: dict = field(default_factory=dict)
    weights: dict[tuple, float] = field(default_factory=dict)
    bias: float = 0.0

    def logit(self, x: Column) -> Column:
        """Of struct x as `candidates` makes it.  Only features that the classifier met have weights."""
        total = F.lit(float(self.bias))
        for (k, name, value), w in sorted(self.weights.items()):
            total = total + F.when((x.k == k) & (x[name] == value), float(w)).otherwise(0.0)
        return total


def _estimate(table: dict[tuple, int], rounds: int = 40, lean: float = 8.0) -> tuple[dict, dict[tuple, float]]:
    """Dawid-Skene over vote counts, by kind: reliabilities, and the probability of each vote tuple.
    table: (k, *votes) to count.  Starts from the majority vote, ties against.  A kind's rates are smoothed by
    `lean` candidates that vote as those of all kinds do."""
    kinds = sorted({key[0] for key in table})
    rows = {k: [(key[1:], n) for key, n in sorted(table.items()) if key[0] == k] for k in kinds}
    q = {(k, *v): 0.9 if sum(v) > 0 else 0.1 for k in kinds for v, _ in rows[k]}
    cells = [(j, value) for j in range(len(VOTES)) for value in (-1, 0, 1)]
    reliability: dict = {}
    for _ in range(rounds):
        sums = {}  # candidates taken for true and for false, in all and by vote
        for k in kinds:
            good, bad = sum(n * q[k, *v] for v, n in rows[k]), sum(n * (1 - q[k, *v]) for v, n in rows[k])
            votes = {(j, x): (sum(n * q[k, *v] for v, n in rows[k] if v[j] == x), sum(n * (1 - q[k, *v]) for v, n in rows[k] if v[j] == x)) for j, x in cells}
            sums[k] = (good, bad, votes)
        # Kinds count alike in the shared rates, however many candidates they have.
        share = lambda side, cell: (sum(sums[k][2][cell][side] / (sums[k][side] + 1) for k in kinds) + 1 / 3) / (sum(sums[k][side] / (sums[k][side] + 1) for k in kinds) + 1)
        shared = {cell: (share(0, cell), share(1, cell)) for cell in cells}
        for k in kinds:
            good, bad, votes = sums[k]
            rate = {c: ((votes[c][0] + lean * shared[c][0]) / (good + lean), (votes[c][1] + lean * shared[c][1]) / (bad + lean)) for c in cells}
            prior = math.log((good + 1) / (bad + 1))
            for v, _ in rows[k]:
                z = prior + sum(math.log(rate[j, x][0] / rate[j, x][1]) for j, x in enumerate(v))
                q[k, *v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            reliability[KINDS[k]] = {VOTES[j] + f"={value}": r for (j, value), r in rate.items()}
    return reliability, q


def fit_counts(counts: dict[tuple, int], rounds: int = 400, step: float = 4.0, shrink: float = 1e-4) -> Model:
    """counts: (k, *VOTES, *SHAPE) to candidates.  No candidate: a model that accepts none.  A pattern weighs the
    root of its candidates, or rare patterns would teach the classifier nothing."""
    if not counts:
        return Model(bias=-1.0)
    table: dict[tuple, int] = defaultdict(int)
    for key, n in counts.items():
        table[key[: 1 + len(VOTES)]] += n
    reliability, truth = _estimate(table)
    names = (*VOTES, *SHAPE)
    total = sum(math.sqrt(n) for n in counts.values())
    rows = [([(key[0], name, v) for name, v in zip(names, key[1:], strict=True)], math.sqrt(n) / total, truth[key[: 1 + len(VOTES)]]) for key, n in sorted(counts.items())]
    weights: dict[tuple, float] = defaultdict(float)
    bias = 0.0
    for _ in range(rounds):
        change: dict[tuple, float] = defaultdict(float)
        shift = 0.0
        for features, n, q in rows:
            z = bias + sum(weights[f] for f in features)
            error = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - q)
            shift += error
            for f in features:
                change[f] += error
        for f, g in change.items():
            weights[f] -= step * (g + shrink * weights[f])
        bias -= step * shift
    return Model(reliability, dict(weights), bias)


def fit_candidates(found: DataFrame, column: str) -> Model:
    """Estimate and train on all candidates of the column.  What reaches the driver is one row for each kind, vote
    and shape that occurs: 5 * 2 * 2 * 2 * 3 * 2 * 6 * 5 * 4 at most, whatever the input's size."""
    names = ("k", *VOTES, *SHAPE)
    rows = found.select(F.explode(column).alias("c")).groupBy(*(F.col(f"c.{n}").alias(n) for n in names)).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_counts({tuple(r[n] for n in names): r["n"] for r in rows})


def fit(df: DataFrame, text: str = "text") -> Model:
    """fit_candidates on the candidates of all texts of df."""
    return fit_candidates(candidates(df.select(F.col(text).alias("text")), "text", "c"), "c")


def accepted(found: Column, model: Model) -> Column:
    """The spans among a column of candidates: all base ones, and others that the model gives 0.5 or more."""
    kept = F.filter(found, lambda x: x.base | (model.logit(x) >= 0))
    ordered = F.sort_array(F.transform(kept, lambda x: F.struct(x.k.alias("k"), x.s.alias("s"), x.e.alias("e"), x.base.alias("base"))))
    names = F.array(*map(F.lit, KINDS))
    return F.transform(ordered, lambda x: F.struct(names[x.k].alias("kind"), x.s.alias("start"), x.e.alias("end"), x.base.alias("base")))


def detect(df: DataFrame, model: Model, text: str = "text", out: str = "pii") -> DataFrame:
    """df with the array `out` of struct(kind, start, end, base): code point offsets, end exclusive,
    by KINDS, then start.  All exact spans that pass their test, and looser ones that the model
    gives 0.5 or more; those overlap no exact span.

    Null and empty texts have none; whole texts are searched; repeated rows have the same spans; an empty
    table stays empty; a column named `out` is replaced.
    """
    (found,) = unused(df, "__cand")
    df = candidates(df, text, found)
    return df.withColumn(out, accepted(F.col(found), model)).drop(found)


def fit_detect(df: DataFrame, text: str = "text", out: str = "pii", keep_text: bool = True) -> DataFrame:
    """detect with a model fitted on df itself.  Texts are searched once: the candidates are written with df's
    columns (without the text, if it isn't kept) before the model is fitted."""
    (found,) = unused(df, "__cand")
    marked = candidates(df, text, found)
    marked = materialize(marked if keep_text else marked.drop(text), "pii-candidates")
    return marked.withColumn(out, accepted(F.col(found), fit_candidates(marked, found))).drop(found)


def redact(df: DataFrame, text: str = "text", spans: str = "pii", block: int = 1024) -> DataFrame:
    """df with each span of the text replaced by its kind in brackets; of spans that overlap, the first
    to start takes the place of all.  Texts without spans, null ones among them, stay as they are.

    The text is cut into blocks once, so that the text before a span isn't counted through for each span.
    """
    t, n = F.col(text), F.char_length(text)
    blocks, kept = unused(df, "__blocks", "__kept")
    ordered = F.sort_array(F.transform(F.col(spans), lambda x: F.struct(x.start.alias("s"), (-x.end).alias("e"), x.kind.alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,s:int,k:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.array(F.struct(acc["at"].alias("a"), x.s.alias("s"), x.k.alias("k")))
        return F.struct(F.greatest(acc["at"], -x.e).alias("at"), F.when(x.s < acc["at"], acc.out).otherwise(F.concat(acc.out, new)).alias("out"))

    def piece(a: Column, b: Column) -> Column:
        first, last = F.floor(a / block).cast("int"), F.floor((b - 1) / block).cast("int")
        joined = F.array_join(F.slice(F.col(blocks), first + 1, last - first + 1), "")
        return F.when(b > a, F.substring(joined, a - first * block + 1, b - a)).otherwise("")

    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.substring(t, b * block + 1, F.lit(block)))
    some = F.size(spans) > 0
    out = df.withColumns({blocks: F.when(some, cut), kept: F.when(some, F.aggregate(ordered, start, step))})
    parts = F.transform(F.col(f"{kept}.out"), lambda x: F.concat(piece(x.a, x.s), F.lit("["), F.upper(x.k), F.lit("]")))
    done = F.concat(F.array_join(parts, ""), piece(F.col(f"{kept}.at"), n))
    return fenced(out.withColumn(text, F.when(some, done).otherwise(t)), [text]).drop(blocks, kept)
