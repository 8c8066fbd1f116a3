"""URL filters: domain and path rules first, a trained classifier for the rest.

The classifier is a logistic regression on hashed character n-grams of host and path, fitted
in numpy on the driver from a small labelled URL table and applied batch by batch to the urls that no rule decides.  Its weights are
`2 ** BITS` floats whatever the input's size, so they can always be broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.llm.runtime import bound_batches

BITS = 15
GRAMS = (3, 4, 5)

#: (verdict, rule): the host comes before the first slash, the path's beginning follows.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Words of the labelled hosts, by family.
BAD_WORDS = (
    "casinos", "casinoroyale", "megacasino", "casinobonus", "onlinecasino", "casinoclub", "betting", "sportsbet", "betnow", "livebet", "bettips", "bets24",
    "pokerroom", "pokerbonus", "onlinepoker", "pokerchips", "slotmachine", "megaslots", "slotbonus", "luckyslots", "jackpots", "jackpotcity", "bigjackpot", "jackpotparty",
    "pillstore", "dietpills", "pillshop", "pharmapills", "viagrashop", "genericviagra", "viagraonline", "cialisviagra", "adultchat", "adultvideo", "adults-only", "adultdating",
    "xxxvideo", "xxxtube", "freexxx", "xxxcams", "pornhub", "freeporn", "porntube", "pornstars", "sexcams", "livesex", "sexchat", "sexshop",
    "spammers", "spamlist", "bulkspam", "spamlinks", "linkfarms", "clickfarm", "contentfarm", "farmlinks", "adserver", "adsnetwork", "popads", "adsclick", "tracker", "adtracker", "trackingpixel", "clicktrack",
    "paydayloans", "fastloans", "instantloan", "loanoffer", "cheapmeds", "cheaprolex", "cheap-viagra", "cheaploans", "freemoney", "free-prizes", "freespins", "freegift", "winmoney", "winbig", "prize-winner", "winprizes",
)
GOOD_WORDS = (
    "newsroom", "dailynews", "newspaper", "localnews", "citylibrary", "librarian", "library-online", "publiclibrary", "gardening", "gardens", "mygarden", "gardenclub",
    "schoolbook", "highschool", "musicschool", "schools", "weathermap", "cityweather", "weather24", "weatherstation", "recipes", "recipebook", "bestrecipes", "dailyrecipe",
    "historymuseum", "historybook", "localhistory", "arthistory", "artmuseum", "museumshop", "museums", "citymuseum", "sciencemag", "science-news", "computerscience", "scienceclub",
    "travelguide", "traveling", "citytravel", "travelbook", "musicians", "livemusic", "musicroom", "classicmusic", "bookshop", "bookclub", "handbooks", "cookbook",
    "healthcare", "publichealth", "healthguide", "healthcentre", "university", "universities", "openuniversity", "universitypress", "forums", "techforum", "forumonline", "gameforum",
    "archives", "webarchive", "cityarchive", "archive-search", "theaterclub", "theaters", "citytheater", "theaterguide", "footballclub", "football", "footballnews", "sportsclub", "hospital", "cityhospital", "hospitals", "kitchenware", "kitchens", "mykitchen", "filmclub", "films",
)
_PREFIXES = ("", "www.", "blog.", "m.")
_ENDS = ("com", "net", "org")
_PATHS = ("/en/1042", "/de/20711.html", "/fr/355/", "/es/8120")
_NAMES = 100


def invented_names(count: int = _NAMES) -> list[str]:
    """Names made of syllables by rule: hosts of which nothing is known are allowed."""
    parts = [a + b for a in ("b", "ch", "d", "f", "gr", "l", "m", "n", "pr", "r", "s", "t", "th", "v", "wh") for b in ("a", "an", "at", "e", "ent", "er", "in", "ing", "o", "ou")]
    pick = lambda i, k: parts[zlib.crc32(f"{i}:{k}".encode()) % len(parts)]
    return ["".join(pick(i, k) for k in range(2 + i % 3)) for i in range(count)]


def labelled_urls(bad: Sequence[str] = BAD_WORDS, good: Sequence[str] = GOOD_WORDS, names: int = _NAMES) -> list[tuple[str, str, int]]:
    """(host, path, 1 for block): each word under each prefix and ending, with paths in turn, so that
    words alone tell the classes apart and prefixes, endings and paths don't; invented names once each."""
    hosts = list(product(_PREFIXES, _ENDS, ("", "example.")))
    rows = [
        (f"{prefix}{word}.{domain}{end}", _PATHS[(i + k) % len(_PATHS)], label)
        for label, words in ((1, bad), (0, good))
        for k, word in enumerate(words)
        for i, (prefix, end, domain) in enumerate(hosts[k % 3 :: 3])
    ]
    for k, name in enumerate(invented_names(names)):
        prefix, end, domain = hosts[k % len(hosts)]
        rows.append((f"{prefix}{name}.{domain}{end}", _PATHS[k % len(_PATHS)], 0))
    return rows


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; null or no :// gives ''."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    fit, verdict = F, F
    for action, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        domain, _, start = rule.partition("/")
        test = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        fit, verdict = fit.when(test, F.lit(rule)), verdict.when(test, F.lit(action))
    return (fit, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams; host and path are hashed apart, digits count as one character."""
    found = set()
    for mark, part in (("h", f".{host}."), ("p", path)):
        part = "".join("0" if c.isdigit() else c for c in part)
        for n in GRAMS:
            found.update(zlib.crc32(f"{mark}{part[i : i + n]}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for i in range(len(part) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def fit(table: Sequence[tuple[str, str, int]], rounds: int = 400, step: float = 2.0, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent on the log loss; rows are scaled to length 1.
    An empty table gives zero weights and a bias that never blocks."""
    weights, bias = np.zeros(1 << BITS), -1.0 if not table else 0.0
    if not table:
        return weights, bias
    rows = [features(h, p) for h, p, _ in table]
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = 1 / np.sqrt(np.maximum(1, [len(r) for r in rows]))
    y = np.array([label for _, _, label in table], float)
    for _ in range(rounds):
        z = np.bincount(of, weights[at], len(rows)) * scale + bias
        error = 1 / (1 + np.exp(-z)) - y
        weights -= step * (np.bincount(at, (error * scale)[of], 1 << BITS) / len(y) * 10 + shrink * weights)
        bias -= step * error.mean()
    return weights, bias


def score(host: str, path: str, weights: np.ndarray, bias: float) -> float:
    found = features(host, path)
    return float(1 / (1 + np.exp(-(weights[found].sum() / np.sqrt(max(1, len(found))) + bias))))


def judge(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, model: tuple[np.ndarray, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """df with host, path, rule, url_score (probability of block; null where a rule decides) and verdict
    (allow or block).

    The rule's verdict stands; only where none fits is the url scored, and url_score >= threshold blocks.  Null urls and urls
    without :// have empty host and path and an empty feature set: the bias alone judges them.
    Repeated rows are judged alike; an empty table stays empty; columns of these names are replaced.
    """
    spark = df.sparkSession
    bound_batches(spark)
    weights = spark.sparkContext.broadcast(model or fit(labelled_urls()))

    @F.pandas_udf("double")
    def scores(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        w, b = weights.value
        return pd.Series([None if h is None else score(h, p, w, b) for h, p in zip(hosts, paths, strict=True)], dtype="float64")

    out = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "verdict": action}).withColumn("url_score", F.nanvl(scores(F.when(F.col("rule").isNull(), F.col("host")), F.col("path")), F.lit(None)))
    judged = F.when(F.col("url_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce("verdict", judged))
