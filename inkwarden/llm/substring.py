"""Substring dedup: a compressed FM-index per shard finds word windows that smaller documents hold.

Every window of 50 words has a minimiser, the least hash of the 10-word runs inside it; equal windows have
the same one.  Runs that a sample of the corpus shows to be common come last in that order, so that a window
with anything rare in it is dealt by what is rare, and a passage that very many documents quote, each with
its own surroundings, is left as one content.  A document is cut into segments, runs of windows with one
minimiser.  A minimiser that only one document has can't be part of a repeat.  The other segments, each
distinct content once, are dealt into shards by minimiser.  A shard builds an FM-index over its segments
(suffix order, Burrows-Wheeler transform in a wavelet matrix of packed bits) and streams segments through it:
backward search gives the suffix range of each window, as far as the match goes, and a range minimum over the
suffixes' documents tells whether a smaller document holds it.

A minimiser with more than `room` distinct segments is dealt over several shards, and each of its segments is
streamed through all of them; whatever its size, every removed word is reported by an index.  Words are
compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarden.llm.hashing import Hashes, hash_words, prefix, range_hash
from inkwarden.llm.runtime import bound_batches, materialize, text_of

WINDOW, GRAM = 50, 10
MOST_WINDOWS = WINDOW + 1  # of a segment, so that its first and last window cover all of it
SHARD_WORDS = 500_000
ROOM = 1024
SAMPLE, COMMON = 5_000, 100_000
_BITMAP = 22


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def gram_hashes(h: np.ndarray) -> np.ndarray:
    return range_hash(*prefix(h), np.arange(len(h) - GRAM + 1), GRAM)


def segments(h: np.ndarray, sizes: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several documents' word hashes, one after the other: (minimiser, content hash, start in h,
    words) of each segment, in order.  common: a bitmap over the hashes' leading bits."""
    none = np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    sums, down = prefix(h)
    least = range_hash(sums, down, np.arange(len(h) - GRAM + 1), GRAM)
    if common is not None:
        least = (least >> np.uint64(1)) | (common[(least >> np.uint64(64 - _BITMAP)).astype(np.int64)].astype(np.uint64) << np.uint64(63))
    span, want = 1, WINDOW - GRAM + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    offsets = np.r_[0, np.cumsum(sizes)[:-1]]
    long = sizes >= WINDOW
    counts = sizes[long] - WINDOW + 1
    at = np.repeat(offsets[long] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    if not len(at):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    new = np.r_[True, (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)]
    runs = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(runs, np.diff(np.r_[runs, len(at)]))
    begin = np.flatnonzero(within % MOST_WINDOWS == 0)
    size = np.diff(np.r_[begin, len(at)]) + WINDOW - 1
    return least[at[begin]], range_hash(sums, down, at[begin], size), at[begin], size


class FMIndex:
    """FM-index over texts of symbols 1.., each ended by a 0, in a wavelet matrix of packed bits.

    Suffixes are ordered by their first 64 symbols, which backward search of up to 64 needs.  Symbols up to
    `most` can be searched for.
    """

    def __init__(self, text: np.ndarray, most: int | None = None):
        n, most = len(text), int(text.max()) if most is None else most
        rank, span = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while span < 64:
            key = rank * (int(rank.max()) + 2)
            key[:-span] += rank[span:] + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
            span *= 2
            if rank[order[-1]] == n - 1:
                break
        self.suffixes = order
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=most + 1))]  # suffixes that begin with a smaller symbol
        seq = text[order - 1]  # the symbol before each suffix; the last text's end comes before the first
        self.levels = max(1, most.bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            packed = np.packbits(np.r_[bit, np.zeros(-(n + 1) % 64 + 1, np.uint8)][: -(-(n + 1) // 64) * 64], bitorder="little").view("<u8")
            self.bits.append(packed)
            self.ranks.append(np.r_[0, np.cumsum(np.bitwise_count(packed).astype(np.int32))[:-1]].astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        symbols = np.arange(len(self.below) - 1)
        self.first = self._map(symbols, np.zeros(len(symbols), np.int64))

    def _map(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` of the transform goes when the symbol's bits are followed down."""
        for level in range(self.levels):
            block, low = at >> 6, (at & 63).astype(np.uint64)
            ones = self.ranks[level][block] + np.bitwise_count(self.bits[level][block] & ((np.uint64(1) << low) - np.uint64(1)))
            at = np.where(symbol >> (self.levels - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of strings, each extended by a symbol on its left."""
        base = self.below[symbol] - self.first[symbol]
        both = self._map(np.r_[symbol, symbol], np.r_[low, high])
        return base + both[: len(low)], base + both[len(low) :]

    def matches(self, text: np.ndarray, ends: np.ndarray, most: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each end in text the length (`most` at most) of the longest string
        ending there that occurs more than `own` times (the occurrences known before), and its suffix range."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.suffixes), np.int64)
        length, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for k in range(1, most + 1):
            a, b = self.back(text[ends[live] - k], low[live], high[live])
            more = b - a > own[live]
            live = live[more]
            low[live], high[live], length[live] = a[more], b[more], k
            if not len(live):
                break
        return length, low, high


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high], none of them empty, from a sparse table built as far as needed."""
    out = np.empty(len(low), values.dtype)
    size, level, span = high - low, values, 1
    while len(size):
        here = (size >= span) & (size < 2 * span)
        out[here] = np.minimum(level[low[here]], level[high[here] - span])
        if 2 * span > size.max():
            break
        level = np.minimum(level[:-span], level[span:])
        span *= 2
    return out


def shard_repeats(contents: list[np.ndarray], homes: np.ndarray, indexed: np.ndarray, streamed: np.ndarray, copied: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(segment, start, end, copy) of the word ranges that windows of WINDOW words in the index cover.

    indexed: segments that make up the index; streamed: those searched for windows of smaller homes; copied:
    indexed segments whose whole content larger documents hold too: what those documents lose is searched
    for as theirs and has copy = True."""
    sizes = np.array([len(c) for c in contents])
    flat = np.concatenate(contents)
    inside = np.repeat(indexed, sizes)
    known = np.unique(flat[inside])
    at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
    if not len(known):
        return []
    symbols = np.where(known[at] == flat, at + 1, len(known) + 1)
    # All segments, each after a 0; the index holds those of the mask.
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    text[np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(len(flat))] = symbols
    member = np.repeat(indexed, sizes + 1)
    index = FMIndex(text[member], len(known) + 1)
    documents = homes[np.repeat(np.arange(len(sizes)), sizes + 1)[member]][index.suffixes]

    def held(ends: np.ndarray, reader: np.ndarray, own: np.ndarray) -> np.ndarray:
        length, low, high = index.matches(text, ends, WINDOW, own)
        full = np.flatnonzero(length == WINDOW)
        out = np.zeros(len(ends), bool)
        out[full] = _range_min(documents, low[full], high[full]) < reader[full]
        return out

    out: list[tuple[int, int, int, bool]] = []

    def search(segs: np.ndarray, copy: bool) -> None:
        reader = homes + 1 if copy else homes  # any document after the home
        own = np.zeros(len(homes), np.int64) if copy else indexed.astype(np.int64)
        both = held(starts[segs] + WINDOW, reader[segs], own[segs]) & held(starts[segs] + sizes[segs], reader[segs], own[segs])
        out.extend((seg, 0, int(sizes[seg]), copy) for seg in segs[both].tolist())
        rest = segs[~both]
        for begin in range(0, len(rest), 4096):
            part = rest[begin : begin + 4096]
            counts = sizes[part] - WINDOW + 1
            of = np.repeat(part, counts)
            k = np.arange(counts.sum()) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
            found = held(starts[of] + k + WINDOW, reader[of], own[of])
            last = None
            for seg, pos in zip(of[found].tolist(), k[found].tolist(), strict=True):
                if last is not None and last[0] == seg and last[2] >= pos:
                    last = (seg, last[1], pos + WINDOW, copy)
                    out[-1] = last
                else:
                    last = (seg, pos, pos + WINDOW, copy)
                    out.append(last)

    search(np.flatnonzero(streamed), False)
    search(np.flatnonzero(copied & indexed), True)
    return out


def _common(docs: DataFrame) -> np.ndarray:
    """Bitmap of the runs of GRAM words that three or more of about SAMPLE documents have, the COMMON commonest at
    most.  It only orders runs: which repeats are found doesn't depend on it."""
    rate = min(1 << 30, (SAMPLE << 30) // max(1, docs.count()))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for batch in batches:
            for text in batch["t"]:
                h = hash_words(words_of(text), cache)
                if len(h) >= WINDOW:
                    yield pd.DataFrame({"g": np.unique(gram_hashes(h) >> np.uint64(64 - _BITMAP)).astype(np.int32)})

    seen = docs.where(F.pmod(F.xxhash64("id", "th"), F.lit(1 << 30)) < rate).select("t").mapInPandas(runs, "g int")
    found = seen.groupBy("g").count().where("count > 2").orderBy(F.desc("count"), "g").limit(COMMON).collect()  # COMMON rows at most
    out = np.zeros(1 << _BITMAP, bool)
    out[[r["g"] for r in found]] = True
    return out


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = Hashes()
    for batch in batches:
        for text, home, segs in zip(batch["t"], batch["id"], batch["segs"], strict=True):
            h = hash_words(words_of(text), cache)
            for at in range(0, len(segs), 4096):
                rows = [(x["shard"], x["mh"], x["sh"], home, x["indexed"], x["streamed"], x["copied"], h[x["s"] : x["s"] + x["w"]].tobytes()) for x in segs[at : at + 4096]]
                yield pd.DataFrame(rows, columns=["shard", "mh", "sh", "home", "indexed", "streamed", "copied", "words"])


def _search(part: pd.DataFrame) -> pd.DataFrame:
    flags = (part[c].to_numpy(bool) for c in ("indexed", "streamed", "copied"))
    found = shard_repeats([np.frombuffer(x, np.uint64) for x in part["words"]], part["home"].to_numpy(np.int64), *flags)
    seg = [s for s, *_ in found]
    out = part[["mh", "sh", "home"]].iloc[seg].reset_index(drop=True)
    return out.assign(a=[a for _, a, _, _ in found], b=[b for _, _, b, _ in found], copy=[c for *_, c in found]).astype({"a": "int64", "b": "int64", "copy": "bool"})


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for ident, th, text, ranges in zip(batch["id"], batch["th"], batch["t"], batch["gone"], strict=True):
            words = words_of(text)
            keep = np.ones(len(words), bool)
            for x in ranges:
                keep[x["a"] : x["b"]] = False
            kept = b" ".join(w for w, k in zip(words, keep, strict=True) if k)
            rows.append((ident, th, int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(rows, columns=["id", "th", "n_removed", "kept_sha256", "kept"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", room: int = ROOM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of df: key, n_words, n_removed, kept_sha256, and kept_text where words were removed
    (null elsewhere: the text's words, joined by a space, are all kept).

    Removed is each word inside a window of 50 words that also starts in a row with a smaller key; key must
    be a whole number.  Rows with a null key remove nothing and lose nothing; rows of one key don't
    remove each other's words, and each keeps its own text; rows that repeat in key and text are searched
    once.  Null, empty and short texts lose nothing.  An empty table gives an empty table.  Other columns are
    ignored, whatever their names.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t")).withColumn("th", F.xxhash64("t"))
    common = spark.sparkContext.broadcast(_common(docs))  # 2 ** _BITMAP bytes

    def cut_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for batch in batches:
            lists = [words_of(t) for t in batch["t"]]
            sizes = np.array([len(x) if known else 0 for x, known in zip(lists, batch["id"].notna(), strict=True)], np.int64)
            h = hash_words([w for x, n in zip(lists, sizes, strict=True) if n for w in x], cache)
            mh, sh, start, size = segments(h, sizes, common.value)
            offsets = np.r_[0, np.cumsum(sizes)]
            cuts = np.searchsorted(start, offsets[1:-1]) if len(sizes) > 1 else []
            local = start - offsets[np.searchsorted(offsets, start, side="right") - 1]
            split = lambda x, kind: list(np.split(x.astype(kind), cuts)) if len(sizes) else []
            yield pd.DataFrame({
                "id": batch["id"].astype("Int64"), "th": batch["th"], "n": [len(x) for x in lists], "sha": [hashlib.sha256(b" ".join(x)).hexdigest() for x in lists],
                "mh": split(mh.view(np.int64), np.int64), "sh": split(sh.view(np.int64), np.int64), "s": split(local, np.int32), "w": split(size, np.int32),
            })

    schema = "id long, th long, n long, sha string, mh array<long>, sh array<long>, s array<int>, w array<int>"
    cut = materialize(docs.mapInPandas(cut_texts, schema).withColumn("row", F.monotonically_increasing_id()), "sub-cut")
    again = materialize(cut.where("id is not null").groupBy("id", "th").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "th", "first"), "sub-again")
    once = cut.where("size(mh) > 0").join(again, ["id", "th"], "left").where("first is null or row = first")
    segs = once.select("id", "th", F.explode(F.arrays_zip("mh", "sh", "s", "w")).alias("x")).select("id", "th", "x.*")
    # Written out, so that the join is alone in its stage and a crowded minimiser's rows can be split.
    shared = materialize(segs.groupBy("mh").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("mh"), "sub-shared")
    places = materialize(segs.join(shared, "mh"), "sub-places")
    texts = materialize(docs.dropDuplicates(["id", "th"]).join(places.select("id", "th").distinct(), ["id", "th"]), "sub-texts")

    distinct = materialize(places.groupBy("mh", "sh").agg(F.min(F.struct("id", "th", "s", "w")).alias("home"), F.max("id").alias("last")), "sub-distinct")
    crowd = materialize(distinct.groupBy("mh").agg(F.ceil(F.count(F.lit(1)) / room).alias("parts"), F.min("home.id").alias("least")), "sub-crowd")
    shards = F.lit(max(1, -(-(distinct.agg(F.sum("home.w")).first()[0] or 0) // shard_words)))
    own, part = F.pmod(F.xxhash64("sh"), F.col("parts")), F.col("part")
    later, copied = F.col("home.id") > F.col("least"), (F.col("last") > F.col("home.id")) & (part == own)
    dealt = distinct.join(crowd, "mh").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where((part == own) | later)
    item = F.struct(F.pmod(F.xxhash64("mh", "part"), shards).alias("shard"), "mh", "sh", F.col("home.s").alias("s"), F.col("home.w").alias("w"), (part == own).alias("indexed"), later.alias("streamed"), copied.alias("copied"))
    wanted = dealt.groupBy(F.col("home.id").alias("id"), F.col("home.th").alias("th")).agg(F.collect_list(item).alias("segs"))
    schema = "shard long, mh long, sh long, home long, indexed boolean, streamed boolean, copied boolean, words binary"
    contents = texts.join(wanted, ["id", "th"]).select("id", "t", "segs").mapInPandas(_contents, schema)
    found = contents.groupBy("shard").applyInPandas(_search, "mh long, sh long, home long, a long, b long, copy boolean")
    range_of = lambda test: F.collect_list(F.when(test, F.struct("a", "b")))
    ranges = materialize(found.groupBy("mh", "sh").agg(F.min("home").alias("lo"), range_of(~F.col("copy")).alias("parts"), range_of(F.col("copy")).alias("copies")), "sub-ranges")

    gone = places.join(ranges, ["mh", "sh"]).select("id", "th", "s", F.explode(F.when(F.col("id") > F.col("lo"), F.col("copies")).otherwise(F.col("parts"))).alias("p"))
    gone = gone.groupBy("id", "th").agg(F.collect_list(F.struct((F.col("s") + F.col("p.a")).alias("a"), (F.col("s") + F.col("p.b")).alias("b"))).alias("gone"))
    stripped = texts.join(gone, ["id", "th"]).select("id", "th", "t", "gone").mapInPandas(_strip, "id long, th long, n_removed long, kept_sha256 string, kept string")
    out = cut.select("id", "th", "n", "sha").join(stripped, ["id", "th"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.col("kept").alias("kept_text"))
