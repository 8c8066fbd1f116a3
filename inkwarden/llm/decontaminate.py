"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

A seed is a run of SEED words of an item that few items share (RARE texts at most; an item that has no such run
keeps its rarest ones).  How many share it is counted over the whole benchmark; the corpus plays no part in it, so
that its size changes no result.  The benchmark is the query set and is taken in blocks of bounded size; each
block's rare seeds are broadcast and looked up in every text.  A hit with its surroundings is a passage.
Passages that hold too few of the item's words, each as often as in the item, to reach the threshold
are left out before anything is written; the bound is exact.  An alignment matches words at +2 and pays 1 for
each word changed, added or left out; the score is its share of a perfect match of the whole item.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from inkwarden.llm.hashing import Hashes, hash_words, prefix, range_hash
from inkwarden.llm.runtime import bound_batches, materialize, plain_words, text_of

SEED, RARE = 3, 64
BLOCK, BLOCK_BYTES = 20_000, 32_000_000
MATCH, CHANGE = 2, 1
_BITMAP = 1 << 22


def seed_hashes(words: list[bytes], cache: Hashes) -> np.ndarray:
    """Hash of each run of SEED words, in order."""
    if len(words) < SEED:
        return np.zeros(0, np.uint64)
    return range_hash(*prefix(hash_words(words, cache)), np.arange(len(words) - SEED + 1), SEED)


def item_words(text: str) -> list[bytes]:
    return plain_words(text.lower())


def rare_seeds(items: DataFrame) -> DataFrame:
    """items (item, text) with `rare`, the hashes of each text's rare seeds; texts without a seed go."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for batch in batches:
            for th, text in zip(batch["th"], batch["text"], strict=True):
                yield pd.DataFrame({"th": th, "g": np.unique(seed_hashes(item_words(text), cache)).view(np.int64)})

    items = items.withColumn("th", F.xxhash64("text"))
    pairs = items.select("th", "text").distinct().mapInPandas(cut, "th long, g long")
    counted = pairs.join(pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")
    seeds = counted.groupBy("th").agg(F.min("n").alias("least"), F.collect_list(F.struct("g", "n")).alias("all"))
    rare = F.transform(F.filter("all", lambda x: x.n <= F.greatest(F.lit(RARE), F.col("least"))), lambda x: x.g)
    return items.join(seeds.select("th", rare.alias("rare")), "th").select("item", "text", "rare")


class Block:
    """A block's texts and the lookup tables for their rare seeds and words."""

    def __init__(self, rows: list[Row]):
        cache = Hashes()
        texts = {r["text"]: r["rare"] for r in rows}
        numbers = {text: i for i, text in enumerate(sorted(texts))}
        self.names = [(numbers[r["text"]], r["item"]) for r in rows]
        self.words = [item_words(text) for text in numbers]
        self.counts = [Counter(words) for words in self.words]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, (text, words) in enumerate(zip(numbers, self.words, strict=True)):
            h = seed_hashes(words, cache)
            for at in np.flatnonzero(np.isin(h, np.array(texts[text], np.int64).view(np.uint64))).tolist():
                places[int(h[at])].append((number, at))
        self.seeds = np.array(sorted(places), np.uint64)
        self.places = [places[g] for g in self.seeds.tolist()]
        self.seed_map = self._bitmap(self.seeds)

    @staticmethod
    def _bitmap(values: np.ndarray) -> np.ndarray:
        out = np.zeros(_BITMAP, bool)
        out[(values & np.uint64(_BITMAP - 1)).astype(np.int64)] = True
        return out

    @staticmethod
    def lookup(values: np.ndarray, table: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in values whose value is in the sorted table, and where."""
        maybe = np.flatnonzero(bitmap[(values & np.uint64(_BITMAP - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(table, values[maybe]), len(table) - 1)
        fits = table[at] == values[maybe]
        return maybe[fits], at[fits]

    def reaches(self, number: int, words: list[bytes], threshold: float) -> bool:
        """Whether an alignment with these words can score `threshold`: each match takes a word of both."""
        return sum((self.counts[number] & Counter(words)).values()) >= threshold * len(self.words[number])


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Smith-Waterman scores of (item, passage) id arrays, and where in the passage each ends; a batch
    is filled row by row of the items, all passages at once."""
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    at = 0
    while at < len(order):
        stop = at
        while stop < len(order) and (stop == at or (stop - at + 1) * len(pairs[order[stop]][1]) <= 1 << 18):
            stop += 1
        part = order[at:stop]
        at = stop
        rows, width = max(len(pairs[k][0]) for k in part), max(1, max(len(pairs[k][1]) for k in part))
        a, b = np.full((len(part), rows), -2, np.int32), np.full((len(part), width), -3, np.int32)
        for i, k in enumerate(part):
            a[i, : len(pairs[k][0])], b[i, : len(pairs[k][1])] = pairs[k]
        slope = CHANGE * np.arange(width + 1, dtype=np.int32)
        h = np.zeros((len(part), width + 1), np.int32)
        best, end = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
        for i in range(rows):
            e = np.maximum(h - CHANGE, 0)
            np.maximum(e[:, 1:], h[:, :-1] + np.where(b == a[:, i : i + 1], MATCH, -CHANGE), out=e[:, 1:])
            e[:, 0] = 0
            h = np.maximum.accumulate(e + slope, axis=1) - slope
            top = h.argmax(axis=1)
            value = h[np.arange(len(part)), top]
            better = value > best
            best[better], end[better] = value[better], top[better]
        for i, k in enumerate(part):
            out[k] = (int(best[i]), int(end[i]))
    return out


def _passages(found: np.ndarray, seeds: np.ndarray, size: int, block: Block) -> list[tuple[int, int, int]]:
    """(item, start, end) of one text from its hits: around each hit as much as the item could
    reach; passages of one item that touch are one."""
    by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at, seed in zip(found.tolist(), seeds.tolist(), strict=True):
        for number, offset in block.places[seed]:
            n = len(block.words[number])
            pad = n // 4 + 4
            by_item[number].append((max(0, at - offset - pad), min(size, at - offset + n + pad)))
    out = []
    for number, hits in by_item.items():
        hits.sort()
        start, end = hits[0]
        for a, b in hits[1:]:
            if a > end:
                out.append((number, start, end))
                start, end = a, b
            else:
                end = max(end, b)
        out.append((number, start, end))
    return out


_FOUND = "id {kind}, item int, start long, words binary"


def _block_pairs(docs: DataFrame, rows: list[Row], item_type: str, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Block(rows))  # BLOCK items and about BLOCK_BYTES at most
    kind = docs.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, cache = shared.value, Hashes()
        for batch in batches:
            rows = []
            for ident, text in zip(batch["id"], batch["t"], strict=True):
                words = item_words(text)
                h = seed_hashes(words, cache)
                if len(h) and len(block.seeds):
                    found, seeds = block.lookup(h, block.seeds, block.seed_map)
                    if len(found):
                        rows += [(ident, number, a, b" ".join(words[a:b])) for number, a, b in _passages(found, seeds, len(words), block) if block.reaches(number, words[a:b], threshold)]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "item", "start", "words"])

    found = materialize(docs.mapInPandas(search, _FOUND.format(kind=kind)), "leak-passages")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        for batch in batches:
            pairs, sizes = [], []
            for number, passage in zip(batch["item"], batch["words"], strict=True):
                ids: dict[bytes, int] = {}
                item = np.array([ids.setdefault(w, len(ids)) for w in block.words[int(number)]], np.int32)
                pairs.append((item, np.array([ids.get(w, -1) for w in passage.split()], np.int32)))
                sizes.append(len(item))
            done = align(pairs)
            good = [k for k, (s, _) in enumerate(done) if s >= threshold * MATCH * sizes[k]]
            back = align([(pairs[k][0][::-1], pairs[k][1][: done[k][1]][::-1]) for k in good])
            at = batch.reset_index(drop=True)
            yield pd.DataFrame(
                [(at["id"][k], int(at["item"][k]), done[k][0] / (MATCH * sizes[k]), int(at["start"][k]) + done[k][1] - b, int(at["start"][k]) + done[k][1]) for k, (_, b) in zip(good, back, strict=True)],
                columns=["id", "item", "score", "first_word", "end_word"],
            )

    scored = found.mapInPandas(score, f"id {kind}, item int, score double, first_word long, end_word long")
    names = spark.createDataFrame(shared.value.names, f"item int, name {item_type}")  # BLOCK rows at most
    return scored.join(F.broadcast(names), "item").drop("item")


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.5, block: int = BLOCK) -> DataFrame:
    """One row per pair of document and benchmark item with an alignment of `threshold` or more: key, item,
    score (0 to 1, of its best passage), first_word and end_word (word offsets of that alignment, end exclusive).

    Words are compared without case and punctuation.  Null and empty texts and items, and items of fewer than
    SEED words, match nothing, nor does an alignment without a rare seed of the item; rows of one key count as
    one document, null keys together; repeated items count once; empty tables give an empty table.  Other columns
    are ignored, whatever their names.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(key).alias("id"), text_of(text).alias("t"))
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct()
    items = materialize(rare_seeds(items), "leak-items")
    total, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-2 * total // block) if total > block else 1, -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1)
    item_type = items.schema["item"].dataType.simpleString()
    out = None
    for number in range(blocks):  # hashed blocks of half the size on average, so that none exceeds it
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number).collect()
        part = _block_pairs(docs, sorted(rows, key=lambda r: (str(r["item"]), r["text"])), item_type, threshold)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("at"), "end_word")).alias("b")
    out = out.groupBy("id", "name").agg(best)
    return out.select(F.col("id").alias(key), F.col("name").alias(item), "b.score", (-F.col("b.at")).alias("first_word"), "b.end_word")
