"""SimHash near-duplicates by covering locality-sensitive hashing.

Distinct 64-bit fingerprints are dealt into buckets by what stays of them under structured bit masks.
Each bit gets a non-zero label of radius + 1 bits; the mask of v keeps the bits whose label has an odd
overlap with v.  At most `radius` differing bits have labels that some v is orthogonal to, so any two
fingerprints within the radius agree under at least one mask: no pair is missed.

A bucket that holds too many fingerprints is dealt again by the same construction over the bits that
its mask left free; each level roughly halves these, so a bucket ends at 2 ** free bits distinct
fingerprints at most, and nothing is capped.  Buckets give spanning edges, not all pairs; components
come from alternating large-star and small-star rounds over the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarden.llm.runtime import bound_batches, materialize, text_of

SHINGLE, SEED, RADIUS = 3, 42, 3
ROOM = 512
_CHUNK, _ROWS = 1 << 16, 1 << 16


def fingerprint(text: str) -> int:
    """Signed 64-bit SimHash: a bit is 1 if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))) or [b" ".join(words)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _CHUNK):
        part = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles[at : at + _CHUNK]), np.uint64, min(_CHUNK, len(shingles) - at))
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view("<i8")[0])


def child_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that keep the bits of `mask` and, of the others, those labelled oddly; as signed longs."""
    labels = (1 << (radius + 1)) - 1
    free = [i for i in range(64) if not mask >> i & 1]
    out = []
    for v in range(1, labels + 1):
        kept = mask & 0xFFFFFFFFFFFFFFFF
        for k, i in enumerate(free):
            if ((k % labels + 1) & v).bit_count() & 1:
                kept |= 1 << i
        out.append(kept - (1 << 64) if kept >> 63 else kept)
    return sorted(set(out))


def _flat(label: np.ndarray) -> np.ndarray:
    while (label[label] != label).any():
        label = label[label]
    return label


def _close(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the smallest row of its cluster, among rows of one group; groups are contiguous.  Rows at a
    growing distance in the group are compared, and links are merged at once: no list of pairs is kept."""
    label, shift = np.arange(len(fp)), 1
    at = np.arange(len(fp) - 1)
    while len(at := at[at + shift < len(fp)]) and len(at := at[group[at] == group[at + shift]]):
        near = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= radius]
        a, b = label[near], label[near + shift]
        while len(apart := np.flatnonzero(a != b)):
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            label = _flat(label)
            a, b = label[a], label[b]
        shift += 1
    return label, np.flatnonzero(label != np.arange(len(fp)))


def _edges(batches: Iterator[pd.DataFrame], radius: int, room: int) -> Iterator[pd.DataFrame]:
    """Batches sorted by bucket.  Small buckets give (0, row's id, cluster's id, 0); rows of others
    give (1, id, fingerprint, mask) for the next level.  Holds one buffer and one small bucket."""
    held: list[pd.DataFrame] = []
    size = 0
    crowded = None  # the bucket that is being passed on

    def work(rows: pd.DataFrame, final: bool) -> tuple[list[pd.DataFrame], pd.DataFrame | None]:
        nonlocal crowded
        mask, key, fp, rep = (rows[c].to_numpy(np.int64) for c in ("mask", "key", "fp", "rep"))
        new = np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        over = sizes > room
        if crowded is not None:
            over[0] |= crowded == (mask[0], key[0])
        rest = None
        done = np.ones(len(rows), bool)
        if not final:
            if over[-1]:
                crowded = (mask[-1], key[-1])
            else:
                crowded, done = None, group != group[-1]
                rest = rows[~done]
        out, pass_on = [], done & over[group]
        if pass_on.any():
            out.append(pd.DataFrame({"kind": 1, "a": rep[pass_on], "b": fp[pass_on], "mask": mask[pass_on]}))
        use = np.flatnonzero(done & ~over[group] & (sizes[group] > 1))
        if len(use):
            label, moved = _close(fp[use], group[use], radius)
            if len(moved):
                a, b = rep[use][moved], rep[use][label[moved]]
                out.append(pd.DataFrame({"kind": 0, "a": np.maximum(a, b), "b": np.minimum(a, b), "mask": 0}).drop_duplicates())
        return out, rest

    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch)
        if size >= _ROWS:
            out, rest = work(pd.concat(held, ignore_index=True), False)
            held, size = ([rest], len(rest)) if rest is not None else ([], 0)
            yield from out
    if held:
        yield from work(pd.concat(held, ignore_index=True), True)[0]


def links(ids: DataFrame, radius: int = RADIUS, room: int = ROOM) -> DataFrame:
    """Spanning edges (a, b), a > b, of the graph on ids.rep whose links are distances <= radius of
    ids.fp.  Fingerprints must be distinct."""
    keyed = lambda df, masks: df.select("fp", "rep", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).select("mask", "key", "fp", "rep")
    level = keyed(ids, F.array(*(F.lit(m) for m in child_masks(0, radius))))
    edges, depth, masks = None, 0, child_masks(0, radius)
    while True:
        dealt = level.repartition(F.col("mask"), F.col("key")).sortWithinPartitions("mask", "key", "fp")
        free = min(64 - (m & 0xFFFFFFFFFFFFFFFF).bit_count() for m in masks)
        most = max(64 - (m & 0xFFFFFFFFFFFFFFFF).bit_count() for m in masks)
        limit = room if most > 9 else max(room, 1 << most)
        found = materialize(dealt.mapInPandas(lambda it, n=limit: _edges(it, radius, n), "kind int, a long, b long, mask long"), f"simhash-level{depth}")
        here = found.where("kind = 0").select("a", "b").where("a <> b")
        edges = here if edges is None else edges.unionByName(here)
        crowded = found.where("kind = 1")
        masks = [r["mask"] for r in crowded.select("mask").distinct().collect()]  # masks of a level: 15 ** depth at most
        if not masks or free == 0 and most == 0:
            return edges.distinct()
        # A row for each crowded mask of a level: 15 ** depth at most, at radius 3.
        table = ids.sparkSession.createDataFrame([(m, child_masks(m, radius)) for m in masks], "mask long, masks array<long>")
        level = keyed(crowded.select(F.col("b").alias("fp"), F.col("a").alias("rep"), "mask").join(F.broadcast(table), "mask"), F.col("masks"))
        level = level.dropDuplicates(["mask", "fp"])
        masks = [c for m in masks for c in child_masks(m, radius)]
        depth += 1


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that isn't its component's smallest, and that smallest node.  Alternating large-star and
    small-star rounds over the edges themselves, however few, until nothing changes; each round is written out."""
    state, seen, turn = materialize(edges.select("a", "b").distinct(), "stars"), None, 0
    while True:
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(mark) == seen or not mark["n"]:
            return state
        seen = tuple(mark)
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).union(state.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        state, turn = materialize(small.distinct(), f"stars{turn}"), turn + 1


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of df: key, fingerprint (16 hex digits), component_id (the smallest key that
    links at `radius` or fewer differing bits reach, itself included).

    key must be a whole number.  Null, empty and blank texts have fingerprint zero and are linked like
    others.  Null keys take part with the component of their fingerprint, null if all of that component's
    keys are null.  Repeated rows keep their rows.  An empty table gives an empty table.
    Other columns are ignored, whatever their names.
    """
    bound_batches(df.sparkSession)

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    prints = materialize(df.select(F.col(key).cast("long").alias("id"), fingerprints(text_of(text)).alias("fp")), "simhash-prints")
    ids = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-ids")
    roots = components(links(ids.select("fp", F.col("fp").alias("rep")), radius))
    found = ids.join(roots, F.col("fp") == F.col("a"), "left").select(F.col("fp").alias("f"), "least", F.coalesce("b", "fp").alias("root"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written out, so that the join below is alone in its stage and a common print's rows can be split.
    found = materialize(found.join(least, "root").select("f", "component_id"), "simhash-found")
    out = prints.join(found, F.col("fp") == F.col("f"))
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
