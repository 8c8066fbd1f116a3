"""Mixing sources to target weights by pivotal dependent rounding, in built-in expressions only.

Each document's expected copies are its source's target over its source's size.  The whole part is
taken as it is.  For the fraction, documents of a source are dealt into small buckets by hash; in each,
one pass pairs the fraction carried so far with the next document's and moves words at random from one
to the other, the expected values unchanged, until one of the two is 0 or 1.  The one document of
each bucket that is left over goes up a reduction tree, where the same pass combines 64 buckets at a
time.  Moves keep each source's words exactly, so its total misses the target by less than one document;
large documents go first, and the small ones make up for the last of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwarden.llm.runtime import WORD, materialize, text_of

WEIGHTS = (5.0, 2.0, 1.0)
BUCKET, FAN = 128, 64


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, units, target; sizes has source, size and m (rows alike).

    Sources by code point, null last, weigh weights in turn and share all sizes; a target stops at `most`
    times its source's size and the excess goes to the others by weight.  Ranks come from a range
    partitioning and per-partition counts, so no task sees every source.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    ranged = materialize(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("pid", F.spark_partition_id()), "mix-sources")
    before, at = [], 0
    for r in sorted(ranged.groupBy("pid").count().collect()):
        before.append((r["pid"], at))
        at += r["count"]
    if not before:
        return ranged.select("source", "source_size", "units", F.lit(0.0).alias("target"))
    offsets = spark.createDataFrame(before, "pid int, before long")  # a row per partition
    rank = F.col("before") + F.row_number().over(Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranged = ranged.join(F.broadcast(offsets), "pid").withColumn("rank", rank).withColumn("w", pick).withColumn("cap", most * F.col("source_size"))
    # Water filling: the level only rises, so the set of full sources only grows.
    level, full = 0.0, -1
    while True:
        over = F.col("w") * level > F.col("cap")
        r = ranged.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("open"), F.sum(over.cast("int")).alias("n")).first()
        if r["n"] == full or not r["open"]:
            break
        full, level = r["n"], (r["all"] - r["held"]) / r["open"]
    return ranged.select("source", "source_size", "units", F.least(F.col("cap"), F.col("w") * level).alias("target"))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _chance(seed: int, *keys: Column) -> Column:
    return F.xxhash64(F.lit(seed), *keys).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))


def _meet(c: Column, e: Column, seed: int) -> Column:
    """Carried unit c meets unit e.  x is the words expected of a unit, at most its size w: either up to a
    words move from e to c or up to b from c to e, by chances that keep both expectations.  Gives
    the unit settled, with hit 0 or 1, and the unit carried on."""

    def settle(v: Column) -> Column:
        up = v.u * (v.a + v.b) < v.b
        c_full, c_empty = up & (c.w - c.x <= e.x), ~up & (c.x <= e.w - e.x)
        moved = F.when(up, v.a).otherwise(-v.b)
        unit = lambda s, x: F.struct(s.id.alias("id"), s.w.alias("w"), x.alias("x"))
        c_done = c_full | c_empty
        return F.struct(
            F.when(c_done, F.struct(c.id.alias("id"), c_full.cast("int").alias("hit"))).otherwise(F.struct(e.id.alias("id"), (~up).cast("int").alias("hit"))).alias("done"),
            F.when(c_done, unit(e, F.greatest(F.lit(0.0), F.least(e.w, e.x - moved)))).otherwise(unit(c, F.greatest(F.lit(0.0), F.least(c.w, c.x + moved)))).alias("carry"),
        )

    pair = F.struct(F.least(c.w - c.x, e.x).alias("a"), F.least(c.x, e.w - e.x).alias("b"), _chance(seed, c.id, e.id).alias("u"))
    return _let(pair, settle)


def _round_bucket(units: Column, id_type: str, seed: int) -> Column:
    """One pass over a bucket's units: struct(carry, done)."""
    unit_type = f"struct<id:{id_type},w:double,x:double>"
    start = F.struct(units[0].cast(unit_type).alias("carry"), F.array().cast(f"array<struct<id:{id_type},hit:int>>").alias("done"))

    def step(acc: Column, e: Column) -> Column:
        return _let(_meet(acc.carry, e, seed), lambda v: F.struct(v.carry.alias("carry"), F.concat(acc.done, F.array(v.done)).alias("done")))

    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def _tree(units: DataFrame, of: tuple[str, ...], id_type: str, count: str, most: int, seed: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """(settled, left over): units have of, `count` (open units of the source), unit = struct(id, w, x).  Settled
    rows have of, id, hit; left over is one carried unit per source.  most: the largest count."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), "unit.id"), F.ceil(F.col(count) / BUCKET))
    level, settled, depth, buckets = units.select(*of, bucket.alias("bucket"), "unit"), None, 0, -(-most // BUCKET)
    while True:
        grouped = level.groupBy(*of, "bucket").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        done = materialize(grouped.select(*of, "bucket", _round_bucket(F.col("units"), id_type, seed + depth).alias("r")), f"mix-{tag}{depth}")
        here = done.select(*of, F.explode("r.done").alias("d")).select(*of, "d.id", "d.hit")
        settled = here if settled is None else settled.unionByName(here)
        level = done.select(*of, F.floor(F.col("bucket") / FAN).alias("bucket"), F.col("r.carry").alias("unit"))
        depth += 1
        if buckets <= 1:
            return settled, level.select(*of, "unit")
        buckets = -(-buckets // FAN)


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, most: float = 3.0, seed: int = 11) -> DataFrame:
    """One row per row of df: key, size, source_size, target, taken (size * copies), source, copies.

    Size is the text's words; null and empty texts have size 0, take nothing, and a null source is a
    source of its own.  Rows alike in key, source and size share the copies due to them as evenly as can
    be.  Documents above their source's mean size are rounded first; what the last of them is above or below
    its expected words is taken from or given to the others' expectations, so that a source misses its
    target by a part of a document of mean size at most, unless its small ones can't take that up.  Chances
    come from hashes of keys and sizes, so reruns agree however rows are partitioned.  An empty table gives
    an empty table.  Other columns of df are ignored, whatever their names.
    """
    sized = materialize(df.select(F.col(key).alias("k"), F.col(source).alias("source"), F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size")), "mix-sizes")
    units = materialize(sized.groupBy("k", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mix-units")
    targets = materialize(source_targets(units, weights, most), "mix-targets").withColumnRenamed("source", "s")
    units = units.join(targets, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    units = units.withColumn("base", F.floor(rate)).withColumn("due", (rate - F.col("base")) * F.col("m"))
    units = units.withColumn("whole", F.floor("due")).withColumn("f", F.col("due") - F.col("whole"))
    id_of, of = F.struct("k", "size", "m", "base", "whole"), ("source", "source_size", "target")
    open_ = (F.col("f") > 0) & (F.col("size") > 0)
    large = F.col("size") * F.col("units") > F.col("source_size")
    units = materialize(units.select(*of, id_of.alias("id"), F.col("size").cast("double").alias("w"), F.when(open_, F.col("f") * F.col("size")).alias("x"), large.alias("large")), "mix-open")
    settled = units.where("x is null").select(*of, "id", F.lit(0).alias("hit"))
    id_type = units.schema["id"].dataType.simpleString()

    def last(carried: DataFrame, s: int) -> DataFrame:
        hit = (_chance(s, F.col("unit.id")) * F.col("unit.w") < F.col("unit.x")).cast("int")
        return carried.withColumn("hit", hit)

    # Per source: open units and words that can be moved, of the large and the small.
    sums = materialize(units.where("x is not null").groupBy("source").agg(*(F.count_if(c).alias(f"n_{n}") for n, c in (("large", F.col("large")), ("small", ~F.col("large")))), F.sum(F.when(~F.col("large"), F.col("x"))).alias("low"), F.sum(F.when(~F.col("large"), F.col("w") - F.col("x"))).alias("high")), "mix-sums").withColumnRenamed("source", "s")
    counts = sums.agg(F.max("n_large").alias("large"), F.max("n_small").alias("small")).first()
    ready = units.where("x is not null").join(sums, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    done, carried = _tree(ready.where("large").select(*of, "n_large", F.struct("id", "w", "x").alias("unit")), of, id_type, "n_large", counts["large"] or 0, seed, "large")
    carried = materialize(last(carried, seed - 1), "mix-carried")
    settled = settled.unionByName(done).unionByName(carried.select(*of, F.col("unit.id").alias("id"), "hit"))
    owed = carried.select(F.col("source").alias("s"), (F.col("unit.x") - F.col("hit") * F.col("unit.w")).alias("owed"))  # a row per source
    small = ready.where(~F.col("large")).join(owed, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    owed_ = F.coalesce("owed", F.lit(0.0))
    # Up: by share of the words that are still to be had; down: by share of those expected.
    moved = F.when(owed_ > 0, F.col("x") + (F.col("w") - F.col("x")) * F.least(F.lit(1.0), owed_ / F.col("high"))).when(owed_ < 0, F.col("x") * F.greatest(F.lit(0.0), 1 + owed_ / F.col("low"))).otherwise(F.col("x"))
    small = small.withColumn("x", F.greatest(F.lit(0.0), F.least(F.col("w"), moved)))
    done, carried = _tree(small.select(*of, "n_small", F.struct("id", "w", "x").alias("unit")), of, id_type, "n_small", counts["small"] or 0, seed + 100, "small")
    settled = settled.unionByName(done).unionByName(last(carried, seed - 2).select(*of, F.col("unit.id").alias("id"), "hit"))
    rows = settled.select(*of, "id", (F.col("id.whole") + F.col("hit")).alias("extra"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id.m") - 1)).alias("j"))
    rows = rows.withColumn("copies", F.col("id.base") + (F.col("j") < F.col("extra")).cast("long"))
    return rows.select(F.col("id.k").alias(key), F.col("id.size").alias("size"), "source_size", "target", (F.col("id.size") * F.col("copies")).alias("taken"), "source", "copies")
