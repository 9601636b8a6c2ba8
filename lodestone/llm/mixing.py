"""Mixing sources to target weights: tokens per source, repetition rates, floor copies and one hash-seeded Bernoulli copy.

Independent draws miss the target of a source with few or very unequal documents by tens of percent. So each source's draws
are made under ``SEEDS`` hash seeds at once, in one aggregation, and the source takes the seed whose words come nearest; one
that is still off by more than ``NEAR`` of its target, as sources of few documents are, gets ``MORE`` times as many seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop, private, read_table, word_count, written

MAX_REPEAT = 3.0
SEED = 20240607
#: Seeds tried for each source.
SEEDS = 32
NEAR = 0.01
MORE = 31
#: A rates table up to this many sources (some 10 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Columns that ``mix`` adds.
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")


def cycle_weights(sources: DataFrame) -> DataFrame:
    """Sources by code point, null last, weigh 1, 2, 3, 1, ... ``sources`` has one row per source.

    Sources are sorted in ranges; a source's place is its place in its range and the number of those in the ranges before, of
    which the driver holds one count for each range.
    """
    spark = sources.sparkSession
    run = F.monotonically_increasing_id()
    placed = written(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("place", run), "mix-places")
    part = F.shiftright("place", 33)
    before, at = [], 0
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        before.append((r["part"], at))
        at += r["n"]
    bases = F.broadcast(spark.createDataFrame(before, "part long, base long"))
    in_range = F.col("place") - F.shiftleft(part, 33)
    out = placed.join(bases, part == F.col("part")).withColumn("weight", ((F.col("base") + in_range) % 3 + 1).cast("double"))
    return out.drop("place", "part", "base")


def targets(sizes: DataFrame, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Add ``target`` and ``rate`` to (source, source_size, weight).

    The whole budget is the sum of all sizes. Filling by weight with caps ``max_repeat * source_size`` has one water level:
    sources whose share would be above their cap stand at it, and the rest share what is left by weight. From the level without
    caps it rises until no further source is above; each step is one aggregation over one row per source.
    """
    cap, w = F.lit(float(max_repeat)) * F.col("source_size"), F.col("weight")
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0]
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else cap < F.lit(level) * w
        r = sizes.agg(F.count_if(over).alias("n"), F.sum(F.when(over, cap).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(w)).alias("w")).first()
        if r["n"] == capped:
            break
        capped = r["n"]
        if not r["w"]:
            level = float("inf")
            break
        level = (total - r["held"]) / r["w"]
    target = cap if level == float("inf") else F.least(cap, F.lit(level) * w)
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(F.lit(0.0))
    return sizes.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _draw(key: Column, seed: Column) -> Column:
    """A number in [0, 1) from the hash of a document's key and a seed."""
    return F.shiftrightunsigned(F.xxhash64(key, seed), 11) * F.lit(2.0**-53)


def _copies(key: Column, rate: Column, seed: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(_draw(key, seed) < rate - whole, 1).otherwise(0)).cast("int")


def _nearest(rows: DataFrame, by: list[str]) -> DataFrame:
    """For each group, ``best``: the least distance of its words from the target under ``SEEDS`` seeds from ``first`` on, and that seed."""
    words = [F.sum(_copies(F.col("key"), F.col("rate"), F.col("first") + k) * F.col("size")).alias(f"w{k}") for k in range(SEEDS)]
    tried = rows.groupBy(*by).agg(*words)
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"w{k}") - F.col("target")).alias("off"), (F.col("first") + k).alias("seed")) for k in range(SEEDS))))
    return tried.select(*by[:-1], best.alias("best"))


def mix(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", max_repeat: float = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """Every input row with ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_rate`` and ``mix_copies`` (0 up to max_repeat).

    ``weights`` is (source, weight); without it sources weigh 1, 2, 3 in turn. A source that it lacks weighs 1.
    copies = floor(rate) plus one with probability rate - floor(rate), drawn from a hash of id and text under the source's
    seed: reruns agree, rows equal in id and text share their draw. A null or empty text has size 0 and its source's rate; a
    null source is a source of its own; if all sizes are 0, so are all targets and copies; an empty table gives no rows.
    Other columns of the input are kept, whatever their names; the five above are replaced.
    """
    base = docs.drop(*ADDED)
    size_at, key_at, plan_at = private([*base.columns, *ADDED], "size", "key", "plan")
    sized = base.withColumns({size_at: word_count(F.col(text_col)), key_at: F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))})
    slim = written(sized.select(F.col(source_col).alias("source"), F.col(size_at).alias("size"), F.col(key_at).alias("key")), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sizes = cycle_weights(sizes)
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").select("source", "source_size", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    sizes = written(sizes, "mix-sources")
    rates = targets(sizes, max_repeat).withColumnRenamed("source", "r_source")

    named = ("r_source", "source_size", "target", "rate")
    per_source = slim.join(broadcast_if_small(rates, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("r_source")))
    quick = tried = written(_nearest(per_source.withColumn("first", F.lit(0)), [*named, "first"]), "mix-tried")
    off = quick.where(F.col("best.off") > NEAR * F.col("target"))
    if not off.isEmpty():
        again = slim.join(broadcast_if_small(off.select(*named), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("r_source")))
        again = again.withColumn("first", F.explode(F.sequence(F.lit(SEEDS), F.lit(MORE * SEEDS), F.lit(SEEDS))))
        tried = tried.unionByName(_nearest(again, [*named, "first"])).groupBy(*named).agg(F.min("best").alias("best"))
    plan = written(tried.select(F.struct(F.col("r_source").alias("source"), "source_size", "target", "rate", F.col("best.seed").alias("seed")).alias(plan_at)), "mix-plan")
    drop(slim, sizes, quick)

    one = F.col(plan_at)
    joined = sized.join(broadcast_if_small(plan, BROADCAST_SOURCES), F.col(source_col).eqNullSafe(one["source"]), "left")
    added = (F.col(size_at), one["source_size"], one["target"], one["rate"], _copies(F.col(key_at), one["rate"], one["seed"]))
    return joined.select(*(F.col(f"`{c}`") for c in base.columns), *(c.alias(name) for c, name in zip(added, ADDED, strict=True)))


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row ``mix_copies`` times, without the columns that ``mix`` added."""
    copy_at = private(mixed.columns, "copy")[0]
    copy = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return mixed.where("mix_copies > 0").withColumn(copy_at, copy).drop(copy_at, *ADDED)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"))
