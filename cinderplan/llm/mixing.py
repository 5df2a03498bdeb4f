"""Mixing sources to target weights: tokens per source give repetition rates, documents are emitted by rate.

Sources weigh 1, 2, 3, repeating, in code-point order (null last) and share all tokens; a source's target stops at
``MOST`` times its size and the excess is reshared by weight until none is above. Documents are emitted floor(rate)
times plus once more with probability rate - floor(rate). The Bernoulli draw is a hash of the document and a seed; of
``SEEDS`` candidate seeds each source takes the one whose draws come nearest to its target, so that small sources meet
theirs too. Built-in expressions only; documents are aggregated by source (partial sums first), never shuffled whole.

Defined results: null text has size 0; null source is a source of its own; repeated rows (same doc_id) get the same
draw; an empty table gives an empty one; sources without any word have target 0 and are emitted once (rate 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderplan.llm.common import n_words, small, stored

MOST = 3
WEIGHTS = (1, 2, 3)
SEEDS = 32


def draw(doc_id: Column, seed: Column) -> Column:
    """Uniform in [0, 1) from md5 of seed|doc_id; any engine with md5 gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, size) rows: source, source_size, weight, target, rate. One row per source.

    Water filling: with sources ordered by MOST * size / weight, the first k are capped, where k is the least with
    level (T - capped) / (weights left) not above the next source's ratio.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, not per document
    pick = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    w = by.select("source", "source_size", pick.cast("long").alias("weight"))
    ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.select(
        "*",
        F.sum("source_size").over(everything).alias("_all"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_left"),
        (MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("_capped"),
    )
    level = (F.col("_all") - F.col("_capped")).cast("double") / F.col("_left")
    # the first level, in the order of ratios, that its source and so all later ones can bear
    w = w.withColumn("_level", F.when(F.col("weight") * level <= MOST * F.col("source_size"), F.struct(F.row_number().over(ratio).alias("k"), level.alias("level"))))
    level = F.min("_level").over(everything)["level"]
    target = F.least((MOST * F.col("source_size")).cast("double"), F.coalesce(F.col("weight") * level, (MOST * F.col("source_size")).cast("double")))
    w = w.select("source", "source_size", "weight", target.alias("target"))
    return w.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(F.lit(1.0)))


def copies(doc_id: Column, rate: Column, seed: Column) -> Column:
    return (F.floor(rate) + (draw(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def plan(sized: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """source_targets with the seed of each source, from stored (doc_id, source, size)."""
    rates = stored(source_targets(sized), "rates")
    d = sized.join(small(rates.select(F.col("source").alias("_s"), "rate")), F.col("source").eqNullSafe(F.col("_s")))
    extra = [F.sum(F.when(draw(F.col("doc_id"), F.lit(m)) < F.col("rate") - F.floor("rate"), F.col("size")).otherwise(0)).alias(f"_{m}") for m in range(seeds)]
    got = d.groupBy("source").agg(*extra)
    tried = got.select(F.col("source").alias("_s"), F.explode(F.array(*(F.struct(F.lit(m).alias("seed"), F.col(f"_{m}").alias("extra")) for m in range(seeds)))).alias("x")).select("_s", "x.seed", "x.extra")
    off = F.abs(F.floor("rate") * F.col("source_size") + F.col("extra") - F.col("target"))
    each = rates.join(tried, F.col("source").eqNullSafe(F.col("_s")))
    best = each.groupBy("source", "source_size", "target", "rate").agg(F.min(F.struct(off.alias("off"), F.col("seed").alias("seed")))["seed"].alias("seed"))
    return stored(best, "mix")


def planned(docs: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, rate, copies."""
    sized = stored(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")), "sized")
    p = plan(sized, seeds)
    d = sized.join(small(p.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return d.withColumn("copies", copies(F.col("doc_id"), F.col("rate"), F.col("seed")))


def mixed(docs: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """The mix itself: every row of docs as often as its copies say, with its own columns."""
    sized = stored(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")), "sized")
    p = plan(sized, seeds).select(F.col("source").alias("_s"), F.col("rate").alias("_rate"), F.col("seed").alias("_seed"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("_source"))  # whatever its columns are called
    d = rows.join(small(p), F.col("_source").eqNullSafe(F.col("_s")))
    n = copies(F.col("_id"), F.col("_rate"), F.col("_seed")).cast("int")
    return d.withColumn("_n", n).where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
