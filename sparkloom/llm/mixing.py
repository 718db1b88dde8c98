"""Mixing sources to target weights by a time-varying curriculum. DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, partitions, stage, unit

WORD = r"[^\x20\x09-\x0D]+"
Knots = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Recipe:
    """weights repeat over the sources in their order; cap times its own size is the most a source gives.

    schedules has one curve a weight, repeating alike: knots (time 0 to 1, relative rate), linear in
    between. It says when in training a source's words are asked for; their sum stays the target.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    cap: float = 3.0
    schedules: tuple[Knots, ...] = (((0.0, 1.2), (1.0, 0.8)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
    seed: int = 17


def words(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _curves(recipe: Recipe) -> Column:
    """Of each schedule its knots (at, rate, done): done is the integral of the rate up to there."""
    curves = []
    for knots in recipe.schedules:
        done, rows = 0.0, []
        for k, (at, rate) in enumerate(knots):
            if k:
                done += (at - knots[k - 1][0]) * (rate + knots[k - 1][1]) / 2
            rows.append(F.struct(F.lit(float(at)).alias("at"), F.lit(float(rate)).alias("rate"), F.lit(done).alias("done")))
        curves.append(F.array(*rows))
    return F.array(*curves)


def _when(share: Column, curve: Column) -> Column:
    """The time by which that share of a source's words is asked for: the inverse of the integrated rate."""
    asked = share * F.element_at(curve, -1)["done"]
    before = F.greatest(F.lit(1), F.least(F.size(curve) - 1, F.size(F.filter(curve, lambda k: k["done"] <= asked))))
    a, b = F.element_at(curve, before), F.element_at(curve, before + 1)
    slope, rest = (b["rate"] - a["rate"]) / (b["at"] - a["at"]), asked - a["done"]
    root = F.sqrt(F.greatest(F.lit(0.0), a["rate"] * a["rate"] + 2 * slope * rest))
    return a["at"] + F.coalesce(F.try_divide(2 * rest, a["rate"] + root), F.lit(0.0))


def targets(sizes: DataFrame, recipe: Recipe) -> DataFrame:
    """Per source of sizes (source, source_size): rank, weight and target.

    The cap is reached by all sources whose cap a unit of weight lies under a common level; the
    level is where the rest, at level times weight each, takes what is left. That is the end of
    sharing the excess anew by weight until no source is above. There is one row a source here.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in recipe.weights])
    at = (F.row_number().over(ordered) - 1).cast("int")
    ranked = sizes.withColumn("rank", at).withColumn("weight", F.element_at(cycle, F.col("rank") % len(recipe.weights) + 1))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(recipe.cap)))
    filling = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    so_far, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("most").over(so_far), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level)
    right = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(everything)
    target = F.least(F.col("most"), F.coalesce(right["level"] * F.col("weight"), F.col("most")))
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def mix_plan(df: DataFrame, recipe: Recipe = Recipe(), *, id: str = "doc_id", text: str = "text", source: str = "source", prefix: str = "mix_", broadcast_rows: int = 200_000) -> DataFrame:
    """df with what the mix takes of each row: prefix + size, source_size, target, positions, lengths, taken; columns of these names are replaced.

    A source's rows stand in a hashed order, and its words, one after another, again from the
    start when they run out, meet its demand. So a source gives its target to the word: of the row where the
    target ends, the last copy is taken in part, its first words. lengths holds the words of each copy,
    positions the training time (0 to 1) at which the middle one of them is asked for. A row without words is copied like its neighbours.

    The order is cut into slices by the hash. Slices' totals give each slice its offset, and
    a window runs within a slice, so a source with most of the rows is spread over all tasks.
    Up to broadcast_rows offsets are broadcast, so that rows are shuffled once; more are joined by a shuffle.
    Rows alike in id, source and text may stand for one another; reruns agree.

    A null text has size 0; a null source is a source of its own, last in order; null ids are
    hashed as nulls. An empty table gives an empty table.
    """
    spark = df.sparkSession
    size, order, slice_, end, off, h = fresh(df, "size", "order", "slice", "end", "off", "host")
    keyed = df.withColumns({size: words(text), order: F.xxhash64(F.lit(recipe.seed), F.col(id), F.col(text))})
    keyed = keyed.withColumn(slice_, F.floor(unit(F.col(order)) * (4 * partitions(spark))).cast("int"))

    totals = stage(keyed.groupBy(F.col(source).alias("source"), F.col(slice_).alias("slice")).agg(F.sum(size).alias("size")), "mix-slices")
    sizes = totals.groupBy("source").agg(F.sum("size").alias("source_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    wanted = targets(sizes, recipe).select(F.col("source").alias("of"), "source_size", "rank", "target")
    offsets = offsets.join(wanted, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias(h), F.col("slice").alias(off), F.struct("offset", "source_size", "rank", "target").alias(end)
    )
    if totals.count() <= broadcast_rows:
        offsets = F.broadcast(offsets)
    within = Window.partitionBy(source, slice_).orderBy(order, id, F.xxhash64(text)).rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn(order, F.sum(size).over(within) - F.col(size))
    placed = placed.join(offsets, F.col(source).eqNullSafe(F.col(h)) & (F.col(slice_) == F.col(off)))

    of = F.col(end)
    begin, demand = of["offset"] + F.col(order), F.bround(of["target"]).cast("bigint")
    passes = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(recipe.cap) - 1)), lambda e: demand - e * of["source_size"] - begin)
    given = F.filter(passes, lambda left: left > 0)
    lengths = F.transform(given, lambda left: F.least(left, F.col(size)))
    curve = F.element_at(_curves(recipe), of["rank"] % len(recipe.schedules) + 1)
    middles = F.transform(given, lambda left: F.least(F.lit(1.0), (demand - left + F.least(left, F.col(size)) / 2) / of["target"]))
    out = {
        f"{prefix}size": F.col(size),
        f"{prefix}source_size": of["source_size"],
        f"{prefix}target": of["target"],
        f"{prefix}positions": F.transform(middles, lambda share: _when(share, curve)),
        f"{prefix}lengths": lengths,
        f"{prefix}taken": F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, n: a + n),
    }
    return placed.select(*[F.col(c) for c in df.columns if c not in out], *[v.alias(k) for k, v in out.items()])


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, rf"(?<={WORD[:-1]})(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def mix(df: DataFrame, recipe: Recipe = Recipe(), *, id: str = "doc_id", text: str = "text", source: str = "source", position: str | None = None) -> DataFrame:
    """The mix itself: df's rows as often as they are taken, range-sorted by training time; a copy taken in part has its first words only.

    position names an added column with that time. Rows, nulls and ties are treated as in mix_plan.
    """
    (at,) = fresh(df, "position")
    planned = mix_plan(df, recipe, id=id, text=text, source=source, prefix=f"{at}_")
    copies = planned.select(*df.columns, F.col(f"{at}_size"), F.explode(F.arrays_zip(f"{at}_positions", f"{at}_lengths")).alias(at))
    part = F.when(F.col(at)[f"{at}_lengths"] < F.col(f"{at}_size"), first_words(F.col(text), F.col(at)[f"{at}_lengths"])).otherwise(F.col(text))
    copies = copies.select(*[part.alias(c) if c == text else F.col(c) for c in df.columns], F.col(at)[f"{at}_positions"].alias(position or at))
    ordered = copies.repartitionByRange(position or at).sortWithinPartitions(position or at)
    return ordered if position else ordered.select(*df.columns)
