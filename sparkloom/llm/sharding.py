"""Sharding by balanced label propagation: linked rows move together, under quotas."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, stage, unit


def propagate(nodes: DataFrame, edges: DataFrame, shards: int, *, rounds: int = 4, slack: float = 0.02, seed: int = 7) -> DataFrame:
    """Labels (id, shard) of nodes (id, shard at first) after rounds of moves towards neighbours' shards.

    edges has src and dst, both ways. In a round each node wants the shard that most of its
    neighbours are in, if that is more than in its own. In even rounds a node hears neighbours of lesser id only, in odd
    rounds half of the nodes, by a hash, hear all; so two neighbours can't swap for ever. From shard a to b as many may move as want from b to a, and beyond that
    b's room below (1 + slack) times the mean is shared by those who want in; a hash picks them. Votes are counted on each task before
    the shuffle; a hub's label goes to its neighbours by a join that Spark may split.
    """
    labels = stage(nodes, "shard-labels")
    n = labels.count()
    most = -(-n // shards) * (1 + slack)
    for k in range(rounds):
        heard = edges.filter("src < dst") if k % 2 == 0 else edges.filter(F.xxhash64(F.lit(seed + k), F.col("dst")) % 2 == 0)
        linked = labels.select(F.col("id").alias("src"), F.col("shard").alias("theirs"))
        votes = heard.join(linked, "src").groupBy("dst", "theirs").agg(F.count(F.lit(1)).alias("n"))
        own = labels.select(F.col("id").alias("dst"), "shard")
        per_node = votes.join(own, "dst").groupBy("dst", "shard").agg(
            F.max(F.struct("n", (-F.col("theirs")).alias("low"))).alias("best"), F.max(F.when(F.col("theirs") == F.col("shard"), F.col("n")).otherwise(0)).alias("here")
        )
        wants = per_node.filter(F.col("best")["n"] > F.col("here")).select(F.col("dst").alias("id"), "shard", (-F.col("best")["low"]).cast("int").alias("to"))
        wants = stage(wants, "shard-wants")
        flows = wants.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("there"))
        back = flows.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("there").alias("back"))
        flows = flows.join(back, ["shard", "to"], "left").withColumn("back", F.coalesce("back", F.lit(0)))
        flows = flows.withColumn("over", F.greatest(F.col("there") - F.col("back"), F.lit(0)))
        load = labels.groupBy("shard").agg(F.count(F.lit(1)).alias("load")).withColumnRenamed("shard", "to")
        room = flows.groupBy("to").agg(F.sum("over").alias("over_all")).join(load, "to", "left")
        room = room.select("to", (F.greatest(F.lit(most) - F.coalesce("load", F.lit(0)), F.lit(0.0)) / F.greatest("over_all", F.lit(1))).alias("room"))
        share = (F.col("back") + F.col("over") * F.least(F.col("room"), F.lit(1.0))) / F.col("there")
        shares = flows.join(room, "to").select("shard", "to", share.alias("share"))
        moves = wants.join(shares, ["shard", "to"]).filter(unit(F.xxhash64(F.lit(seed + k), "id")) < F.col("share")).select("id", "to")
        labels = stage(labels.join(moves, "id", "left").select("id", F.coalesce("to", "shard").alias("shard")), "shard-labels")
    return labels


def cut(rows: DataFrame, shards: int, *, law: str) -> DataFrame:
    """rows (shard, tie, id, size, ...) dealt anew in the order shard, tie, id so that law holds; adds slot.

    Under rows, counts are at most one apart; under bytes, a shard is a run of near total / shards
    bytes. Rows that moved together stay neighbours, so a cut parts one group at most. Totals of
    slices of the order give offsets, and windows run within a slice.
    """
    slices = max(1, (4 * partitions(rows.sparkSession)) // shards)
    weight = F.lit(1).cast("bigint") if law == "rows" else F.col("size")
    sliced = rows.withColumn("slice", F.floor(unit(F.col("tie")) * slices).cast("int"))
    sums = sliced.groupBy("shard", "slice").agg(F.sum(weight).alias("sum"))
    ordered = Window.orderBy("shard", "slice").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = sums.select("shard", "slice", F.coalesce(F.sum("sum").over(ordered), F.lit(0)).alias("offset"), F.sum("sum").over(everything).alias("total"))
    within = Window.partitionBy("shard", "slice").orderBy("tie", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.withColumn("at", F.sum(weight).over(within) - weight).join(offsets, ["shard", "slice"])
    at, total, n = F.col("offset") + F.col("at"), F.col("total"), F.lit(shards).cast("bigint")
    if law == "rows":
        least = F.expr(f"total div {shards}")
        longer = total % n * (least + 1)
        late = F.when(least > 0, F.floor((at - longer) / F.greatest(least, F.lit(1)))).otherwise(0)
        placed = placed.withColumn("shard", F.when(at < longer, F.floor(at / (least + 1))).otherwise(total % n + late).cast("int"))
        first = F.when(F.col("shard") < total % n, F.col("shard") * (least + 1)).otherwise(F.col("shard") * least + total % n)
        return placed.withColumn("slot", (at - first).cast("bigint")).drop("slice", "at", "offset", "total")
    placed = placed.withColumn("shard", F.least(n - 1, F.floor(at * n / F.greatest(total, F.lit(1)))).cast("int"))
    numbered = Window.partitionBy("shard").orderBy("at_all")
    return placed.withColumn("at_all", at).withColumn("slot", F.row_number().over(numbered).cast("bigint") - 1).drop("slice", "at", "offset", "total", "at_all")


def shard_documents(df: DataFrame, shards: int = 40, *, law: str = "rows", id: str = "doc_id", text: str = "text", rounds: int = 5) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot; rows of equal text are linked and kept together.

    size is the text's bytes plus 16. Groups larger than a shard are laid over the first shards one after the other, each over as few
    as its rows fill (two more where the cut or a neighbour shifts it); they don't move, and the rest starts in the room they leave. A null text has size 16, crc32 of no bytes, and is linked to nothing; an empty text is a text
    like others. Null and repeated ids are rows of their own. Shards follow from the rows alone, however they are partitioned. The rows that travel hold
    numbers only, never the text.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law: {law}")
    whole = F.coalesce(F.col(text), F.lit(""))
    light = df.select(
        F.col(id).alias("doc_id"), (F.octet_length(whole) + 16).cast("bigint").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
        F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("group"),
    )
    # A row's number is a hash of what it is, and of which of its like, so that nothing depends on how rows are dealt.
    which = F.row_number().over(Window.partitionBy("doc_id", "group", "size").orderBy("text_crc32"))
    light = stage(light.withColumn("id", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.hex("group"), F.lit("null")), which)))), "shard-rows")
    total = light.count()
    hubs = light.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hubs = stage(hubs, "shard-hubs")
    over = hubs.filter(F.col("n") * shards > total).orderBy(F.col("n").desc(), "group").select("group", "n").collect()  # fewer than shards
    ahead = [0, *itertools.accumulate(r["n"] for r in over)]
    large = df.sparkSession.createDataFrame([(r["group"], r["n"], at) for r, at in zip(over, ahead, strict=False)], "group bigint, large bigint, ahead bigint")
    light = light.join(F.broadcast(large), "group", "left")
    linked = light.filter(F.col("large").isNull()).join(hubs, "group")
    spokes = linked.filter("id <> hub").select(F.col("id").alias("src"), F.col("hub").alias("dst"))
    edges = stage(spokes.union(spokes.select("dst", "src")), "shard-edges")
    at = F.coalesce("ahead", F.lit(ahead[-1])) + unit(F.xxhash64("id")) * F.coalesce("large", F.lit(total - ahead[-1]))
    start = light.select("id", F.least(F.floor(at * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard"))
    labels = propagate(start, edges, shards, rounds=rounds, slack=0.25)  # the cut evens out what is over
    tie = F.when(F.col("large").isNull() & F.col("group").isNotNull(), F.xxhash64("group")).otherwise(F.xxhash64("id"))  # a large group fills its shards anyway
    rows = light.withColumn("tie", tie).drop("large", "ahead").join(labels, "id")
    placed = cut(rows, shards, law=law)
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot")
