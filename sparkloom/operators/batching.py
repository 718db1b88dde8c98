"""Batches, workers, devices, and several tasks in turn. Places are numbers on rows; batches are groups of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import number
from .splits import shuffle


def batch_count(n: Column | int, size: int, *, drop_last: bool = False) -> Column:
    """Batches of n rows: the short last one counts unless dropped."""
    n = F.lit(n) if isinstance(n, int) else n
    return (F.floor(n / size) if drop_last else F.ceil(n / size)).cast("bigint")


def batches(df: DataFrame, place: str, size: int, *, drop_last: bool = False) -> DataFrame:
    """df, with place (from 0) known, with batch_id and pos; with drop_last less the short last batch."""
    out = df.withColumns({"batch_id": F.floor(F.col(place) / size), "pos": (F.col(place) % size).cast("int")})
    if not drop_last:
        return out
    n = df.agg(F.floor(F.count(F.lit(1)) / size).alias("__full"))
    return out.crossJoin(F.broadcast(n)).filter(F.col("batch_id") < F.col("__full")).drop("__full")


def worker_of(n: Column | int, batch: Column, workers: int, size: int) -> Column:
    """The worker of a batch: each takes ceil(n / (workers size)) batches in a row."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(batch / F.greatest(F.ceil(n / (workers * size)), F.lit(1))).cast("int")


def device_of(pos: Column, size: int, devices: int) -> Column:
    """The device of a place in a batch of size, devices getting equal shares in a row."""
    if size % devices:
        raise ValueError(f"a batch of {size} can't be shared by {devices} devices")
    return F.floor(pos / (size // devices)).cast("int")


def iterate(
    df: DataFrame, key: str, size: int, *, workers: int = 1, devices: int = 1, shuffled: bool = False, drop_last: bool = False, seed: int | str = 0, epoch: int = 0
) -> DataFrame:
    """df with batch_id, pos, worker_id and device_id for an epoch; size is a device's, a batch is devices times that."""
    whole = size * devices
    placed = shuffle(df, key, seed=seed, epoch=epoch, name="__place") if shuffled else number(df, F.col(key), name="__place").withColumn("__place", F.col("__place") - 1)
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    out = batches(placed, "__place", whole, drop_last=drop_last).crossJoin(F.broadcast(n))
    out = out.withColumns({"worker_id": worker_of(F.col("__n"), F.col("batch_id"), workers, whole), "device_id": device_of(F.col("pos"), whole, devices)})
    return out.drop("__place", "__n")


def collate(df: DataFrame, *features: str) -> DataFrame:
    """One row a batch: each feature's rows in order of pos. A batch's size bounds the group."""
    rows = F.array_sort(F.collect_list(F.struct("pos", *features)))
    grouped = df.groupBy("batch_id").agg(rows.alias("__rows"))
    return grouped.select("batch_id", *[F.col(f"__rows.{f}").alias(f) for f in features])


def task_proportions(df: DataFrame, task: str) -> DataFrame:
    """(task, proportion): the same for each task, whatever its size."""
    tasks = df.select(task).distinct()
    return tasks.select(task, (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy())).alias("proportion"))


def task_counts(df: DataFrame, task: str, *, limit: int | None = None) -> DataFrame:
    """(task, size, declared, actual): rows; rows asked for under a limit over all tasks, by proportion; and those there are of them."""
    sizes = df.groupBy(task).agg(F.count(F.lit(1)).alias("size"))
    if limit is None:
        return sizes.select(task, "size", F.col("size").alias("declared"), F.col("size").alias("actual"))
    everything = Window.partitionBy()
    share = F.lit(1.0) / F.count(F.lit(1)).over(everything)
    declared = sizes.withColumn("__p", share).withColumn("declared", F.floor(F.col("__p") * limit / F.sum("__p").over(everything)))
    return declared.select(task, "size", "declared", F.least("size", "declared").alias("actual"))


def round_robin(df: DataFrame, task: str, key: str, *, order: Column | None = None) -> DataFrame:
    """df with place (from 0): first rows of each task in turn, then second ones; tasks that are through are passed over.

    The place is counted from the sizes: of row k of a task, as many rows stand before as min(k - 1 or k, size) over the other tasks. Tasks
    are few (one row each is broadcast); rows are numbered within slices of a task.
    """
    ranked = number(df, order if order is not None else F.col(key), tie=F.col(key), by=(task,), name="__k")
    sizes = df.groupBy(task).agg(F.count(F.lit(1)).alias("n"))
    table = sizes.agg(F.array_sort(F.collect_list(F.struct(F.col(task).alias("t"), "n"))).alias("__sizes"))
    joined = ranked.crossJoin(F.broadcast(table))
    before = F.aggregate(
        "__sizes", F.lit(0).cast("bigint"),
        lambda acc, s: acc + F.least(s["n"], F.when(s["t"] < F.col(task), F.col("__k")).otherwise(F.col("__k") - 1)),
    )
    return joined.select(*df.columns, before.alias("place"))


def multitask(
    df: DataFrame, task: str, key: str, size: int, *, workers: int = 1, devices: int = 1, shuffled: bool = False, drop_last: bool = True, seed: int | str = 0, epoch: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """df with place, batch_id, pos, worker_id, device_id: each task's rows (shuffled, cut to its count), in turn, in batches."""
    placed = shuffle(df, key, seed=seed, epoch=epoch, by=(task,), name="__rank") if shuffled else number(df, F.col(key), by=(task,), name="__rank")
    if limit is not None:
        counts = task_counts(df, task, limit=limit).select(F.col(task).alias("__task"), "actual")
        first = F.col("__rank") - (0 if shuffled else 1)
        placed = placed.join(F.broadcast(counts), F.col(task).eqNullSafe(F.col("__task"))).filter(first < F.col("actual")).drop("__task", "actual")
    whole = size * devices
    turned = round_robin(placed, task, key, order=F.col("__rank"))
    n = placed.agg(F.count(F.lit(1)).alias("__n"))
    out = batches(turned, "place", whole, drop_last=drop_last).crossJoin(F.broadcast(n))
    out = out.withColumns({"worker_id": worker_of(F.col("__n"), F.col("batch_id"), workers, whole), "device_id": device_of(F.col("pos"), whole, devices)})
    return out.drop("__rank", "__n")


def stack_mappings(df: DataFrame, row: str, name: str, value: str, *, batch: str | None = None) -> DataFrame:
    """(batch, name, values): for each name of long rows (batch, row, name, value) its value in each row of its batch, in order, null where a row lacks it.

    An array is as long as its batch has rows, so a batch's size bounds it; without batch all rows are one, without that column. Repeated (row, name) keep one value;
    null rows and names are values like others.
    """
    of = [F.col(batch) if batch else F.lit(0)]
    held = df.select(of[0].alias("__batch"), F.struct(F.col(row)).alias("__row"), F.struct(F.col(name)).alias("__name"), F.col(value).alias("__value"))
    held = held.groupBy("__batch", "__row", "__name").agg(F.min("__value").alias("__value"))
    rows, names = held.select("__batch", "__row").distinct(), held.select("__batch", "__name").distinct()
    grid = rows.join(names, rows["__batch"].eqNullSafe(names["__batch"])).select(rows["__batch"].alias("__b"), F.col("__row").alias("__r"), F.col("__name").alias("__n"))
    full = grid.join(held, grid["__b"].eqNullSafe(held["__batch"]) & (grid["__r"] == held["__row"]) & (grid["__n"] == held["__name"]), "left")
    stacked = full.groupBy("__b", "__n").agg(F.array_sort(F.collect_list(F.struct("__r", "__value"))).alias("__values"))
    return stacked.select(*([F.col("__b").alias(batch)] if batch else []), F.col("__n")[name].alias(name), F.transform("__values", lambda v: v["__value"]).alias("values"))


def zip_longest(df: DataFrame, *columns: str, rest: tuple[str, ...] = ()) -> DataFrame:
    """One row a position of the arrays (pos from 0, columns), null where an array has ended or holds a null."""
    zipped = df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("pos", "__row"))
    return zipped.select(*rest, "pos", *[F.col(f"__row.{c}").alias(c) for c in columns])


def without_nulls(*columns: str) -> Column:
    """A row as JSON with its null columns left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def dataloader(df: DataFrame, *features: str, num_workers: int | None = None) -> Iterator[dict]:
    """Batches as dictionaries, in order, one partition at a time on the driver's side."""
    ordered = collate(df, *features).repartitionByRange(max(1, num_workers or 1), "batch_id").sortWithinPartitions("batch_id")
    for row in ordered.toLocalIterator():
        yield {f: row[f] for f in features}


def dataset(frames: list[DataFrame], key: str, size: int, **how) -> DataFrame:
    """One frame is iterated by itself, several as tasks dataset_0, dataset_1, ..."""
    if len(frames) == 1:
        return iterate(frames[0], key, size, **how)
    named = [f.withColumn("task", F.lit(f"dataset_{i}")) for i, f in enumerate(frames)]
    whole = named[0]
    for f in named[1:]:
        whole = whole.unionByName(f)
    return multitask(whole, "task", key, size, **how)
