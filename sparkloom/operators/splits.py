"""Splits, limits, samples and orders of a table with a bigint key. Draws are keyed hashes, so results don't depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import below
from .ordering import number, number_by_hash, with_total


def percent(share: float) -> int:
    """The whole percents of a share, cut off (0.29 gives 28, as floating point has it)."""
    return int(share * 100)


def split_prefix(df: DataFrame, share: float, key: str, *, split: str = "split") -> DataFrame:
    """df with split: the first percent(share) % of rows in key's order are validation, the rest train.

    The boundary is rounded to the nearest row, halves to even. A null key stands first.
    """
    numbered = with_total(number(df, F.col(key), name="__row"), "__all")
    edge = F.bround(F.col("__all") * percent(share) / 100)
    return numbered.select(*df.columns, F.when(F.col("__row") <= edge, "validation").otherwise("train").alias(split))


def split_random(df: DataFrame, share: float, key: str, *, seed: int = 0, split: str = "split") -> DataFrame:
    """df with split: ceil(n share) rows, drawn by a hash of key, are validation. Earlier splits are not looked at."""
    numbered = with_total(number_by_hash(df, F.col(key), seed, "split", name="__row"), "__all")
    return numbered.select(*df.columns, F.when(F.col("__row") <= F.ceil(F.col("__all") * F.lit(share)), "validation").otherwise("train").alias(split))


def subset_size(n: Column, size: float) -> Column:
    """How many rows a limit takes: a whole number or one above 1 is a count (n at most), another a share of n, cut off."""
    if isinstance(size, int) or size > 1:
        return F.least(F.lit(int(size)).cast("bigint"), n)
    return F.floor(n * F.lit(size)).cast("bigint")


def select_subset(df: DataFrame, size: float, key: str, *, seed: int = 0, draw_name: str = "draw_id") -> DataFrame:
    """Rows drawn with replacement: draw i takes row H(seed, i) mod n of key's order. A row may come more than once.

    The draws are a range joined to the row numbers; nothing is collected. An empty table gives none.
    """
    spark = df.sparkSession
    numbered = number(df, F.col(key), name="__row")
    n = df.count()
    k = spark.range(1).select(subset_size(F.lit(n), size)).first()[0]
    draws = spark.range(k).select(F.col("id").alias(draw_name), (below(max(n, 1), seed, "subset", F.col("id")) + 1).alias("__at"))
    return draws.join(numbered, F.col("__at") == F.col("__row")).select(draw_name, *df.columns)


def limit(df: DataFrame, size: float, key: str, *, seed: int = 0) -> DataFrame:
    """select_subset where a limit other than 1 (all) is set; the draws' number becomes the key's order."""
    if size == 1 and not (isinstance(size, int) and not isinstance(size, bool) and size != 1.0):
        return df
    return select_subset(df, size, key, seed=seed)


def take_prefix(df: DataFrame, count: int, key: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """The first count rows in key's order (of each group)."""
    return number(df, F.col(key), by=by, name="__row").filter(F.col("__row") <= count).select(*df.columns)


def shuffle(df: DataFrame, key: str, *, seed: int | str = 0, epoch: int = 0, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """df with its place (from 0) in the order of an epoch: another epoch is another key of the hash, no state."""
    ranked = number_by_hash(df, F.col(key), seed, "shuffle", epoch, by=by, name="__row")
    return ranked.select(*df.columns, (F.col("__row") - 1).alias(name))


def column_batches(df: DataFrame, column: str, key: str, *, size: int = 1024) -> DataFrame:
    """(batch_id, key, column): rows in key's order in batches of size."""
    numbered = number(df.select(key, column), F.col(key), name="__row")
    return numbered.select(F.floor((F.col("__row") - 1) / size).alias("batch_id"), key, column)


def filter_nonempty(df: DataFrame, feature: str) -> DataFrame:
    """Rows whose array isn't empty (a null one counts as empty)."""
    return df.filter(F.size(feature) > 0)


def train_test_counts(n: int, share: float) -> tuple[int, int]:
    """(train, validation) of split_random."""
    test = math.ceil(n * share)
    return n - test, test
