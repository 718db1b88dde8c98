"""Global row numbers without a window over all rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.hashing import DRAW_BITS, draw

#: Rows a slice is meant to have, slices at most (beyond, slices grow), and keys sampled for each slice's bound.
SLICE_ROWS, MOST_SLICES, SAMPLES = 16384, 4096, 100
_FAN = 64


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, one for each stem."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _below(x: Column, bounds: list[dict], kind: str) -> Column:
    """How many of the sorted bounds are at most x: first among every 64th, then among the 64 after it."""
    parts = [bounds[i : i + _FAN] for i in range(0, len(bounds), _FAN)]
    firsts = F.from_json(F.lit(json.dumps([p[0] for p in parts[1:]])), f"array<{kind}>")
    table = F.from_json(F.lit(json.dumps(parts)), f"array<array<{kind}>>")
    coarse = F.size(F.filter(firsts, lambda b: b <= x))
    return coarse * _FAN + F.size(F.filter(F.get(table, coarse), lambda b: b <= x))


def number(df: DataFrame, order: Column, *, tie: Column | None = None, by: tuple[str, ...] = (), name: str = "rn", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """df with name: the rank (from 1) in the order of a bigint and then tie (a number or string), within by.

    Rows are counted, and cut into slices of about slice_rows by bounds from a sample of (order, tie), whatever values they have; the sample
    sets only where the cuts are. Slices are counted, their counts summed up in a table of a row a slice, and a window
    numbers rows within a slice. Null orders and ties come first. Without a tie, rows of equal order stand in the order of a hash of their numeric columns,
    so that a repeated key is cut, too; rows alike in these and order stay in one slice.
    """
    at, then, key, part, before, own = fresh(df, "at", "tie", "slice", "part", "before", "own")
    if tie is None:
        plain = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
        tie = F.xxhash64(*plain) if plain else F.lit(0)
    keyed = df.withColumns({at: order, then: tie})
    slices = max(1, min(MOST_SLICES, -(-df.count() // slice_rows)))
    if slices == 1:
        within = Window.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), F.col(then).asc_nulls_first())
        return keyed.withColumn(own, F.row_number().over(within)).select(*df.columns, F.col(own).cast("bigint").alias(name))
    kind = f"struct<a:{keyed.schema[at].dataType.simpleString()},t:{keyed.schema[then].dataType.simpleString()}>"
    share = min(1.0, SAMPLES / slice_rows)
    drawn = [(r[0], r[1]) for r in keyed.select(at, then).sample(share, seed=1).collect()]  # about SAMPLES a slice, so bounded
    drawn.sort(key=lambda r: tuple((v is not None, 0 if v is None else v) for v in r))
    bounds = [dict(zip("at", drawn[len(drawn) * i // slices], strict=True)) for i in range(1, slices)] if drawn else []
    x = F.struct(F.col(at).alias("a"), F.col(then).alias("t"))
    return _sliced(keyed, df.columns, at, then, _below(x, bounds, kind) if bounds else F.lit(0), by, name, (key, part, before, own))


def _sliced(keyed: DataFrame, columns: list[str], at: str, then: str, slice_of: Column, by: tuple[str, ...], name: str, names: tuple[str, ...]) -> DataFrame:
    key, part, before, own = names
    keyed = keyed.withColumn(key, slice_of)
    counts = keyed.groupBy(*by, key).agg(F.count(F.lit(1)).alias(own))
    earlier = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"{part}{i}") for i, c in enumerate(by)], F.col(key).alias(part), F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy(*by, key).orderBy(F.col(at).asc_nulls_first(), F.col(then).asc_nulls_first())
    numbered = keyed.withColumn(own, F.row_number().over(within))
    match = F.col(key) == F.col(part)
    for i, c in enumerate(by):
        match &= F.col(c).eqNullSafe(F.col(f"{part}{i}"))
    out = numbered.join(offsets if by else F.broadcast(offsets), match)  # without by, a row a slice
    return out.select(*columns, (F.col(before) + F.col(own)).cast("bigint").alias(name))


def number_by_hash(df: DataFrame, key: Column, *parts: str | int, by: tuple[str, ...] = (), name: str = "rn", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """df with its rank in the pseudo-random order of draw(parts, key), ties by key. Slices are equal ranges of draws, as many as rows call for."""
    slices = 1 << max(0, -(-df.count() // slice_rows) - 1).bit_length()
    at, then, *names = fresh(df, "at", "tie", "slice", "part", "before", "own")
    keyed = df.withColumns({at: draw(*parts, key), then: key})
    return _sliced(keyed, df.columns, at, then, F.floor(F.col(at) / F.lit((1 << DRAW_BITS) // slices)), by, name, tuple(names))


def total(df: DataFrame, name: str = "n") -> DataFrame:
    """One row with the number of rows, to be cross-joined as a scalar."""
    return df.agg(F.count(F.lit(1)).alias(name))


def with_total(df: DataFrame, name: str = "n") -> DataFrame:
    """df with the number of its rows: one row is broadcast."""
    return df.crossJoin(F.broadcast(total(df, name)))
