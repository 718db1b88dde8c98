"""Randomness as a function of keys: the same rows get the same draws however they are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60


def label(*parts: Column | str | int) -> Column:
    """The string that a draw is the hash of."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def draw(*parts: Column | str | int) -> Column:
    """A uniform integer in [0, 2^60) of the parts: strings and integers are literals, columns are keys."""
    return F.conv(F.substring(F.md5(label(*parts)), 1, 15), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1)."""
    return draw(*parts) / F.lit(float(1 << DRAW_BITS))


def below(n: Column | int, *parts: Column | str | int) -> Column:
    """A uniform integer in [0, n)."""
    return draw(*parts) % (n if isinstance(n, Column) else F.lit(n))
