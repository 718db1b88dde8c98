"""Operators that look at one row at a time work on streams as they are; those that need an order don't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import noise

#: Column to column, safe on a stream.
ROW_FUNCTIONS: dict[str, Callable] = {
    "normalize": text.normalize,
    "pre_tokens": text.pre_tokens,
    "strip_html": text.strip_html_native,
    "clean_comment": text.clean_comment,
    "shift_right": noise.shift_right,
}


def apply(stream: DataFrame, function: str, column: str, name: str | None = None) -> DataFrame:
    """A stream with a row function's column."""
    if function not in ROW_FUNCTIONS:
        raise ValueError(f"not a row function: {function}")
    return stream.withColumn(name or column, ROW_FUNCTIONS[function](F.col(column)))


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what there is of a stream to Parquet, once, and waits."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
