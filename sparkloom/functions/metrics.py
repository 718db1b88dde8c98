"""Learning-rate schedules, losses and metric logs as column functions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps
from typing import Protocol

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = float((2 << 30) - 1)


def _warm_up(step: Column, init: float, rate: float, warmup: int) -> Column:
    """From init to rate over warmup steps."""
    return F.lit(init) + (F.lit(rate) - F.lit(init)) * F.least(F.greatest(step / F.lit(float(max(warmup, 1))), F.lit(0.0)), F.lit(1.0))


def _need(rate: float | None, steps: int | None) -> None:
    if steps is None:
        raise ValueError("train_steps must be set")
    if rate is None:
        raise ValueError("learning_rate must be set")


def polynomial(step: Column, rate: float | None, steps: int | None, *, init: float = 0.0, warmup: int = 0, power: float = 1.0) -> Column:
    """Up to rate over warmup steps, then down to init by a power over the rest."""
    _need(rate, steps)
    span = steps - warmup
    if span <= 0:
        return F.when(step < warmup, _warm_up(step, init, rate, warmup)).otherwise(F.lit(rate))
    done = F.least(F.greatest(step - warmup, F.lit(0)), F.lit(span)) / F.lit(float(span))
    after = (F.lit(rate) - F.lit(init)) * F.pow(1 - done, F.lit(float(power))) + F.lit(init)
    return F.when(step < warmup, _warm_up(step, init, rate, warmup)).otherwise(after)


def linear(step: Column, rate: float | None, steps: int | None, *, init: float = 0.0, warmup: int = 0) -> Column:
    return polynomial(step, rate, steps, init=init, warmup=warmup, power=1.0)


def inverse_sqrt(step: Column, rate: float | None, steps: int | None, *, init: float = 0.0, warmup: int = 0) -> Column:
    """rate while warming up from init, then rate sqrt(warmup / step). Without warm-up it is 0 (and no number at step 0)."""
    _need(rate, steps)
    if warmup == 0:
        return F.when(step == 0, F.lit(math.nan)).otherwise(F.lit(0.0))
    return F.when(step < warmup, _warm_up(step, init, rate, warmup)).otherwise(F.lit(rate) * F.sqrt(F.lit(float(warmup))) / F.sqrt(step.cast("double")))


def constant(step: Column, rate: float | None, steps: int | None = 0, *, init: float = 0.0, warmup: int = 0) -> Column:
    _need(rate, steps)
    return F.when(step < warmup, _warm_up(step, init, rate, warmup)).otherwise(F.lit(rate))


SCHEDULES = {"polynomial": polynomial, "linear": linear, "inverse_sqrt": inverse_sqrt, "constant": constant}


def schedule(kind: str, step: Column, **how) -> Column:
    """A schedule by name."""
    if kind not in SCHEDULES:
        raise ValueError(f"unknown schedule: {kind}")
    return SCHEDULES[kind](step, **how)


def train_steps(batches: Column | int, epochs: int) -> Column:
    return (F.lit(batches) if isinstance(batches, int) else batches) * F.lit(epochs)


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax of the label's logit, by the largest logit taken out."""
    x = logits.cast("array<double>")
    top = F.array_max(x)
    return top + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)) - F.get(x, label.cast("int"))


def perplexity(loss: Column) -> Column:
    """exp of the loss, 2^31 - 1 at most."""
    return F.when(loss > math.log(MOST), F.lit(MOST)).otherwise(F.exp(F.least(loss, F.lit(50.0))))


def argmax(logits: Column) -> Column:
    """The place (from 0) of the largest, the first of equals."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def accuracy(logits: Column, label: Column) -> Column:
    """Share of rows whose largest logit is the label's: an aggregate."""
    return F.avg((argmax(logits) == label).cast("double"))


def device_mean(df: DataFrame, device: str, value: str, name: str = "value") -> DataFrame:
    """The mean over devices of each device's mean."""
    return df.groupBy(device).agg(F.avg(value).alias("__v")).agg(F.avg("__v").alias(name))


def mean_metrics(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Each metric's mean over batches."""
    return df.groupBy(name).agg(F.avg(value).alias(value))


def back_fill(df: DataFrame, step: str, metrics: str) -> DataFrame:
    """(step, metric): k metrics gathered at step s are those of steps s - k + 1 to s."""
    rows = df.select(F.col(step).alias("__s"), F.size(metrics).alias("__k"), F.posexplode(metrics).alias("__p", "metric"))
    return rows.select((F.col("__s") - F.col("__k") + F.col("__p") + 1).alias("step"), "metric")


def prefixed(name: Column, prefix: str | None) -> Column:
    return F.concat_ws("_", F.lit(prefix), name) if prefix else name


def due(step: Column, every: int) -> Column:
    """Whether a step is one of every so many."""
    return F.pmod(step, F.lit(every)) == 0


def decayed(path: Column) -> Column:
    """Whether a parameter (path with /) is under weight decay: not biases, nor scales of layer norms."""
    parts = F.split(path, "/")
    last, before = F.get(parts, F.size(parts) - 1), F.get(parts, F.size(parts) - 2)
    return ~((last == "bias") | F.coalesce((last == "scale") & before.isin("layer_norm", "final_layer_norm"), F.lit(False)))


def append_metrics(df: DataFrame, path: str) -> None:
    """Adds long rows (step, name, value) to the log at path."""
    df.select(F.col("step").cast("bigint"), F.col("name").cast("string"), F.col("value").cast("double")).write.mode("append").parquet(path)


class Logger(Protocol):
    """Where metric rows (step, name, value) go."""

    def log(self, df: DataFrame) -> None: ...


@dataclass(frozen=True)
class TableLogger:
    """Adds rows to the log at path."""

    path: str

    def log(self, df: DataFrame) -> None:
        append_metrics(df, self.path)


class PrintLogger:
    """Prints rows one by one, for a look at a few."""

    def log(self, df: DataFrame) -> None:
        for row in df.select("step", "name", "value").toLocalIterator():
            print(f"{row['step']} {row['name']} {row['value']}")


def driver_only(action: Callable) -> Callable:
    """action on the driver; within a task it does nothing and gives None."""

    @wraps(action)
    def run(*args, **kwargs):
        return action(*args, **kwargs) if TaskContext.get() is None else None

    return run
