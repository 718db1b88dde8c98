"""Span corruption on arrays: one row by itself, no shuffle. Draws and spans are made by Arrow functions, many rows at a time (lambdas of Spark take them element by element)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow
from ..functions.hashing import label
from . import spans as rows_of
from .sequence import EOS, PAD

IGNORED = -100


def noise_counts(length: Column, density: float, mean_span: float) -> tuple[Column, Column]:
    """(noise tokens, spans) of a length: rounded halves to even, noise within 1 and length - 1, spans 1 at least."""
    noise = F.greatest(F.least(F.bround(length * F.lit(density)).cast("int"), length - 1), F.lit(1))
    spans = F.greatest(F.bround(noise / F.lit(mean_span)).cast("int"), F.lit(1))
    return noise, spans


def _numbers(array: pa.Array, default: int = 0) -> np.ndarray:
    return pc.fill_null(array, default).to_numpy(zero_copy_only=False).astype(np.int64)


def _labels(array: pa.Array) -> list[bytes]:
    return array.cast(pa.binary()).to_pylist()


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _segmentation(items: pa.Array, pieces: pa.Array, labels: pa.Array) -> pa.Array:
    out, names = [None] * len(items), _labels(labels)
    none = arrow.nulls(items)
    for (n, k), rows in rows_of.alike(_numbers(items), _numbers(pieces, 1)):
        for i, ends in zip(rows.tolist(), rows_of.compositions(n, k, [names[i] for i in rows]).tolist(), strict=True):
            out[i] = None if none[i] else ends
    return pa.array(out, pa.list_(pa.int32()))


def segmentation(items: Column, parts: Column, *key: Column | str | int) -> Column:
    """A drawn composition: the end of each of parts segments of items, each composition as likely as another.

    Of the items - 1 places between items the parts - 1 with the least hashes are cut.
    """
    return _segmentation(items, parts, label(*key))


def possible(length: Column, density: float = 0.15, mean_span: float = 3.0) -> Column:
    """Whether a sequence can be corrupted: two tokens at least, and as many kept ones as spans."""
    noise, spans = noise_counts(length, density, mean_span)
    return (length > 1) & (spans <= length - noise)


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _mask(length: pa.Array, noise: pa.Array, spans: pa.Array, labels: pa.Array) -> pa.Array:
    offsets, mask, none = rows_of.masks(_numbers(length), _numbers(noise), _numbers(spans), _labels(labels))
    none |= arrow.nulls(length)
    if none.any():
        mask = mask[~np.repeat(none, np.diff(offsets))]
        offsets = np.concatenate([[0], np.cumsum(np.where(none, 0, np.diff(offsets)))])
    return arrow.closed(offsets, mask, none)


def noise_mask(length: Column, density: float, mean_span: float, *key: Column | str | int) -> Column:
    """array<boolean>: kept and noise spans take turns, a kept one first. Null where the spans kept are fewer than those of noise."""
    return _mask(length, *noise_counts(length, density, mean_span), label(*key))


def sentinels(tokens: Column, mask: Column, first_id: int, *, descending: bool = False) -> Column:
    """tokens with each run of masked ones replaced by one sentinel: first_id, then up (or down) by one a run. Each token has its place in the mask; null if either is null."""
    step = -1 if descending else 1

    @F.arrow_udf("array<int>")
    def run(tokens: pa.Array, mask: pa.Array) -> pa.Array:
        none = arrow.nulls(tokens) | arrow.nulls(mask)
        if none.any():
            keep = pa.array(~none)
            tokens, mask = pc.if_else(keep, tokens, None), pc.if_else(keep, mask, None)
        (offsets, ids), (places, masked) = arrow.opened(tokens), arrow.opened(mask)
        if not np.array_equal(offsets, places):
            raise ValueError("a mask must be as long as its tokens")
        return arrow.closed(*rows_of.replaced(offsets, _numbers(ids), pc.fill_null(masked, False).to_numpy(zero_copy_only=False), first_id, step), none)

    return run(tokens.cast("array<int>"), mask)


def flip(mask: Column) -> Column:
    return F.transform(mask, lambda m: ~m)


def kept_sentinels(tokens: Column, mask: Column, first_id: int, *, descending: bool = False) -> Column:
    """The same for runs that are not masked: the targets."""
    return sentinels(tokens, flip(mask), first_id, descending=descending)


def append_eos(tokens: Column, eos: int = EOS) -> Column:
    return F.array_append(tokens, F.lit(eos))


def shift_right(labels: Column, start: int = PAD, pad: int = PAD) -> Column:
    """Decoder inputs: start before the labels, without their last; ignored labels are pad."""
    moved = F.concat(F.array(F.lit(start)), F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))))
    return F.when(F.size(labels) == 0, labels).otherwise(F.transform(moved, lambda x: F.when(x == IGNORED, pad).otherwise(x)))


def corrupt(tokens: Column, first_id: int, *key: Column | str | int, density: float = 0.15, mean_span: float = 3.0, eos: int = EOS, descending: bool = False) -> Column:
    """struct(input_ids, labels), both with EOS: spans cut straight from the array, without building the mask.

    Null where the length can't be corrupted (see possible).
    """
    length = F.size(tokens)
    step = -1 if descending else 1

    @F.arrow_udf("struct<input_ids:array<int>,labels:array<int>>")
    def run(tokens: pa.Array, noise: pa.Array, spans: pa.Array, labels: pa.Array) -> pa.Array:
        offsets, ids = arrow.opened(tokens)
        none = arrow.nulls(tokens)
        ids, names = _numbers(ids), _labels(labels)
        places, mask, _ = rows_of.masks(np.diff(offsets), _numbers(noise), _numbers(spans), names)
        if not np.array_equal(offsets, places):
            raise ValueError("a sequence was given that can't be corrupted")
        both = [arrow.closed(*rows_of.ended(*rows_of.replaced(offsets, ids, m, first_id, step), eos)) for m in (mask, ~mask)]
        return pa.StructArray.from_arrays(both, ["input_ids", "labels"], mask=pa.array(none))

    able = possible(length, density, mean_span)
    # What can't be corrupted is passed as one that can, and its result is dropped.
    whole = F.when(able, tokens.cast("array<int>")).otherwise(F.array(F.lit(0), F.lit(0)))
    counts = (F.when(able, c).otherwise(F.lit(1)) for c in noise_counts(length, density, mean_span))
    return F.when(able, run(whole, *counts, label(*key)))


def denoise(
    df: DataFrame, tokens: str, first_id: int, *key: Column | str | int, density: float = 0.15, mean_span: float = 3.0, eos: int = EOS, pad: int = PAD, start: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """df with input_ids, labels and decoder_input_ids in place of tokens; rows that can't be corrupted go.

    key must name the row (and, for fresh noise, the epoch); the noise is a function of it.
    """
    pair = corrupt(F.col(tokens), first_id, *key, density=density, mean_span=mean_span, eos=eos, descending=descending)
    out = df.filter(possible(F.size(tokens), density, mean_span)).withColumn("__pair", pair)
    rest = [c for c in df.columns if c not in (tokens, "input_ids", "labels", "decoder_input_ids")]
    shifted = shift_right(F.col("__pair.labels"), pad if start is None else start, pad)
    return out.select(*rest, "__pair.input_ids", "__pair.labels", shifted.alias("decoder_input_ids"))


def denoise_with(
    df: DataFrame, tokens: str, mask_fn: Callable[[Column], Column], inputs_fn: Callable[[Column, Column], Column], targets_fn: Callable[[Column, Column], Column] | None = None, *,
    eos: int = EOS,
) -> DataFrame:
    """df with input_ids and labels made by functions of columns: mask_fn(length), inputs_fn(tokens, mask), targets_fn(tokens, mask).

    Without targets_fn the labels are the tokens. EOS is appended to both.
    """
    masked = df.withColumn("__mask", mask_fn(F.size(tokens)))
    labels = targets_fn(F.col(tokens), F.col("__mask")) if targets_fn else F.col(tokens)
    rest = [F.col(c) for c in df.columns if c not in (tokens, "input_ids", "labels")]
    return masked.select(*rest, append_eos(inputs_fn(F.col(tokens), F.col("__mask")), eos).alias("input_ids"), append_eos(labels, eos).alias("labels"))


def check_widths(df: DataFrame, input_length: int, target_length: int, *, fail: bool = False) -> DataFrame:
    """df with ok: whether input_ids and labels have these lengths; with fail, a row that has not raises when it is read."""
    ok = (F.size("input_ids") == input_length) & (F.size("labels") == target_length)
    if fail:
        message = F.format_string(f"expected {input_length} inputs and {target_length} labels, got %d and %d", F.size("input_ids"), F.size("labels"))
        return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).isNull()))
    return df.withColumn("ok", ok)


def encode_input(df: DataFrame, tokens: str, key: Column, first_id: int, *, seed: int | str = 42, density: float = 0.15, mean_span: float = 3.0) -> DataFrame:
    """Single texts to batches of one: corrupted with their EOS on, decoder start is pad; adds target_length, by the unclamped formula, and ok.

    ok is false where that formula and the clamped noise disagree: for texts of less than ten tokens or so.
    """
    n = F.size(tokens)
    noise = F.bround(n * F.lit(density)).cast("int")
    spans = F.bround(noise / F.lit(mean_span)).cast("int")
    sized = df.withColumns({"target_length": (noise + spans + 1), "__inputs": n - noise + spans + 1})
    out = denoise(sized, tokens, first_id, seed, "noise", key, density=density, mean_span=mean_span)
    ok = (F.size("input_ids") == F.col("__inputs")) & (F.size("labels") == F.col("target_length"))
    return out.withColumn("ok", ok).drop("__inputs")

