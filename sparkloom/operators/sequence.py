"""Token sequences: chunks, segments, padding, lengths. All on arrays; only the tokenizer is an Arrow function."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow
from ..functions.hashing import below, draw, uniform
from .ordering import number

PAD, EOS, UNK = 0, 1, 2
MAX_CHUNK = 65536
BATCH_ROWS = 128
KEPT = 100_000  # words whose ids a task keeps


def word_ids(text: Column, *, size: int = 32000) -> Column:
    """A vocabulary-free tokenizer: blank-separated words to ids from 3 on by a hash, with EOS at the end (also of an empty text).

    A part's different words are hashed once, and a task keeps the ids of words it has seen.
    """

    def make(word: bytes) -> int:
        return int(md5(b"word:" + word, usedforsecurity=False).hexdigest()[:15], 16) % (size - 3) + 3 if word else -1

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = arrow.kept(make, KEPT)
        for batch in batches:
            for part in arrow.parts(batch):
                offsets, words = arrow.opened(pc.split_pattern(pc.fill_null(part, ""), " "))
                indices, table = arrow.by_value(words, find)
                table = np.array(table, np.int32)
                yield arrow.closed(*arrow.spread(offsets, indices, (table > 0).astype(np.int64), table[table > 0], [EOS]))

    return run(text)


def random_chunk(tokens: Column, longest: int | None, key: Column, *, seed: int | str = 0, uniform_start: bool = False) -> Column:
    """At most longest tokens from a drawn start.

    By default the start is drawn from the numbers of chunks, 0 to ceil(n / longest) - 1, and taken as an offset in tokens, not in
    chunks; so a text of at most longest tokens stays whole. With uniform_start it is drawn from 1 - longest to n - 1
    and what lies before 0 is cut off, so the chunk may be shorter. An empty array stays empty.
    """
    if longest is None:
        raise ValueError("the longest chunk must be set")
    n = F.size(tokens)
    if uniform_start:
        start = below(n + longest - 1, seed, "chunk", key) + (1 - longest)
        end = F.least(start + longest, n.cast("bigint"))
        start = F.greatest(start, F.lit(0).cast("bigint"))
        return F.when(n == 0, tokens).otherwise(F.slice(tokens, (start + 1).cast("int"), (end - start).cast("int")))
    chunks = F.ceil(n / longest)
    start = draw(seed, "chunk", key) % F.greatest(chunks, F.lit(1))
    return F.slice(tokens, (start + 1).cast("int"), F.lit(longest))


def drop_last(tokens: Column) -> Column:
    """Without the last token."""
    return F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))


def pad_to(tokens: Column, width: Column, pad: int = PAD, *, first: bool = False) -> Column:
    """The tokens without their last one, filled up to width behind or, with first, before."""
    kept = drop_last(tokens)
    fill = F.array_repeat(F.lit(pad), F.greatest((width - F.size(kept)).cast("int"), F.lit(0)))
    return F.concat(fill, kept) if first else F.concat(kept, fill)


def pad_batch(df: DataFrame, tokens: str, batch: str, *, pad: int = PAD, first: bool = False, name: str = "padded") -> DataFrame:
    """df with each row's tokens less the last, padded to the longest of its batch (before the last was dropped)."""
    widths = df.groupBy(F.col(batch).alias("__of")).agg(F.max(F.size(tokens)).alias("__width"))
    joined = df.join(widths, F.col(batch).eqNullSafe(F.col("__of")))
    return joined.select(*df.columns, pad_to(F.col(tokens), F.col("__width"), pad, first=first).alias(name))


def segment_length(longest: int, shortest: int | None, batch: Column, *, seed: int | str = 0, corrected: bool = False) -> Column:
    """The length a batch is cut to: longest, or with shortest one drawn between their logarithms.

    The draw is taken as it is, cut off to a whole number; corrected takes its exponential, as the name of the scheme would have it.
    """
    if shortest is None:
        return F.lit(longest)
    low, high = math.log(shortest), math.log(longest)
    drawn = F.lit(low) + uniform(seed, "length", batch) * F.lit(high - low)
    return F.floor(F.exp(drawn) if corrected else drawn).cast("int")


def split_tokens(
    df: DataFrame, tokens: str, key: str, longest: int, *, shortest: int | None = None, batch_rows: int = BATCH_ROWS, pad: int = PAD, drop_last_segment: bool = True,
    seed: int | str = 0, corrected: bool = False,
) -> DataFrame:
    """(batch_id, seg_id, input_ids): batch_rows rows at a time, in key's order, end to end, cut into segments of one length.

    Each row loses its last token (its EOS), tokens equal to pad go, and with drop_last_segment so do segments shorter than longest: the tail of
    every batch. A batch has batch_rows rows at most, so its group is bounded. A batch without tokens gives no segment; null arrays are empty.
    """
    numbered = number(df.select(key, tokens), F.col(key), name="__row")
    bare = drop_last(F.coalesce(F.col(tokens), F.array().cast("array<int>")))
    bare = F.filter(bare, lambda t: t != pad) if df.schema[tokens].dataType.containsNull else F.array_remove(bare, pad)
    rows = numbered.select(F.floor((F.col("__row") - 1) / batch_rows).alias("batch_id"), "__row", bare.alias("__ids"))
    # A set number of partitions: what follows is heavy for its bytes, by which adaptive execution would merge them.
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch_id")
    joined = rows.groupBy("batch_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__row", "__ids"))), lambda r: r["__ids"])).alias("__ids"))
    cut = joined.withColumn("__len", F.greatest(segment_length(longest, shortest, F.col("batch_id"), seed=seed, corrected=corrected), F.lit(1)))
    segments = cut.filter(F.size("__ids") > 0).select("batch_id", "__ids", "__len", F.explode(F.sequence(F.lit(0), F.floor((F.size("__ids") - 1) / F.col("__len")).cast("int"))).alias("__seg"))
    out = segments.select("batch_id", F.col("__seg").cast("bigint").alias("seg_id"), F.slice("__ids", F.col("__seg") * F.col("__len") + 1, F.col("__len")).alias("input_ids"))
    return out.filter(F.size("input_ids") == longest) if drop_last_segment else out


def prepare(df: DataFrame, tokens: str, key: str, input_length: int, *, seed: int | str = 0, batch_rows: int = BATCH_ROWS, filled: bool = False) -> DataFrame:
    """Tokenised rows to training segments: a random chunk of each row, then split_tokens. Only (batch_id, seg_id, input_ids) remain.

    filled says that every row has tokens, as word_ids gives: then rows are numbered by their keys alone, and each is tokenised once.
    """
    chunked = df.select(F.col(key), random_chunk(F.col(tokens), MAX_CHUNK, F.col(key), seed=seed).alias("__chunk"))
    if not filled:
        chunked = filter_empty(chunked, "__chunk")
    return split_tokens(chunked, "__chunk", key, input_length, batch_rows=batch_rows, seed=seed)


def filter_empty(df: DataFrame, tokens: str) -> DataFrame:
    """Rows with tokens."""
    return df.filter(F.size(tokens) > 0)


@dataclass(frozen=True)
class Lengths:
    """Of raw tokens, and of what becomes of them: noise tokens, spans, inputs and targets."""

    tokens: int
    inputs: int
    targets: int


def corrupted_lengths(tokens: int, density: float, mean_span: float, *, extra_inputs: int = 1, extra_targets: int = 1) -> Lengths:
    """Lengths of the inputs and targets that tokens raw ones give: noise and spans are rounded halves to even."""
    noise = round(tokens * density)
    spans = round(noise / mean_span)
    return Lengths(tokens, tokens - noise + spans + extra_inputs, noise + spans + extra_targets)


def solve_lengths(input_length: int, density: float = 0.15, mean_span: float = 3.0, *, extra_inputs: int = 1, extra_targets: int = 1) -> tuple[int, int]:
    """(raw tokens, targets): the most raw tokens whose corrupted inputs fit input_length.

    At a density of one half, targets longer than inputs are cut by one, with a token less.
    """
    extras = {"extra_inputs": extra_inputs, "extra_targets": extra_targets}
    tokens = input_length
    while corrupted_lengths(tokens + 1, density, mean_span, **extras).inputs <= input_length:
        tokens += 1
    targets = corrupted_lengths(tokens, density, mean_span, **extras).targets
    if density == 0.5 and targets > input_length:
        return tokens - 1, targets - 1
    return tokens, targets
