"""Arrow arrays as numpy has them: lists in parts of bounded size, so that a worker holds little beside the batch it is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of texts (or four times the elements of lists) that are worked on at once: beside them some 30 bytes an element are held.
PART = 1 << 19


def parts(array: pa.Array, most: int = PART) -> Iterator[pa.Array]:
    """Slices of an array of strings or of lists, of at most so many bytes or a row."""
    if pa.types.is_list(array.type) or pa.types.is_large_list(array.type):
        sizes = 4 * pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 64)
    at = 0
    while at < len(array):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield array.slice(at, end - at)
        at = end


def opened(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets from 0, values) of an array of lists; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), array.flatten()


def closed(offsets: np.ndarray, values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """An array of lists; null where null says so (such a list must be empty)."""
    mask = pa.array(null) if null is not None and null.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=mask)


def nulls(array: pa.Array) -> np.ndarray:
    return array.is_null().to_numpy(zero_copy_only=False)


def kept(make: Callable, most: int) -> Callable:
    """make, with the results of the first values that come up (at most so many) kept."""
    known: dict = {}

    def find(value):
        found = known.get(value)
        if found is None:
            found = make(value)
            if len(known) < most:
                known[value] = found
        return found

    return find


def by_value(values: pa.Array, find: Callable[[bytes], object]) -> tuple[np.ndarray, list]:
    """(indices, table): values[i] has the result table[indices[i]], find of its bytes. Each different value is looked up once."""
    coded = values.cast(pa.binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), [find(v) for v in coded.dictionary.to_pylist()]


def by_text(f: Callable, *others: bool):
    """A UDF of a text (and as many more as others) by f on each, null where one is null; only a part of a batch is held as Python's strings."""

    def each(batch: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
        at = 0
        for part in parts(batch[0], PART // 4):
            rows = zip(*[b.slice(at, len(part)).to_pylist() for b in batch], strict=True)
            yield pa.array([None if None in row else f(*row) for row in rows], pa.string())
            at += len(part)

    if others:

        @F.arrow_udf(T.StringType())
        def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                yield from each(batch)

        return several

    @F.arrow_udf(T.StringType())
    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from each((batch,))

    return one


def spread(offsets: np.ndarray, indices: np.ndarray, sizes: np.ndarray, flat: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of lists in which element i stands for the run indices[i] of flat, cut by sizes, and end follows each list."""
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    each = sizes[indices]
    before = np.concatenate([[0], np.cumsum(each)])
    rows = len(offsets) - 1
    of = np.repeat(np.arange(rows), np.diff(offsets))  # the list of each element
    out = np.empty(before[-1] + rows * len(end), np.int32)
    ends = before[offsets] + np.arange(rows + 1) * len(end)
    place = np.arange(before[-1])
    stays = place - np.repeat(before[:-1], each)
    out[place + np.repeat(of * len(end), each)] = flat[np.repeat(starts[indices], each) + stays]
    for k, e in enumerate(end):
        out[ends[1:] - len(end) + k] = e
    return ends, out
