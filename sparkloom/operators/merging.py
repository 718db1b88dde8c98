"""Merges of a vocabulary found on the cluster: counted words stay in their tasks as arrays of symbols, only counts of pairs reach the driver.

A round applies as many merges as are certain. Pairs are taken by falling count (ties by ids) while none touches the ones taken: with
(a, b) taken, pairs ending in a or beginning with b lose counts, and a new pair has at most the count of such a one, which comes later in the order. So the
pairs taken are those that single merges would take, in the same order.
"""

from __future__ import annotations

import heapq
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

END = -1  # follows each word
BLOCK = 1_000_000  # symbols: a task holds one block at a time, and some 50 bytes a symbol
CUT = 25  # rounds after which the lineage is cut


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, without those of 0."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sums = np.add.reduceat(n, starts)
    return keys[starts][sums != 0], sums[sums != 0]


def pairs_of(symbols: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of each place where two symbols of a word meet; a key is left << 32 | right."""
    ends = np.flatnonzero(symbols == END)
    each = np.repeat(weights, np.diff(ends, prepend=-1))
    met = np.flatnonzero((symbols[:-1] != END) & (symbols[1:] != END))
    return symbols[met].astype(np.int64) << 32 | symbols[met + 1], each[met]


def merged(symbols: np.ndarray, weights: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols and weights after the merges (key, new) of a batch, and how counts of pairs have changed (key, change). Words of one symbol are dropped."""
    keys, new = batch[:, 0], batch[:, 1].astype(np.int32)
    size = int(max(symbols.max(initial=0), (keys >> 32).max(), (keys & 0xFFFFFFFF).max())) + 2
    left, right = np.zeros(size, bool), np.zeros(size, bool)  # END, -1, is the last
    left[keys >> 32], right[keys & 0xFFFFFFFF] = True, True
    at = np.flatnonzero(left[symbols[:-1]] & right[symbols[1:]])
    here = symbols[at].astype(np.int64) << 32 | symbols[at + 1]
    which = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
    at, which = at[keys[which] == here], which[keys[which] == here]
    if not len(at):
        return symbols, weights, np.empty(0, np.int64), np.empty(0, np.int64)
    # Matches that overlap are those of a symbol with itself: from the left, every other one holds.
    first = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], np.arange(len(at)), 0))
    held = (np.arange(len(at)) - first) % 2 == 0
    at, which = at[held], which[held]
    ends = np.flatnonzero(symbols == END)
    lengths = np.diff(ends, prepend=-1)
    hit = np.zeros(len(ends), bool)
    hit[np.searchsorted(ends, at)] = True
    inside = np.repeat(hit, lengths)
    out, stays = symbols.copy(), np.ones(len(symbols), bool)
    out[at], stays[at + 1] = new[which], False
    before, n = pairs_of(symbols[inside], weights[hit])
    after, m = pairs_of(out[inside & stays], weights[hit])
    changed = summed(np.concatenate([after, before]), np.concatenate([m, -n]))
    out = out[stays]
    ends = np.flatnonzero(out == END)
    lengths = np.diff(ends, prepend=-1)
    more = lengths > 2
    return out[np.repeat(more, lengths)], weights[more], *changed


def blocks(counts: DataFrame, first: np.ndarray) -> RDD:
    """Blocks (symbols, weights, keys, counts of pairs) of counted words (word, n); first has the symbol of each byte: within a word, as its first, its last, and its only one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, weights, held = [], [], 0

        def block():
            return pa.RecordBatch.from_pydict({"symbols": [np.concatenate(symbols).tobytes()], "weights": [np.concatenate(weights).tobytes()]}, schema)

        schema = pa.schema([("symbols", pa.binary()), ("weights", pa.binary())])
        for batch in batches:
            words = batch.column(0).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]) if len(words) else np.empty(0, np.int64)
            if not sizes.sum():
                continue
            start = np.frombuffer(words.buffers()[1], np.int64)[words.offset]
            letters = np.frombuffer(words.buffers()[2], np.uint8)[start : start + sizes.sum()]
            out = np.full(len(letters) + len(words), END, np.int32)
            place = np.zeros(len(letters), np.int64)
            ends = np.cumsum(sizes)[sizes > 0]
            place[ends - sizes[sizes > 0]] += 1
            place[ends - 1] += 2
            out[np.arange(len(letters)) + np.repeat(np.arange(len(words)), sizes)] = first[place, letters]
            symbols.append(out)
            weights.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            held += len(out)
            if held > BLOCK:
                yield block()
                symbols, weights, held = [], [], 0
        if symbols:
            yield block()

    def opened(row) -> tuple:
        symbols, weights = np.frombuffer(row[0], np.int32).copy(), np.frombuffer(row[1], np.int64).copy()
        return symbols, weights, *summed(*pairs_of(symbols, weights))

    sc = counts.sparkSession.sparkContext
    dealt = counts.select("word", "n").mapInArrow(cut, "symbols binary, weights binary").rdd.map(opened)
    return dealt.coalesce(max(1, sc.defaultParallelism))


def _checkpoints(spark: SparkSession) -> None:
    """Cuts of the lineage go to the folder in spark.checkpoint.dir; where that is unset, to a temporary one in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    sc.setCheckpointDir(where)


def _remove(spark: SparkSession, path: str | None) -> None:
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def merge(counts: DataFrame, tokens: list[str], first: np.ndarray, size: int, min_frequency: int, *, cut: int = 0) -> list[tuple[str, str]]:
    """The merges in order, until there are size tokens or no pair has min_frequency; new tokens, the right part less its first cut letters, are added to tokens."""
    spark = counts.sparkSession
    _checkpoints(spark)
    ids = {t: i for i, t in enumerate(tokens)}
    pairs: dict[int, int] = {}
    heap: list[tuple[int, int]] = []
    merges: list[tuple[str, str]] = []
    written = None

    def absorb(state: RDD) -> None:
        def total(part: Iterator) -> Iterator:
            part = [(b[2], b[3]) for b in part]
            if part:
                yield summed(np.concatenate([k for k, _ in part]), np.concatenate([n for _, n in part]))

        found = state.mapPartitions(total).collect()
        if not found:
            return
        keys, changes = summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))
        for key, change in zip(keys.tolist(), changes.tolist(), strict=True):
            now = pairs.get(key, 0) + change
            if now > 0:
                pairs[key] = now
                if change > 0:
                    heapq.heappush(heap, (-now, key))
            else:
                pairs.pop(key, None)

    def certain() -> list[tuple[int, int]]:
        batch, lefts, rights = [], set(), set()
        while heap and len(tokens) < size:
            n, key = heapq.heappop(heap)
            now = pairs.get(key, 0)
            if -n != now:
                if now > 0:
                    heapq.heappush(heap, (-now, key))
                continue
            a, b = key >> 32, key & 0xFFFFFFFF
            if now < min_frequency or a in rights or b in lefts:
                heapq.heappush(heap, (n, key))
                break
            del pairs[key]
            joined = tokens[a] + tokens[b][cut:]
            merges.append((tokens[a], tokens[b]))
            known = joined in ids
            if not known:
                ids[joined] = len(tokens)
                tokens.append(joined)
            batch.append((key, ids[joined]))
            lefts.add(a)
            rights.add(b)
            if known or a == b:  # what they make may have more than the next pair
                break
        return sorted(batch)

    state = blocks(counts, first).persist(StorageLevel.MEMORY_AND_DISK)
    absorb(state)
    rounds = 0
    while batch := certain():
        if len(tokens) >= size:
            break  # nothing is asked of the counts any more
        table = np.array(batch, np.int64)
        following = state.map(lambda b, table=table: merged(b[0], b[1], table)).persist(StorageLevel.MEMORY_AND_DISK)
        rounds += 1
        if rounds % CUT == 0:
            following.checkpoint()
        absorb(following)
        for key, _ in batch:
            pairs.pop(key, None)
        state.unpersist()
        state = following
        if rounds % CUT == 0:
            _remove(spark, written)
            written = state.getCheckpointFile()
    state.unpersist()
    _remove(spark, written)
    return merges
