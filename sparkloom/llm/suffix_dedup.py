"""Suffix-array dedup: maximal repeats by the common-prefix interval tree of enhanced suffix arrays.

One suffix array over a whole corpus fits no task. Every window of `least` bytes therefore has an anchor, its
least k-gram by a hash (the leftmost, if it is there more than once); equal windows have equal anchors, at equal places. Windows that
follow one another and share their anchor make up a segment. So all occurrences of a repeat meet among
the segments of one anchor, and the suffix arrays are built over those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

_U = np.uint64
# Odd multipliers of the mixers, and the base of the running hash.
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_PLACE = _U((1 << 20) - 1)
_LONGEST = 4097
_CHUNK = (1 << 20) - _LONGEST + 1
_FIRST = 7
_ROWS = 1000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class _Hasher:
    """Hashes of byte ranges of up to 2^20 bytes, by differences of a running sum."""

    def __init__(self):
        n = 1 << 20
        steps = np.full(n, _U(_BASE))
        steps[0] = 1
        self.power = np.multiply.accumulate(steps)
        steps[1:] = _U(pow(_BASE, -1, 1 << 64))
        self.inverse = np.multiply.accumulate(steps)
        self.byte = _mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)

    def load(self, data: np.ndarray) -> None:
        self.run = np.zeros(len(data) + 1, _U)
        np.cumsum(self.byte[data] * self.power[: len(data)], out=self.run[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _mix((self.run[last] - self.run[first]) * self.inverse[first])


def segments(data: np.ndarray, hasher: _Hasher, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, content, start, length) of each segment of data: hashes of its anchor and of its bytes and the anchor's place, and where it is."""
    n, w = len(data), least - gram + 1
    hasher.load(data)
    grams = np.arange(n - gram + 1)
    h = hasher.of(grams, grams + gram)
    key = (h & ~_PLACE) | grams.astype(_U)
    padded = np.full(-(-len(key) // w) * w, ~_U(0))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - least + 1
    at = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [windows]]) - 1
    anchor = at[first]
    stop = last + least
    content = _mix(hasher.of(first, stop) ^ (anchor - first).astype(_U) * _M1 + (stop - first).astype(_U) * _GOLD)
    return h[anchor], content, first, stop - first


def _cut(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """(anchor, content, k, size, start, length, m) of (k, size, text): the segments of each distinct text of a task, which had it m times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                piece = batch.slice(begin, 512)
                keys, times = piece.column(0).to_pylist(), {}
                for key in keys:
                    times[key] = times.get(key, 0) + 1
                out: list[tuple[np.ndarray, ...]] = []
                for row, key in enumerate(keys):
                    if not (m := times.pop(key, 0)):
                        continue
                    whole = np.frombuffer(piece.column(2)[row].as_buffer(), np.uint8)
                    for at in range(0, len(whole) - least + 1, _CHUNK):
                        a, c, first, length = segments(whole[at : at + _CHUNK + least - 1], hasher, least, gram)
                        n = len(a)
                        out.append((a.view(np.int64), c.view(np.int64), np.full(n, key), np.full(n, len(whole)), first + at, length, np.full(n, m)))
                if out:
                    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "content", "k", "size", "start", "length", "m"])

    return texts.mapInArrow(run, "anchor long, content long, k long, size long, start long, length int, m int")


class EnhancedSuffixArray:
    """The suffixes of at least `least` bytes of some strings, sorted within groups of strings, with their common prefixes.

    Ranks of 7, 14, 28, ... bytes are got by doubling, up to the longest string; a string's end ranks below any byte.
    """

    def __init__(self, strings: list[bytes], group: np.ndarray, least: int):
        lengths = np.array([len(s) for s in strings], np.int64)
        self.base = np.cumsum(lengths) - lengths
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        n = len(self.data)
        self.kind = np.int32 if n < 1 << 31 else np.int64
        self.string = np.repeat(np.arange(len(strings), dtype=self.kind), lengths)
        self.stop = np.repeat((self.base + lengths).astype(self.kind), lengths)
        place = np.arange(n, dtype=self.kind)
        key = np.zeros(n, _U)
        for k in range(_FIRST):
            inside = place + k < self.stop
            key = key << _U(9) | np.where(inside, self.data[np.minimum(place + k, n - 1)].astype(_U) + _U(1), _U(0))
        self.ranks = [self._ranked(key)]
        del key
        self.levels = [_FIRST]
        while self.levels[-1] < lengths.max():
            step = self.levels[-1]
            self.levels.append(2 * step)
            inside = place + step < self.stop
            after = np.where(inside, self.ranks[-1][np.minimum(place + step, n - 1)], 0)
            self.ranks.append(self._ranked(self.ranks[-1].astype(np.int64) * (n + 1) + after))
        starts = np.flatnonzero(self.stop - place >= least).astype(self.kind)
        of = group[self.string[starts]]
        self.suffix = starts[np.lexsort((self.ranks[-1][starts], of))]
        self.of = group[self.string[self.suffix]]
        self.lcp = self._common(self.suffix[:-1], self.suffix[1:])
        self.lcp[self.of[1:] != self.of[:-1]] = 0

    def _ranked(self, key: np.ndarray) -> np.ndarray:
        return np.unique(key, return_inverse=True)[1].astype(self.kind) + self.kind(1)

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        n, room = len(self.data), np.minimum(self.stop[p] - p, self.stop[q] - q)
        done = np.zeros(len(p), self.kind)
        for level, ranks in zip(reversed(self.levels), reversed(self.ranks), strict=True):
            same = (done + level <= room) & (ranks[np.minimum(p + done, n - 1)] == ranks[np.minimum(q + done, n - 1)])
            done = np.where(same, done + level, done)
        for _ in range(_FIRST):
            same = (done < room) & (self.data[np.minimum(p + done, n - 1)] == self.data[np.minimum(q + done, n - 1)])
            done = np.where(same, done + 1, done)
        return done

    def left(self, suffix: int) -> int:
        """The byte before a suffix; a string's start differs from all else."""
        return int(self.data[suffix - 1]) if suffix > self.base[self.string[suffix]] else -1 - suffix

    def repeats(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, suffixes) of each maximal repeat: the nodes of the interval tree, found by a stack, whose left extensions differ."""
        lcp = self.lcp
        hot = np.flatnonzero(lcp >= least)
        if not len(hot):
            return
        breaks = np.flatnonzero(np.diff(hot) > 1)
        for a, b in zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(hot) - 1]]), strict=True):
            low, high = int(hot[a]), int(hot[b]) + 1  # suffixes low to high share least bytes with a neighbour
            values = [*lcp[low:high].tolist(), 0]
            lefts = [self.left(s) for s in self.suffix[low : high + 1].tolist()]
            change = [0]
            for x, y in zip(lefts, lefts[1:], strict=False):
                change.append(change[-1] + (x != y))
            stack = [(0, 0)]  # (common prefix, first suffix)
            for i, value in enumerate(values):
                first = i
                while stack[-1][0] > value:
                    length, first = stack.pop()
                    if change[i] > change[first]:
                        yield length, self.suffix[low + first : low + i + 1]
                if stack[-1][0] < value:
                    stack.append((value, first))


def _by_anchor(members: DataFrame, least: int, work, schema: str) -> DataFrame:
    """work(rows, suffix array) on the segments (anchor, content, bytes) of whole anchors, up to _ROWS at a time, or one anchor if that has more.

    An array and its work take some 100 bytes a byte of its segments, so this is what bounds a worker's memory, however many rows a batch has.
    """

    def arrayed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["anchor", "content"]).reset_index(drop=True)
        return work(rows, EnhancedSuffixArray(rows["bytes"].tolist(), np.unique(rows["anchor"], return_inverse=True)[1], least))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            waiting.append(batch)
            if batch["anchor"].iloc[-1] == waiting[0]["anchor"].iloc[0]:
                continue  # one anchor so far, and more of it may follow
            whole = pd.concat(waiting, ignore_index=True)
            anchors = whole["anchor"].to_numpy()
            starts = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            at, last = 0, int(starts[-1])
            while at < last:
                most = np.searchsorted(starts, at + _ROWS, side="right") - 1
                to = int(starts[max(most, np.searchsorted(starts, at, side="right"))])
                yield arrayed(whole.iloc[at:to])
                at = to
            waiting = [whole.iloc[last:].copy()]
        if waiting:
            yield arrayed(pd.concat(waiting, ignore_index=True))

    dealt = members.select("anchor", "content", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInPandas(run, schema)


def repeat_groups(members: DataFrame, least: int) -> DataFrame:
    """(anchor, length, found): the maximal repeats among the segments of each anchor, each with all its occurrences (content, at)."""

    def work(rows: pd.DataFrame, array: EnhancedSuffixArray) -> pd.DataFrame:
        anchors, contents, out = rows["anchor"].to_numpy(np.int64), rows["content"].to_numpy(np.int64), []
        for length, suffixes in array.repeats(least):
            strings = array.string[suffixes]
            found = [{"content": int(contents[s]), "at": int(p)} for s, p in zip(strings, suffixes - array.base[strings], strict=True)]
            out.append((int(anchors[strings[0]]), length, found))
        return pd.DataFrame(out, columns=["anchor", "length", "found"])

    return _by_anchor(members, least, work, "anchor long, length int, found array<struct<content: long, at: int>>")


def _covered(members: DataFrame, least: int) -> DataFrame:
    """(anchor, content, a, b): what the occurrences of those repeats cover of each segment, put together, so with a row or two a segment."""

    def work(rows: pd.DataFrame, array: EnhancedSuffixArray) -> pd.DataFrame:
        marks = np.zeros(len(array.data) + 1, np.int64)
        for length, suffixes in array.repeats(least):
            marks[suffixes] += 1
            np.subtract.at(marks, suffixes + length, 1)
        inside = np.concatenate([[False], np.cumsum(marks[:-1]) > 0, [False]])
        breaks = np.zeros(len(inside), bool)
        breaks[array.base[1:] + 1] = True  # a string's start parts what it covers from the string before
        opens = np.flatnonzero(inside[1:-1] & (~inside[:-2] | breaks[1:-1]))
        closes = np.flatnonzero(inside[1:-1] & (~inside[2:] | breaks[2:])) + 1
        of = array.string[opens]
        return pd.DataFrame({"anchor": rows["anchor"].to_numpy()[of], "content": rows["content"].to_numpy()[of], "a": (opens - array.base[of]).astype(np.int32), "b": (closes - array.base[of]).astype(np.int32)})

    return _by_anchor(members, least, work, "anchor long, content long, a int, b int")


def _recut(members: DataFrame, least: int, gram: int) -> DataFrame:
    """(above, within, anchor, content, start, length, m) of (anchor, content, bytes): the segments of segments by longer anchors. above and within are those segments' anchor and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                out: list[tuple[np.ndarray, ...]] = []
                above, within, strings = (c.to_pylist() for c in batch.slice(begin, 512).columns)
                for a, w, data in zip(above, within, strings, strict=True):
                    h, content, first, length = segments(np.frombuffer(data, np.uint8), hasher, least, gram)
                    anchor = _mix(h ^ _mix(np.full(1, a).view(_U)))
                    part = b"".join(hashlib.blake2b(data[x : x + n], digest_size=8, key=c.tobytes()).digest() for x, n, c in zip(first, length, content, strict=True))
                    n = len(first)
                    out.append((np.full(n, a), np.full(n, w), anchor.view(np.int64), np.frombuffer(part, np.int64), first, length, np.ones(n, np.int64)))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                columns = [pa.array(np.concatenate(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["above", "within", "anchor", "content", "start", "length", "m"])

    return members.select("anchor", "content", "bytes").mapInArrow(run, "above long, within long, anchor long, content long, start long, length int, m int")


def _shared(cut: DataFrame) -> DataFrame:
    """The segments whose anchor another has, with their own number n and their anchor's number of different ones and of those there once."""
    counted = cut.groupBy("anchor", "content").agg(F.sum("m").alias("n"))
    anchors = counted.groupBy("anchor").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("different"), F.count_if(F.col("n") == 1).alias("once")).filter(F.col("all") > 1)
    shared = counted.join(anchors, "anchor").select("anchor", "content", "n", "different", "once")
    return stage(cut.join(shared, ["anchor", "content"]).drop("m"), "suffix-shared")


def _compared(members: DataFrame, least: int, gram: int, suffix_rows: int) -> DataFrame:
    """(anchor, content, a, b): what repeats cover of each of the members (anchor, content, different, bytes).

    The segments of an anchor are compared by a suffix array. Those of an anchor that has more than suffix_rows are
    first cut again, by anchors of twice the length, and so on up to `least` bytes, where a window is its own anchor and equal ones are equal segments.
    Equal windows have equal anchors at each length, so no repeat is lost, and no suffix array holds more.
    """
    few, many = members.filter(F.col("different") <= suffix_rows), members.filter(F.col("different") > suffix_rows)
    covered = _covered(few, least)
    if gram >= least or many.isEmpty():
        return covered
    gram, many = min(2 * gram, least), many.dropDuplicates(["anchor", "content"])
    found = _shared(stage(_recut(many, least, gram), "suffix-deeper"))
    above = [F.col("above").alias("anchor"), F.col("within").alias("content")]
    whole = found.filter("n > 1").select(*above, F.col("start").cast("int").alias("a"), (F.col("start") + F.col("length")).cast("int").alias("b"))
    covered = covered.unionByName(whole)
    if gram == least:
        return covered
    open_ = found.filter((F.col("different") > 1) & (F.col("once") > 0))
    chosen = open_.groupBy("anchor", "content").agg(F.min(F.struct("above", "within", "start", "length")).alias("at"), F.first("different").alias("different"))
    texts = many.select(F.col("anchor").alias("above"), F.col("content").alias("within"), "bytes")
    part = F.substring(F.col("bytes"), F.col("start").cast("int") + 1, F.col("length"))
    inner = chosen.select("anchor", "content", "different", "at.*").join(texts, ["above", "within"]).select("anchor", "content", "different", part.alias("bytes"))
    single = open_.filter("n = 1").join(_compared(stage(inner, "suffix-members"), least, gram, suffix_rows), ["anchor", "content"])
    return covered.unionByName(single.select(*above, (F.col("start") + F.col("a")).cast("int").alias("a"), (F.col("start") + F.col("b")).cast("int").alias("b")))


def _few(df: DataFrame, lists: str, most: int) -> DataFrame:
    """df, to be broadcast if its rows and the entries of its lists, counted, are few enough; else Spark joins by a shuffle."""
    rows, entries = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return F.broadcast(df) if rows + entries <= most else df


def repeated_spans(
    texts: DataFrame, least: int = 200, *, gram: int = 64, suffix_rows: int = 2000, broadcast_rows: int = 1_500_000
) -> DataFrame:
    """(k, size, spans) of texts (k, size, text: binary of at least `least` bytes): for each distinct text the ranges covered by repeats.

    k and size identify a text. A segment whose bytes occur twice is a repeat as it stands. The others of its anchor
    are compared by suffix arrays; suffix_rows is how many segments one takes before longer anchors part them. The counts travel as hashes; only the
    bytes of segments that share an anchor with another do. Texts are sent the list of their segments by a broadcast up to broadcast_rows
    entries, beyond by a shuffle. `least` is from gram to 4,097 bytes; others are an error.
    """
    if not gram <= least <= _LONGEST:
        raise ValueError(f"least must be from {gram} to {_LONGEST} bytes")
    found = _shared(stage(_cut(texts, least, gram), "suffix-segments"))

    open_ = found.filter((F.col("different") > 1) & (F.col("once") > 0))
    chosen = open_.groupBy("anchor", "content").agg(F.min(F.struct("k", "size", "start", "length")).alias("at"), F.first("different").alias("different"))
    per_text = chosen.groupBy("at.k", "at.size").agg(F.collect_list(F.struct("anchor", "content", "at.start", "at.length", "different")).alias("wanted"))
    wanted = _few(stage(per_text, "suffix-wanted"), "wanted", broadcast_rows)
    located = texts.join(wanted, ["k", "size"]).select("text", F.explode("wanted").alias("w"))
    part = F.substring(F.col("text"), F.col("w.start").cast("int") + 1, F.col("w.length"))
    members = stage(located.select("w.anchor", "w.content", "w.different", part.alias("bytes")), "suffix-members")

    covered = stage(_compared(members, least, gram, suffix_rows), "suffix-covered")

    whole = found.filter("n > 1").select("k", "size", "start", (F.col("start") + F.col("length")).alias("stop"))
    single = open_.filter("n = 1").join(covered, ["anchor", "content"]).select("k", "size", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("stop"))
    in_text = Window.partitionBy("k", "size").orderBy("start", "stop")
    so_far = F.max("stop").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    opens = whole.union(single).withColumn("opens", (F.coalesce(so_far, F.lit(-1)) < F.col("start")).cast("int"))
    runs = opens.withColumn("run", F.sum("opens").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("k", "size", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.groupBy("k", "size").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeats(df: DataFrame, least: int = 200, *, id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_500_000, **how) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans (start, stop).

    A byte goes if a string of `least` bytes over it also starts anywhere else, in this text or another, judged on the
    input. A null text is empty; texts under `least` bytes stay whole; texts that repeat go wholly from that
    length on; an empty table gives an empty one. `least` is from gram (64) to 4,097.
    """
    rows = df.select(F.col(id), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumns({"k": F.xxhash64("text"), "size": F.octet_length("text").cast("bigint")})
    spans = repeated_spans(rows.filter(F.col("size") >= least).select("k", "size", "text"), least, broadcast_rows=broadcast_rows, **how)
    spans = _few(stage(spans, "suffix-spans"), "spans", broadcast_rows)
    joined = rows.join(spans, ["k", "size"], "left").select(id, "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                sizes, kept, gone = [], [], []
                for data, found in zip(piece.column(1), piece.column(2), strict=True):
                    whole, merged = data.as_py(), []
                    for a, b in sorted((s["start"], s["stop"]) for s in found.as_py() or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    edges = [0, *(x for m in merged for x in m), len(whole)]
                    sizes.append(len(whole))
                    kept.append(b"".join(whole[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                    gone.append([{"start": a, "stop": b} for a, b in merged])
                removed = [n - len(k) for n, k in zip(sizes, kept, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                columns = [piece.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(kept, pa.binary()), pa.array(gone, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[id, "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    kind = df.schema[id].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, stop: long>>")
