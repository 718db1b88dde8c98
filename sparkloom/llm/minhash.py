"""MinHash near-dedup: DartMinHash signatures, banded joins, an exact check, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import fresh, stage

_U = np.uint64
# Odd multipliers of the mixers.
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _class_table() -> np.ndarray:
    """0 for what parts words, else the byte, A-Z lower-cased; bytes beyond ASCII are parts of words."""
    table = np.zeros(256, np.uint8)
    table[48:58], table[97:123], table[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
    table[65:91] = table[97:123]
    return table


def shingles(text: bytes, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of that many words, sorted, and how often each stands there; a shorter text is one run."""
    data = _class_table()[np.frombuffer(text, np.uint8)]
    inside = data != 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    # A word's hash: its bytes as digits, by differences of a running sum taken back to the word's start.
    at = np.arange(len(data), dtype=np.uint64)
    power = _powers(len(data))
    run = np.concatenate([[_U(0)], np.cumsum(_mix(data.astype(_U) + _GOLD) * power[at.astype(np.int64)], dtype=_U)])
    word = _mix((run[last] - run[first]) * _inverse_powers(len(data))[first] ^ (last - first).astype(_U) * _GOLD)
    n = min(words, len(word))
    code = np.zeros(len(word) - n + 1, _U)
    for k in range(n):
        code = (code ^ word[k : k + len(code)]) * _M1 + _GOLD
    return np.unique(_mix(code), return_counts=True)


_BASE = 0xD1342543DE82EF95
_TABLES: dict[str, np.ndarray] = {}


def _running(base: int, n: int) -> np.ndarray:
    table = _TABLES.get(str(base))
    if table is None or len(table) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        full = np.full(size, _U(base))
        full[0] = 1
        table = _TABLES[str(base)] = np.multiply.accumulate(full)
    return table[:n]


def _powers(n: int) -> np.ndarray:
    return _running(_BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _running(pow(_BASE, -1, 1 << 64), n)


@dataclass(frozen=True)
class Bands:
    """bands groups of rows coordinates each, out of coordinates; a pair of similarity s shares one with 1 - (1 - s^rows)^bands.

    unit is the weight a cell is wide; set it near the usual weight, and the same for all that is compared.
    """

    coordinates: int = 252
    rows: int = 6
    bands: int = 42
    seed: int = 3
    unit: float = 1.0

    @property
    def darts(self) -> float:
        """Darts a set expects: with k ln k + 4 k of them, nearly every coordinate is hit."""
        return self.coordinates * (np.log(self.coordinates) + 4)


# Poisson(1), the chance of at most 0, 1, 2, ... darts in a cell.
_AT_MOST = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


def occurrences(elements: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sorted hashes of (element, 0), (element, 1), ... as often as it stands there: the sets of these have the weighted Jaccard similarity."""
    if not len(times) or times.max() == 1:
        return elements
    number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    repeated = np.repeat(elements, times)
    return np.sort(np.where(number > 0, _mix(repeated + number.astype(_U) * _GOLD), repeated))


def signature(elements: np.ndarray, weights: np.ndarray, bands: Bands) -> np.ndarray:
    """DartMinHash of a weighted set: per coordinate the earliest dart, as a 64-bit number.

    The plane over an element is cut by weight into strips [0, 1), [1, 2), [2, 4), [4, 8), ... of bands.unit, and a strip by rank into
    cells of area 1. A cell holds Poisson(1) darts, whose weight, rank and coordinate are hashes of element and cell, the
    same for each set. A dart counts if its weight lies below the element's; of those the earliest by rank is kept
    in each coordinate. Ranks up to darts / total weight are looked at, so that about as many darts are thrown for a set of any size, and large
    weights cost a strip for each doubling. Cells are looked at a block at a time, so memory is bounded for weights of any scale; weights far below
    bands.unit only cost time. A coordinate without any dart takes the next hit one, turned by its distance. Weights that are not above 0 count as absent.
    """
    weights = np.asarray(weights, np.float64) / bands.unit
    elements, weights = elements[weights > 0], weights[weights > 0]
    out, first = np.zeros(bands.coordinates, _U), np.full(bands.coordinates, np.inf)
    if not len(elements):
        return out
    limit = bands.darts / float(weights.sum())
    strips = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))), 0).astype(np.int64) + 1
    e, w = np.repeat(elements, strips), np.repeat(weights, strips)
    strip = np.arange(len(e)) - np.repeat(np.cumsum(strips) - strips, strips)
    wide = np.exp2(np.maximum(strip - 1, 0))
    low = np.where(strip > 0, wide, 0.0)
    cells = np.ceil(limit * wide).astype(np.int64)
    ends = np.cumsum(cells)
    seed = _mix(e + _U(bands.seed * int(_GOLD) % (1 << 64)))
    for at in range(0, int(ends[-1]), 1 << 18):
        number = np.arange(at, min(at + (1 << 18), int(ends[-1])))
        of = np.searchsorted(ends, number, side="right")
        step = number - (ends[of] - cells[of])
        cell = _mix(seed[of] + _mix(strip[of].astype(_U) * _M1 + step.astype(_U) + _GOLD))
        n = np.searchsorted(_AT_MOST, (cell >> _U(11)).astype(np.float64) / (1 << 53), side="right")
        which = np.repeat(np.arange(len(cell)), n)
        order = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        of, step = of[which], step[which]
        dart = _mix(cell[which] + (order.astype(_U) + _U(1)) * _GOLD)
        weight = low[of] + wide[of] * ((_mix(dart ^ _M2) >> _U(11)).astype(np.float64) / (1 << 53))
        rank = (step + (_mix(dart ^ _M1) >> _U(11)).astype(np.float64) / (1 << 53)) / wide[of]
        hit = (weight < w[of]) & (rank < limit)
        dart, rank = dart[hit], rank[hit]
        coordinate = (dart % _U(bands.coordinates)).astype(np.int64)
        last = np.lexsort((dart, rank))[::-1]
        found, when = np.zeros(bands.coordinates, _U), np.full(bands.coordinates, np.inf)
        found[coordinate[last]], when[coordinate[last]] = dart[last], rank[last]  # the earliest is written last
        sooner = when < first
        out[sooner], first[sooner] = found[sooner], when[sooner]
    there = np.isfinite(first)
    if not there.all():
        full = np.flatnonzero(there)
        if not len(full):
            return np.full(bands.coordinates, elements.min(initial=_U(0)))
        k = np.flatnonzero(~there)
        to = full[np.searchsorted(full, k) % len(full)]
        out[k] = _mix(out[to] + ((to - k) % bands.coordinates).astype(_U) * _GOLD)
    return out


def band_keys(sig: np.ndarray, bands: Bands) -> np.ndarray:
    """One 64-bit key a band, the band's number within."""
    parts = sig[: bands.bands * bands.rows].reshape(bands.bands, bands.rows)
    key = np.arange(bands.bands, dtype=_U) * _GOLD
    for k in range(bands.rows):
        key = _mix(key ^ parts[:, k]) + _GOLD
    return key


def _signed(texts: DataFrame, bands: Bands, words: int, weighted: bool) -> DataFrame:
    """(h, id, keys) of (h, id, text): the band keys of each text, none for a text without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece, known = batch.slice(at, 256), {}
                for h, text in zip(piece.column(0).to_pylist(), piece.column(2), strict=True):
                    if h not in known:
                        found, times = shingles(text.as_py().encode("utf-8", "replace"), words)
                        known[h] = band_keys(signature(found, times if weighted else np.ones(len(found)), bands), bands).astype(np.int64) if len(found) else np.zeros(0, np.int64)
                keys = pa.array([known[h] for h in piece.column(0).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), keys], names=["h", "id", "keys"])

    return texts.mapInArrow(run, f"h binary, id {texts.schema['id'].dataType.simpleString()}, keys array<long>")


def _sets(texts: DataFrame, words: int, weighted: bool) -> DataFrame:
    """(node, set) of (node, text): the sorted hashes of shingles (weighted: of their occurrences) as bytes."""

    def elements(text: str) -> bytes:
        found, times = shingles(text.encode("utf-8", "replace"), words)
        return (occurrences(found, times) if weighted else found).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                sets = [elements(t.as_py()) for t in piece.column(1)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return texts.mapInArrow(run, "node long, set binary")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity or more."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-12)
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    with_both = with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return with_both.select("a", "b", "sa", "sb").mapInPandas(check, "a long, b long")


def _few(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if its counted rows are few enough; else Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def _only(sets: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The sets of these nodes, written once, so that what is joined to them later does not shuffle all sets each time."""
    wanted = stage(nodes.select("node").distinct(), "minhash-wanted")
    return stage(sets.join(_few(wanted, most), "node", "left_semi"), "minhash-sets")


def _placed(member: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (bucket, node, ...) of buckets with more than one class, with their roots and their number m there."""
    placed = member.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("m")).filter("low <> high")
    return placed.join(mixed.select("bucket", "m"), "bucket")


def _able(mixed: DataFrame, near: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The (bucket, node, rank) of mixed, whose sets are near, that may still have a link to another text of their bucket; rank is the share of a text's elements that others have.
    And (node, alone): the elements no other has.

    Linked sets x and y share s / (1 + s) (|x| + |y|) elements at least, and what x shares stands in another text, too. So a
    text whose elements that stand in others are fewer than that, with the least y of its bucket, has no link there: of many copies
    with changes of their own, those with too many go here, each by itself, without looking at pairs.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                elements = [np.frombuffer(x.as_buffer(), np.int64) for x in piece.column(1)]
                nodes = np.repeat(piece.column(0).to_numpy(), [len(e) for e in elements])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(elements))], names=["node", "element"])

    elements = near.select("node", "set").mapInArrow(spread, "node long, element long")
    alone = elements.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("node")).filter("n = 1")
    alone = stage(alone.groupBy("node").agg(F.collect_list("element").alias("alone")), "minhash-alone")
    sized = near.select("node", (F.octet_length("set") / 8).alias("size")).join(alone.select("node", F.size("alone").alias("n")), "node", "left")
    sized = sized.select("node", "size", (F.col("size") - F.coalesce("n", F.lit(0))).alias("shared"))
    known = mixed.join(sized, "node")
    least = known.groupBy("bucket").agg(F.min("size").alias("other"))
    enough = F.col("shared") >= (F.col("size") + F.col("other")) * F.lit(similarity / (1 + similarity)) - 1e-6
    return known.join(least, "bucket").filter(enough).select("bucket", "node", (F.col("shared") / F.col("size")).alias("rank")), alone


@dataclass(frozen=True)
class Orders:
    """How buckets of several classes are searched: up to whole texts pair by pair, larger ones as a group around a centre found from looked_at texts,
    in blocks of about tile texts and elements differing elements each. None of these change the result.
    """

    whole: int = 16
    looked_at: int = 64
    tile: int = 2048
    elements: int = 2_000_000


def _beside(rows: DataFrame, group: list[str], order: list[str], neighbours: int) -> DataFrame:
    """(a, b) of each node and the nodes of other classes (root) among so many before it in the order within its group."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.array(*[F.lag(F.struct("node", "root"), k).over(w) for k in range(1, neighbours + 1)])
    pairs = rows.select(F.col("node").alias("b"), "root", before.alias("before"))
    other = F.filter("before", lambda x: x.isNotNull() & (x["root"] != F.col("root")))
    pairs = pairs.select("b", F.explode(F.transform(other, lambda x: x["node"])).alias("a"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, node, ...) with their sets sa and sn."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    return with_a.join(sets.withColumnRenamed("set", "sn"), "node")


def _centres(group: DataFrame, sets: DataFrame, looked_at: int) -> DataFrame:
    """(a, own): what most of a group's texts differ in from its text a, by looked_at of them: any set will do as centre, a near one parts texts best."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("node"), "node"))
    few = group.filter("a <> node").select("a", "node").withColumn("place", place).filter(F.col("place") <= looked_at).drop("place")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                found = [np.setxor1d(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64), assume_unique=True) for x, y in zip(piece.column(1), piece.column(2), strict=True)]
                a = np.repeat(piece.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate(found))], names=["a", "element"])

    counts = _paired(few, sets).select("a", "sa", "sn").mapInArrow(apart, "a long, element long").groupBy("a", "element").agg(F.count(F.lit(1)).alias("n"))
    sizes = few.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    return counts.join(_few(sizes, 300_000), "a").filter("2 * n > m").groupBy("a").agg(F.collect_list("element").alias("own"))


def _differences(group: DataFrame, sets: DataFrame, alone: DataFrame, similarity: float, orders: Orders) -> DataFrame:
    """(a, node, root, size, far, slack, diff) of groups (a, node, root) around a central text a.

    far is the number of elements that a text and its group's centre differ in, diff those of them that some other text may differ in, too, and slack is
    far - (1 - s) / (1 + s) size. Linked texts x and y differ in (1 - s) / (1 + s) (|x| + |y|) elements at most, and as they differ in far(x) + far(y) less
    twice what their differences share, they are linked if and only if that is (slack(x) + slack(y)) / 2 or more, whatever set is the centre.
    """
    centres = stage(_centres(group, sets, orders.looked_at), "minhash-centres")
    lone = alone.select("node", F.col("alone").alias("ln"))
    full = _paired(group, sets).join(lone, "node", "left").join(_few(centres, 100_000), "a", "left")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece, far, diff = batch.slice(at, 64), [], []
                for sa, sn, ln, own in zip(*(piece.column(k) for k in range(4, 8)), strict=True):
                    sa, sn = (np.frombuffer(x.as_buffer(), np.int64) for x in (sa, sn))
                    apart = np.setxor1d(np.setxor1d(sa, sn, assume_unique=True), np.asarray(own.values, np.int64))
                    far.append(len(apart))
                    diff.append(np.setdiff1d(apart, np.asarray(ln.values, np.int64), assume_unique=True))
                slack = np.array(far) - (1 - similarity) / (1 + similarity) * piece.column(3).to_numpy()
                columns = [*piece.columns[:4], pa.array(far, pa.int64()), pa.array(slack, pa.float64()), pa.array(diff, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "node", "root", "size", "far", "slack", "diff"])

    none = F.array().cast("array<bigint>")
    columns = ["a", "node", "root", (F.octet_length("sn") / 8).cast("bigint").alias("size"), "sa", "sn", *[F.coalesce(c, none).alias(c) for c in ("ln", "own")]]
    return stage(full.select(*columns).mapInArrow(differ, "a long, node long, root long, size long, far long, slack double, diff array<long>"), "minhash-diffs")


def _sharing(x: list[np.ndarray], y: list[np.ndarray], most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (i, j, n): x[i] and y[j], arrays of distinct numbers, have n > 0 numbers in common."""
    if not len(x) or not len(y):
        return
    long_x, long_y = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    number = np.unique(np.concatenate([*x, *y]), return_inverse=True)[1]
    of_x, of_y = number[: long_x.sum()], number[long_x.sum() :]
    holders = np.repeat(np.arange(len(y)), long_y)[np.argsort(of_y, kind="stable")]
    ends = np.cumsum(np.bincount(of_y, minlength=number.max(initial=-1) + 1))
    times = np.diff(ends, prepend=0)[of_x]
    row = np.repeat(np.arange(len(x)), long_x)
    start, work = np.cumsum(long_x) - long_x, np.cumsum(np.bincount(row, times, len(x)) + len(y))
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + most, side="right")))
        part = slice(start[at], start[to - 1] + long_x[to - 1])
        n, last = times[part], ends[of_x[part]]
        which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - last, n)
        counts = np.bincount((np.repeat(row[part], n) - at) * len(y) + holders[which], minlength=(to - at) * len(y))
        both = np.flatnonzero(counts)
        yield both // len(y) + at, both % len(y), counts[both]
        at = to


def _tile_links(similarity: float):
    """Of a tile's texts of two cells (or one, with itself), links that connect the same as all its links of different classes do.

    Pairs of texts that are both of the hub's class for sure (near) are left out.
    """

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        node, size, far, near, cell = (tile[c].to_numpy() for c in ("node", "size", "far", "near", "cell"))
        diff, label = tile["diff"].to_numpy(), np.unique(tile["root"].to_numpy(), return_inverse=True)[1]
        one, two = cell == tile["lo"].iloc[0], cell == tile["hi"].iloc[0]
        found = []
        for rows, columns in ((one & ~near, two), (two & ~near & ~one, one & near)):
            rows, columns = np.flatnonzero(rows), np.flatnonzero(columns)
            for i, j, n in _sharing(list(diff[rows]), list(diff[columns])):
                i, j = rows[i], columns[j]
                other = label[i] != label[j]
                i, j, n = i[other], j[other], n[other]
                both = (size[i] + size[j] - far[i] - far[j]) // 2 + n
                good = both >= similarity * (size[i] + size[j] - both) - 1e-12
                i, j = i[good], j[good]
                first = np.unique(np.stack([label[i], label[j]]), axis=1, return_index=True)[1] if len(i) else []
                for x, y in zip(i[first], j[first], strict=True):
                    if label[x] != label[y]:
                        found.append((node[x], node[y]))
                        label[label == label[y]] = label[x]
        return pd.DataFrame({"a": [min(p) for p in found], "b": [max(p) for p in found]}, dtype=np.int64)

    return run


def _tokens(live: DataFrame, large: DataFrame, orders: Orders) -> tuple[DataFrame, DataFrame]:
    """(a, part, node, cells, prefer) and (a, prefer): blocks of the texts of large groups (a, n, cells) by elements that two linked ones share; prefer where that takes fewer copies than the whole group.

    A text that must share need of its differing elements with any other shares one of all but need - 1 of them, whichever are left out; those most texts have are.
    """
    element = live.join(large.select("a"), "a").select("a", "node", "need", F.size("diff").alias("long"), F.explode("diff").alias("part"))
    element = stage(element, "minhash-elements")
    times = element.groupBy("a", "part").agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(Window.partitionBy("a", "node").orderBy("times", "part"))
    token = element.join(times, ["a", "part"]).withColumn("place", place).filter(F.col("place") <= F.col("long") - F.col("need") + 1)
    token = stage(token.select("a", "part", "node", "long"), "minhash-tokens")
    blocks = _cells(token.groupBy("a", "part"), F.sum("long"), orders).filter("n > 1").select("a", "part", "n", "cells")
    copies = blocks.groupBy("a").agg(F.sum(F.col("n") * F.col("cells")).alias("copies"))
    better = large.join(copies, "a", "left").select("a", (F.coalesce("copies", F.lit(0)) < F.col("n") * F.col("cells")).alias("prefer"))
    return token.join(blocks.drop("n"), ["a", "part"]).join(better, "a").select("a", "part", "node", "cells", "prefer"), better


def _cells(grouped, elements, orders: Orders) -> DataFrame:
    """The groups with their n texts, and the number of cells that these are dealt to."""
    counted = grouped.agg(F.count(F.lit(1)).alias("n"), elements.alias("elements"))
    return counted.withColumn("cells", F.greatest(F.ceil(F.col("n") / orders.tile), F.ceil(F.col("elements") / orders.elements)).cast("int"))


def _group_links(group: DataFrame, sets: DataFrame, alone: DataFrame, similarity: float, orders: Orders) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) yet to be checked, and links (a, b), that connect all that links of texts of groups (a, node, root) connect: exact.

    If the slack of two texts is 0 or less together, that of each with the group's hub, the text of least slack, is, too, so all such links are
    made by checking texts against the hub. Other linked texts share an element of their differences (see _differences). So groups are compared in
    tiles, where shared elements are counted without a row a pair; large groups either as a whole or by elements, whichever takes fewer copies. Texts that share too
    few with any other of their group for a further link are left out.
    """
    diffs = _differences(group, sets, alone, similarity, orders)
    hub = diffs.groupBy("a").agg(F.min(F.struct("slack", "node", "root")).alias("h")).select("a", F.col("h.slack").alias("least"), F.col("h.node").alias("b"), F.col("h.root").alias("rb"))
    known = diffs.join(_few(stage(hub, "minhash-hubs"), 300_000), "a")
    pairs = known.filter("root <> rb and slack + least <= 1e-6").select(F.least("node", "b").alias("x"), F.greatest("node", "b").alias("y")).toDF("a", "b")
    known = known.withColumn("near", F.expr("slack + least <= -1e-6")).drop("b", "rb")
    # What is near the hub only looks for texts that are not.
    rest = known.groupBy("a").agg(F.min(F.when(~F.col("near"), F.col("slack"))).alias("outer")).filter("outer is not null")
    known = known.join(_few(stage(rest, "minhash-outer"), 300_000), "a")
    need = F.greatest(F.lit(1), F.ceil((F.col("slack") + F.when(F.col("near"), F.col("outer")).otherwise(F.col("least"))) / 2 - 1e-6))
    live = stage(known.withColumn("need", need).filter(F.size("diff") >= F.col("need")).drop("slack", "least", "outer"), "minhash-live")
    whole = stage(_cells(live.groupBy("a"), F.sum(F.size("diff")), orders), "minhash-whole")
    blocks = live.join(_few(whole.select("a", "cells"), 300_000), "a").withColumn("part", F.lit(None).cast("bigint"))
    large = whole.filter("cells > 1")
    if not large.isEmpty():
        token, better = _tokens(live, large, orders)
        blocks = blocks.join(_few(better, 300_000), "a", "left").filter("prefer is null or not prefer").drop("prefer")
        blocks = blocks.unionByName(live.join(token.filter("prefer").drop("prefer"), ["a", "node"]))
    cell = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    tiles = blocks.withColumn("cell", cell).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    tiles = tiles.withColumn("lo", F.least("cell", "with")).withColumn("hi", F.greatest("cell", "with"))
    columns = ["a", "part", "lo", "hi", "cell", "node", "root", "size", "far", "near", "diff"]
    return pairs, tiles.select(*columns).groupBy("a", "part", "lo", "hi").applyInPandas(_tile_links(similarity), "a long, b long")


def near_classes(
    df: DataFrame, similarity: float = 0.8, *, id: str = "doc_id", text: str = "text", words: int = 5, weighted: bool = True, bands: Bands = Bands(), orders: Orders = Orders(),
    exact: bool = False, broadcast_rows: int = 500_000,
) -> DataFrame:
    """Per distinct text (by md5): h, class_id, keeper (whether the class' kept row has this text).

    Texts are near duplicates if their word runs, weighted by how often they stand there (unless weighted is False), have that Jaccard similarity or more (words:
    letters and digits, in lower case as far as ASCII goes; a text of fewer words is one run), and classes are what such links connect. Equal
    texts are folded first. Texts that share a band are candidates, and each bucket's least text is checked exactly against the rest.
    Where that leaves a bucket in different classes, texts that by their own elements alone can't have a further link are set aside; of the others,
    those in buckets of up to orders.whole are checked pair by pair. The larger ones whose most central texts are of one class form a group, whose
    links _group_links finds without a row a pair. So all that links of texts that share a band connect is one class; exact checks
    each pair of a bucket by itself instead, which gives the same.
    """
    rows = df.filter(F.col(text).isNotNull()).select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("h"), F.col(id).alias("id"), F.col(text).alias("text"))
    signed = _signed(rows, bands, words, weighted).groupBy("h").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    nodes = stage(signed.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")

    member = nodes.select("node", F.explode("keys").alias("bucket"))
    buckets = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("least")).filter("m > 1")
    member = stage(member.join(buckets, "bucket"), "minhash-buckets")

    near = member.select("node").distinct()
    wanted = nodes.join(near, "node").select("h", "id", "node")
    wanted = _few(stage(wanted, "minhash-wanted"), broadcast_rows)
    texts = rows.alias("r").join(wanted.alias("w"), (F.col("r.h") == F.col("w.h")) & F.col("r.id").eqNullSafe(F.col("w.id"))).select("w.node", "r.text")
    sets = stage(_sets(texts, words, weighted).dropDuplicates(["node"]), "minhash-sets")

    tested = stage(member.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "minhash-pairs")
    roots = components(_linked(tested, sets, similarity))
    mixed = stage(_placed(member.select("bucket", "node"), roots).select("bucket", "node"), "minhash-mixed")
    sets = _only(sets, mixed, broadcast_rows)
    able, alone = _able(mixed, sets, similarity)
    able = stage(able, "minhash-able")
    placed = stage(_placed(able, roots), "minhash-mixed")
    sets = _only(sets, placed, broadcast_rows)
    few, many, found = placed.filter(F.col("m") <= orders.whole), placed.filter(F.col("m") > orders.whole), None
    if exact:
        other = placed.select("bucket", F.col("node").alias("b"), F.col("root").alias("rb"))
        pairs = placed.join(other, "bucket").filter("node < b and root <> rb").select(F.col("node").alias("a"), "b")
    else:
        pairs = _beside(few, ["bucket"], ["node"], orders.whole - 1)
        if not many.isEmpty():
            centre = many.groupBy("bucket").agg(F.max(F.struct("rank", "node", "root")).alias("c")).select("bucket", "c.*")
            centre = stage(centre.select("bucket", F.struct("rank", F.col("node").alias("a")).alias("c"), F.col("root").alias("ra")), "minhash-centres")
            one = _few(centre.groupBy("ra").agg(F.max("c")["a"].alias("a")), 300_000)
            group = stage(many.join(centre.select("bucket", "ra"), "bucket").select("ra", "node", "root").distinct().join(one, "ra"), "minhash-groups")
            checked, found = _group_links(group.drop("ra"), sets, alone, similarity, orders)
            pairs = pairs.union(checked)
    pairs = stage(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "minhash-pairs")
    links = _linked(pairs, sets, similarity)
    links = stage(links if found is None else links.union(found).distinct(), "minhash-links")
    if not links.isEmpty():
        of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        over = components(lifted).select(F.col("id").alias("was"), F.col("root").alias("now"))
        old = roots.union(links.select("a", "a").union(links.select("b", "b")).distinct().join(roots.withColumnRenamed("id", "a"), "a", "left_anti"))
        roots = stage(old.join(over, F.col("root") == F.col("was"), "left").select("id", F.coalesce("now", "root").alias("root")), "minhash-roots")

    classed = nodes.join(roots.select(F.col("id").alias("node"), "root"), "node", "left").select("h", "id", F.coalesce("root", "node").alias("root"))
    least = classed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("first"))
    joined = classed.join(least, "root")
    return joined.select("h", F.col("first")["id"].alias("class_id"), (F.col("first")["h"] == F.col("h")).alias("keeper"))


def near_duplicates(df: DataFrame, similarity: float = 0.8, *, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Per row of df: id, class_id (the least id of its class), kept (whether it is the class' row that stays).

    A null text is a class of its own row, and stays. Texts without a word are equal only to themselves. Of rows that repeat id and
    text each is marked as kept; drop_near_duplicates leaves one. Null ids count as greatest. An empty
    table gives an empty one.
    """
    classes = near_classes(df, similarity, id=id, text=text, **how)
    rows = df.select(F.col(id), F.unhex(F.md5(F.col(text).cast("binary"))).alias("h"))
    out = rows.join(classes, "h", "left")
    kept = F.col("keeper") & F.col(id).eqNullSafe(F.col("class_id"))
    return out.select(F.col(id), F.coalesce("class_id", F.col(id)).alias("class_id"), F.coalesce(kept, F.lit(True)).alias("kept"))


PIECE = 1 << 15


def _marks(rows: DataFrame, most: int = 1 << 28) -> tuple[DataFrame, int]:
    """(place, bits) of rows (k: hashes): a bit is set for each hash, with 16 bits a row, or most in all, in pieces of PIECE; and the number of bits."""
    size = min(most, PIECE * max(1, -(-16 * rows.count() // PIECE)))
    at = F.pmod("k", F.lit(size))
    return rows.groupBy(F.floor(at / PIECE).alias("place")).agg(F.bitmap_construct_agg(at % PIECE).alias("bits")), size


def drop_near_duplicates(df: DataFrame, similarity: float = 0.8, *, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df with one row of each class: that with the least id. Rows with a null text stay; other columns pass through.

    Rows that go or repeat id and text are marked in a broadcast table of bits, by a hash. A row without a mark stays, and
    is not shuffled; those with one, among them a few by chance, are joined to the kept ones.
    """
    h, key, n, stays, k, place, bits = fresh(df, "h", "key", "n", "stays", "k", "place", "bits")
    keepers = near_classes(df, similarity, id=id, text=text, **how).filter("keeper").select(F.col("h").alias(f"{h}_"), F.col("class_id").alias(f"{key}_"), F.lit(True).alias(stays))
    hashed = df.withColumn(h, F.unhex(F.md5(F.col(text).cast("binary")))).withColumn(k, F.xxhash64(h, id))
    times = hashed.filter(F.col(h).isNotNull()).groupBy(h, F.col(id).alias(key)).agg(F.count(F.lit(1)).alias(n))
    judged = times.join(keepers, (F.col(h) == F.col(f"{h}_")) & F.col(key).eqNullSafe(F.col(f"{key}_")), "left")
    judged = stage(judged.select(F.col(h).alias(f"{h}_"), F.col(key).alias(f"{key}_"), n, stays), "minhash-judged")
    marks, size = _marks(judged.filter(F.col(stays).isNull() | (F.col(n) > 1)).select(F.xxhash64(f"{h}_", f"{key}_").alias("k")))
    at = F.pmod(k, F.lit(size))
    marked = hashed.withColumn(place, F.floor(at / PIECE)).join(F.broadcast(marks.toDF(place, bits)), place, "left")
    byte = F.conv(F.hex(F.substring(bits, (at % PIECE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    unmarked = marked.filter(F.col(h).isNull() | ~hit).select(*df.columns)
    kept = marked.filter(hit).join(judged.filter(stays), (F.col(h) == F.col(f"{h}_")) & F.col(id).eqNullSafe(F.col(f"{key}_")))
    once = kept.filter(F.col(n) == 1).select(*df.columns)
    again = kept.filter(F.col(n) > 1).dropDuplicates([h, id]).select(*df.columns)
    return unmarked.unionByName(once).unionByName(again)
