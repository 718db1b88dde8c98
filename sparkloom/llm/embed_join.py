"""Embedding near-dedup: an exact metric range join over cells around pivots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import renewed, stage, unit
from .vectors import matrix, usable

_SAFE = 1e-9


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _places(rows: pd.DataFrame, at: pd.DataFrame, eps: float):
    """Of rows and pivots: (row, pivot) of each place a row has, and each row's own pivot, a part of the rows at a time."""
    p = _unit_rows(matrix(at["vec"]))
    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
    for k in range(0, len(rows), 4096):
        d = np.sqrt(np.maximum(0, 2 - 2 * _unit_rows(matrix(rows["vec"].iloc[k : k + 4096])) @ p.T))
        near = d.argmin(1)
        least = d[np.arange(len(d)), near][:, None]
        goes = (d - least <= 2 * eps + _SAFE) & (d * d - least * least <= 2 * eps * between[near] + _SAFE)
        goes[np.arange(len(d)), near] = True
        i, q = np.nonzero(goes)
        yield i + k, q, near[i] == q


def _split(items: DataFrame, big: DataFrame, cell_rows: int, eps: float, level: int) -> tuple[DataFrame, DataFrame] | None:
    """Deals the items of the big cells (cell, n) to the cells of their nearest pivots, and to those where a neighbour may be.

    Pivots are members chosen by a hash, about 2 n / cell_rows and at most 64 a cell. A vector y goes to the cell of
    its nearest pivot p, and as a guest to that of q if a vector there may lie within eps: by the triangle inequality
    only if d(y, q) - d(y, p) <= 2 eps, and by that of the bisecting plane only if d(y, q)^2 - d(y, p)^2 <= 2 eps d(p, q).
    A big cell is dealt in salted parts with the pivots copied to each. The places are counted first: a cell is split only if that halves
    the comparisons at least and leaves no more than twice the items, so that a cluster too tight for its pivots isn't copied into all of them.

    Returns the items of the split cells, and the (cell) split; none if no cell is.
    """
    pivots = F.least(F.lit(64.0), F.ceil(2 * F.col("n") / cell_rows))
    big = big.select("cell", (F.floor(F.col("n") / cell_rows) + 1).cast("int").alias("salts"), (pivots / F.col("n")).alias("share"))
    own = items.join(big, "cell").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))
    chosen = own.filter(F.col("core") & (unit(F.xxhash64(F.lit(level), "cls")) < F.col("share")))
    chosen = renewed(stage(chosen.select("cell", "cls", "vec", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "embed-pivots"))

    def count(rows: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        out = {"cell": np.zeros(0, object), **{c: np.zeros(0, np.int64) for c in ("q", "cores", "n", "before_cores", "before")}}
        if len(rows) and len(at):
            at, core = at.sort_values("cls"), rows["core"].to_numpy()
            n, cores = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for i, q, home in _places(rows, at, eps):
                n += np.bincount(q, minlength=len(at))
                cores += np.bincount(q, core[i] & home, len(at)).astype(np.int64)
            first = np.arange(len(at)) == 0
            out = {"cell": np.full(len(at), rows["cell"].iloc[0], object), "q": np.arange(len(at)), "cores": cores, "n": n, "before_cores": first * core.sum(), "before": first * len(rows)}
        return pd.DataFrame(out)

    def deal(rows: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(at):
            for i, q, home in _places(rows, at := at.sort_values("cls"), eps):
                moved = rows.iloc[i]
                names = np.array([f"{c}.{level}.{x}" for c, x in zip(moved["cell"], q, strict=True)], object)
                out.append(pd.DataFrame({"cell": names, "core": moved["core"].to_numpy() & home, "cls": moved["cls"].to_numpy(), "mult": moved["mult"].to_numpy(), "vec": moved["vec"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, object) for c in ("cell", "core", "cls", "mult", "vec")})

    keys = ("cell", "salt")
    parts = own.groupBy(*keys).cogroup(chosen.groupBy(*keys)).applyInPandas(count, "cell string, q int, cores long, n long, before_cores long, before long")
    cells = parts.groupBy("cell", "q").agg(*[F.sum(c).alias(c) for c in ("cores", "n", "before_cores", "before")])
    work, before = F.sum(F.col("cores") * F.col("n").cast("double")), F.sum("before_cores") * F.sum("before").cast("double")
    good = cells.groupBy("cell").agg((2 * work <= before).alias("less"), (F.sum("n") <= 2 * F.sum("before")).alias("few")).filter("less and few").select("cell")
    good = stage(good, "embed-cells")
    if good.isEmpty():
        return None
    dealt = own.join(good, "cell").groupBy(*keys).cogroup(chosen.join(good, "cell").groupBy(*keys)).applyInPandas(deal, items.schema)
    return stage(dealt, "embed-items"), good


def _join_cells(items: DataFrame, cosine: float, block: int) -> DataFrame:
    """Per cell: (cls, n_links, root) of each core vector against all of the cell, and (cls, null, root) of guests linked.

    Cells with more rows than a block are compared block by block, so a group has two blocks at most; block is in numbers, so longer vectors
    make shorter blocks. Within one, linked vectors hang on the least of their part, so what comes out has a row a vector, not a row a link.
    """
    rows = F.greatest(F.lit(1), F.floor(F.lit(block) / F.max(F.size("vec"))))
    sizes = items.groupBy("cell").agg((F.floor(F.count(F.lit(1)) / rows) + 1).cast("int").alias("blocks"))
    dealt = items.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = dealt.filter("core").select("cell", F.col("own").alias("i"), F.explode(every).alias("j"), "cls", "vec")
    right = dealt.select("cell", F.explode(every).alias("i"), F.col("own").alias("j"), "cls", "mult", "vec")

    def compare(cores: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"cls": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if not len(cores) or not len(others):
            return empty
        a, b = matrix(cores["vec"]), matrix(others["vec"])
        ca, cb, mult = cores["cls"].to_numpy(), others["cls"].to_numpy(), others["mult"].to_numpy()
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        n = np.zeros(len(ca), np.int64)
        ids, flat = np.unique(np.concatenate([ca, cb]), return_inverse=True)
        root, touched, at, to = np.arange(len(ids)), np.zeros(len(ids), bool), flat[: len(ca)], flat[len(ca) :]
        for k in range(0, len(ca), 256):
            linked = (a[k : k + 256] @ b.T) / (na[k : k + 256, None] * nb) >= cosine
            linked &= ca[k : k + 256, None] != cb
            n[k : k + 256] = linked @ mult
            for i in np.flatnonzero(n[k : k + 256]):
                others = to[linked[i]]
                touched[others] = True
                met = root[others]
                least, own = met.min(), root[at[k + i]]
                if own != least or met.max() != least:
                    root[np.isin(root, np.append(met, own))] = min(least, own)
        linked_ids = np.flatnonzero(touched)
        return pd.concat([
            pd.DataFrame({"cls": ca, "n": n, "root": ids[root[at]]}),
            pd.DataFrame({"cls": ids[linked_ids], "n": np.zeros(len(linked_ids), np.int64), "root": ids[root[linked_ids]]}),
        ])

    return left.groupBy("cell", "i", "j").cogroup(renewed(right).groupBy("cell", "i", "j")).applyInPandas(compare, "cls long, n long, root long")


def near_vectors(
    df: DataFrame, cosine: float = 0.98, *, id: str = "vec_id", vector: str = "embedding", label: str | None = "label", cell_rows: int = 2048, block: int = 1 << 20, depth: int = 4
) -> DataFrame:
    """Per row: vec_id, n_links (rows linked directly), component_id (least id reachable), kept.

    Rows of equal label link at that cosine or more, in double precision. Equal vectors are first
    folded into one with their number, so a group of copies costs one vector. A label's vectors are split by pivots, cells with too many again,
    until a cell is small, a split wouldn't pay, or depth is reached; cells then join independently, in blocks of so many numbers. All links are found.

    A vector that is null or zero, or has a null or non-finite component, links with nothing, nor does
    a row whose label is null; vectors of other lengths are of other spaces. Such a row is kept, as its own
    component. A row with a null id counts as a link, but names no component. Rows with equal ids and vectors
    are rows of their own; an empty table gives an empty one.
    """
    eps = float(np.sqrt(2 - 2 * cosine))
    sound = usable(vector) & (F.col(label).isNotNull() if label else F.lit(True))
    of = F.concat_ws(":", F.size(vector), F.col(label).cast("string") if label else F.lit(""))
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id).alias("vec_id"), F.when(sound, of).alias("cell"), F.when(sound, v).alias("vec"))
    rows = rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})
    classes = rows.filter("cell is not null").groupBy("cell", "k1", "k2").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least"))
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()), "embed-classes")

    items = classes.select("cell", F.lit(True).alias("core"), "cls", "mult", "vec")
    done = []
    for level in range(depth):
        big = stage(items.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows), "embed-cells")
        split = None if big.isEmpty() else _split(items, big, cell_rows, eps, level)
        if split is None:
            break
        done.append(items.join(split[1], "cell", "left_anti"))
        items = split[0]
    for part in done:
        items = items.unionByName(part)

    found = stage(_join_cells(items, cosine, block), "embed-links")
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = components(found.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    per_class = classes.join(links, "cls", "left").join(roots.withColumnRenamed("id", "cls"), "cls", "left")
    per_class = per_class.select("cell", "k1", "k2", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    least = per_class.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = per_class.join(least, "root").select("cell", "k1", "k2", "n_links", "component_id")
    out = rows.select("vec_id", "cell", "k1", "k2").join(per_class, ["cell", "k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id").cast("bigint")
    return out.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
