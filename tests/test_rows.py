import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import metrics
from sparkloom.operators import batching, ordering, splits
from sparkloom.sources import tables


def test_numbers_are_global(spark):
    df = spark.range(10000).select((F.col("id") * 37 % 10007 - 500).alias("k"))
    for n in (1, 8, 50):
        rows = ordering.number(df.repartition(n), F.col("k")).orderBy("k").collect()
        assert [r.rn for r in rows] == list(range(1, 10001))


def test_number_with_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None,), (5,), (3,)], "k long")
    assert {r.k: r.rn for r in ordering.number(df, F.col("k")).collect()} == {None: 1, 3: 2, 5: 3}
    assert ordering.number(df.limit(0), F.col("k")).count() == 0


@pytest.mark.parametrize("kind", ["sparse", "negative", "repeated", "nulls", "text ties"])
def test_slices_follow_rows_not_values(spark, kind, monkeypatch):
    """Any key is cut into about as many slices as rows call for, and numbers are those of a sort."""
    n = 6000
    key = {"sparse": lambda i: i * 1_000_003, "negative": lambda i: -(i**3), "repeated": lambda i: i % 3 if i % 2 else 7, "nulls": lambda i: None if i % 3 else i, "text ties": lambda i: i % 5}[kind]
    rows = [(key(i), f"t{i * 7919 % n:05}", i, "kept") for i in range(n)]
    df = spark.createDataFrame(rows, "k long, t string, id long, __at string").repartition(5)
    seen, plain = [], ordering._sliced

    def noted(keyed, columns, at, then, slice_of, by, name, names):
        seen.append([r["count"] for r in keyed.groupBy(slice_of.alias("s")).count().collect()])
        return plain(keyed, columns, at, then, slice_of, by, name, names)

    monkeypatch.setattr(ordering, "_sliced", noted)
    tie = F.col("t") if kind == "text ties" else None
    out = ordering.number(df, F.col("k"), tie=tie, slice_rows=50)
    got = out.orderBy("rn").collect()
    assert out.columns == [*df.columns, "rn"] and {r["__at"] for r in got} == {"kept"}
    assert [r.rn for r in got] == list(range(1, n + 1)) and len({r.id for r in got}) == n
    order = [(r.k is not None, r.k or 0, r.t if tie is not None else "") for r in got]
    assert order == sorted(order)
    assert len(seen[0]) <= n / 50 + 1 and len(seen[0]) > 60 and max(seen[0]) < 400
    again = ordering.number(df.repartition(3), F.col("k"), tie=tie, slice_rows=50)
    assert {r.id: r.rn for r in again.collect()} == {r.id: r.rn for r in got}
    hashed = ordering.number_by_hash(df, F.col("id"), 1, slice_rows=50).collect()
    assert sorted(r.rn for r in hashed) == list(range(1, n + 1)) and len(seen[-1]) > 60 and max(seen[-1]) < 200
    by = ordering.number(df.withColumn("g", F.col("id") % 2), F.col("k"), by=("g",), slice_rows=50).collect()
    assert all(sorted(r.rn for r in by if r.g == g) == list(range(1, n // 2 + 1)) for g in (0, 1))


def test_prefix_and_random_split(spark):
    df = spark.range(200)
    counts = {r.split: r["count"] for r in splits.split_prefix(df, 0.05, "id").groupBy("split").count().collect()}
    assert counts == {"validation": 10, "train": 190}
    assert splits.percent(0.29) == 28
    counts = {r.split: r["count"] for r in splits.split_random(df, 0.031, "id").groupBy("split").count().collect()}
    assert counts == {"validation": 7, "train": 193} and splits.train_test_counts(200, 0.031) == (193, 7)


def test_subsets_repeat_rows(spark):
    drawn = splits.select_subset(spark.range(50), 0.9, "id", seed=1)
    assert drawn.count() == 45 and drawn.select("id").distinct().count() < 45
    assert splits.select_subset(spark.range(50), 80, "id").count() == 50
    assert splits.select_subset(spark.range(0), 0.5, "id").count() == 0
    assert splits.limit(spark.range(50), 1, "id").count() == 50


def test_epochs_differ_and_partitions_do_not(spark):
    df = spark.range(100)
    first = {r.id: r.rank for r in splits.shuffle(df, "id", seed=3).collect()}
    assert first == {r.id: r.rank for r in splits.shuffle(df.repartition(9), "id", seed=3).collect()}
    assert first != {r.id: r.rank for r in splits.shuffle(df, "id", seed=3, epoch=1).collect()}
    assert sorted(first.values()) == list(range(100))


def test_worker_shards(spark):
    rows = batching.iterate(spark.range(100), "id", 8, workers=3).groupBy("worker_id").agg(F.collect_set("batch_id").alias("b")).collect()
    assert {r.worker_id: sorted(r.b) for r in rows} == {0: [0, 1, 2, 3, 4], 1: [5, 6, 7, 8, 9], 2: [10, 11, 12]}
    assert batching.iterate(spark.range(100), "id", 8, drop_last=True).count() == 96


def test_round_robin(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("B", 1), ("C", 1), ("C", 2)], "t string, k long")
    rows = batching.round_robin(df, "t", "k").orderBy("place").collect()
    assert [f"{r.t}{r.k}" for r in rows] == ["A1", "B1", "C1", "A2", "C2", "A3"]
    assert [r.place for r in rows] == list(range(6))


def test_limited_tasks_declare_more_than_they_have(spark):
    df = spark.createDataFrame([("A",)] * 10 + [("B",)], "t string")
    rows = {r.t: (r.size, r.declared, r.actual) for r in batching.task_counts(df, "t", limit=8).collect()}
    assert rows == {"A": (10, 4, 4), "B": (1, 4, 1)}


def test_stack_and_flatten(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (1, "b", 3)], "r int, name string, value int")
    assert {r.name: r["values"] for r in batching.stack_mappings(df, "r", "name", "value").collect()} == {"a": [1, 2], "b": [None, 3]}
    zipped = batching.zip_longest(spark.createDataFrame([([1, 2], [3])], "x array<int>, y array<int>"), "x", "y")
    assert [r[0] for r in zipped.orderBy("pos").select(batching.without_nulls("x", "y")).collect()] == ['{"x":1,"y":3}', '{"x":2}']


def test_loader_and_datasets(spark):
    df = batching.dataset([spark.range(5), spark.range(100, 103)], "id", 2)
    assert sum(len(b["id"]) for b in batching.dataloader(df, "id")) == 8
    assert batching.dataset([spark.range(5)], "id", 2).count() == 5
    with pytest.raises(ValueError):
        batching.device_of(F.lit(0) if spark else None, 9, 2)


def rate(spark, kind, step, **how):
    return spark.range(1).select(metrics.schedule(kind, F.lit(step), **how)).first()[0]


def test_schedules(spark):
    how = {"rate": 0.01, "steps": 110, "warmup": 10}
    for step, want in ((0, 0), (5, 0.005), (10, 0.01), (60, 0.005), (110, 0), (200, 0)):
        assert rate(spark, "linear", step, **how) == pytest.approx(want)
    assert rate(spark, "inverse_sqrt", 40, **how) == pytest.approx(0.005)
    assert rate(spark, "inverse_sqrt", 3, rate=0.01, steps=10) == 0 and math.isnan(rate(spark, "inverse_sqrt", 0, rate=0.01, steps=10))
    assert rate(spark, "constant", 7, **how) == pytest.approx(0.007) and rate(spark, "constant", 50, **how) == 0.01
    with pytest.raises(ValueError):
        metrics.schedule("cosine", F.lit(1))
    with pytest.raises(ValueError):
        metrics.linear(F.lit(1), None, 10)
    with pytest.raises(ValueError):
        metrics.linear(F.lit(1), 0.1, None)


def test_losses(spark):
    df = spark.createDataFrame([([0.0, 0.0], 1), ([1000.0, 0.0], 1), ([1.0, 1.0], 0)], "x array<double>, y int")
    losses = [r[0] for r in df.select(metrics.cross_entropy(F.col("x"), F.col("y"))).collect()]
    assert losses == pytest.approx([math.log(2), 1000, math.log(2)])
    assert [r[0] for r in df.select(metrics.perplexity(metrics.cross_entropy(F.col("x"), F.col("y")))).collect()] == pytest.approx([2, metrics.MOST, 2])
    assert [r[0] for r in df.select(metrics.argmax(F.col("x"))).collect()] == [0, 0, 0]


def test_metric_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "loss", 2.0)], "step int, name string, value double")
    for _ in range(2):
        metrics.append_metrics(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    filled = metrics.back_fill(spark.createDataFrame([(10, [1.0, 2.0])], "s int, m array<double>"), "s", "m")
    assert sorted(map(tuple, filled.collect())) == [(9, 1.0), (10, 2.0)]


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.col("id").alias("row_id"), F.lit("x").alias("text")).write.parquet(path)
    local = tables.load(spark, tables.LocalSource(path=path))
    assert local.filter("split = 'validation'").count() == 5
    named = tables.load(spark, tables.NamedSource(name=path, train_limit=0.5))
    assert named.filter("split = 'train'").count() == 47
    both = tables.load(spark, tables.MultitaskSource({"a": tables.LocalSource(path=path), "b": tables.NamedSource(name=path)}))
    assert both.groupBy("task").count().count() == 2
    with pytest.raises(ValueError):
        tables.load(spark, tables.Source())
    with pytest.raises(ValueError):
        tables.training_texts(spark)
    (tmp_path / "f.txt").write_text("a\nb\n")
    assert tables.training_texts(spark, files=str(tmp_path / "f.txt")).count() == 2
    assert tables.training_texts(spark, path=path, files="nowhere").count() == 100
    stored = tables.cached(spark.range(3), str(tmp_path / "c"))
    assert stored.count() == tables.cached(spark.range(9), str(tmp_path / "c")).count() == 3
    assert tables.cached(spark.range(9), str(tmp_path / "c"), overwrite=True).count() == 9
