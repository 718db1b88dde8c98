import pytest
from pyspark.sql import functions as F

from sparkloom.__main__ import main
from sparkloom.functions import metrics
from sparkloom.plans import prepare, specs
from sparkloom.sources import tables
from sparkloom.streaming import rows

TABLE = "/root/testdata/sf0.001/documents.parquet"


def test_registry():
    assert specs.REGISTRY.build("optimizer", "adamw", b1=0.8) == specs.AdamWSpec(b1=0.8)
    assert specs.PrepSpec().train_batch == 8 and specs.RunSpec().seed == 42
    with pytest.raises(ValueError):
        specs.REGISTRY.build("optimizer", "sgd")
    with pytest.raises(ValueError):
        specs.REGISTRY.build("optimizer", "adam", speed=1)


def test_compose():
    made = specs.compose("prepare", "dataset=local", "dataset.path=x", "optimizer=adam", "optimizer.b1=0.8", "data.workers=1", "data.workers=2")
    assert made["dataset"] == tables.LocalSource(path="x") and made["optimizer"] == specs.AdamSpec(b1=0.8) and made["data"].workers == 2
    assert isinstance(specs.compose("prepare")["optimizer"], specs.AdamWSpec)
    assert specs.compose("train-tokenizer", 'tokenizer.special_tokens=["<a>"]')["tokenizer"].special_tokens == ("<a>",)
    for wrong in ("logger=x", "data.speed=1", "dataset", "optimizer=sgd"):
        with pytest.raises(ValueError):
            specs.compose("prepare", wrong)


def test_loggers(spark, tmp_path, capsys):
    row = spark.sql("select 1 as step, 'loss' as name, 0.5 as value")
    metrics.TableLogger(str(tmp_path / "log")).log(row)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [(1, "loss", 0.5)]
    metrics.PrintLogger().log(row)
    assert "1 loss 0.5" in capsys.readouterr().out
    act = metrics.driver_only(lambda: 7)
    assert act() == 7 and spark.range(1).rdd.map(lambda _: act()).collect() == [None]


def test_tasks_are_prepared_by_their_own_sources(spark, tmp_path):
    spark.read.parquet(TABLE).filter("lang = 'en'").selectExpr("doc_id as id", "text as body").write.parquet(str(tmp_path / "en"))
    prepare.train_tokenizer(spark, specs.TokenizerTrainerSpec(TABLE, save_folder=str(tmp_path / "t")), specs.TokenizerSpec(vocab_size=300))
    source = tables.MultitaskSource({"all": tables.LocalSource(key="doc_id", path=TABLE), "en": tables.LocalSource(key="id", column="body", path=str(tmp_path / "en"))})
    prep, run = specs.PrepSpec(input_length=128), specs.RunSpec(output_dir=str(tmp_path / "o"))
    chunks = prepare.prepare(spark, source, str(tmp_path / "t"), prep, run)["train"]
    sizes = {r.task: r["count"] for r in chunks.groupBy("task").count().collect()}
    assert set(sizes) == {"all", "en"} and sizes["en"] == spark.read.parquet(str(tmp_path / "o/en/train")).count()
    out = prepare.epoch_batches(chunks, prep, tables.load_tokenizer(str(tmp_path / "t")))
    first = out.filter("batch_id = 0").orderBy("pos").select("task").collect()
    assert [r.task for r in first] == ["all", "en"] * 4 and out.count() == sum(sizes.values()) // 8 * 8
    with pytest.raises(ValueError):
        prepare.prepare(spark, tables.MultitaskSource(), str(tmp_path / "t"))


def test_both_runs(spark, tmp_path):
    main(["train-tokenizer", "--table", TABLE, "--vocab-size", "400", "--out", str(tmp_path / "t")])
    model = tables.load_tokenizer(str(tmp_path / "t"))
    assert model.vocabulary["<extra_id_0>"] == 400
    main(["prepare", "--table", TABLE, "--key", "doc_id", "--tokenizer", str(tmp_path / "t"), "--input-length", "128", "--epochs", "2", "--devices", "2", "--out", str(tmp_path / "o")])
    written = spark.read.parquet(str(tmp_path / "o/batches/train"))
    assert {r.epoch: r["count"] for r in written.groupBy("epoch").count().collect()}.keys() == {0, 1} and {"device_id", "labels"} <= set(written.columns)
    assert spark.read.parquet(str(tmp_path / "o/batches/validation")).select("epoch").distinct().count() == 1
    train = spark.read.parquet(str(tmp_path / "o/train"))
    assert train.filter(F.size("input_ids") != 141).count() == 0 and train.count() > 100
    prep = specs.PrepSpec(input_length=128, devices=2)
    first = prepare.epoch_batches(train, prep, model)
    widths = first.select(F.size("input_ids"), F.size("labels")).distinct().collect()
    assert [tuple(w) for w in widths] == [(128, 29)] and first.count() == train.count() // 16 * 16
    again = prepare.epoch_batches(train, prep, model, epoch=1)
    assert first.select("chunk", "input_ids").exceptAll(again.select("chunk", "input_ids")).count() > 0


def test_limits_hold_twice(spark, tmp_path):
    model = prepare.train_tokenizer(spark, specs.TokenizerTrainerSpec(TABLE, save_folder=str(tmp_path / "t")), specs.TokenizerSpec(vocab_size=300))
    source = tables.LocalSource(key="doc_id", path=TABLE)
    docs = spark.read.parquet(TABLE)
    whole = prepare.segments(docs, model, source, specs.PrepSpec(input_length=128)).count()
    half = prepare.segments(docs, model, source, specs.PrepSpec(input_length=128), size=0.5)
    assert whole / 8 < half.count() < whole / 2 and half.select("chunk").distinct().count() == half.count()


def test_row_functions_on_a_stream(spark, tmp_path):
    spark.range(3).select(F.lit("a  b").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string").parquet(str(tmp_path / "in"))
    rows.run(rows.apply(stream, "normalize", "t"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.t for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a b"}
    with pytest.raises(ValueError):
        rows.apply(stream, "shuffle", "t")
