"""How often the pipeline's stages shuffle texts, with joins that are only broadcast on demand."""

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import minhash


@pytest.fixture()
def shuffled(spark):
    """MB that running a stage shuffles."""
    sc = spark.sparkContext
    jvm, context = sc._jvm, sc._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    def run(make):
        before = written()
        make().write.format("noop").mode("overwrite").save()
        return sum(n for k, n in written().items() if k not in before) / 1e6

    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield run
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


@pytest.fixture()
def long_texts(make, spark, tmp_path):
    """Different texts of 16 KB, one of ten in two rows."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(map(str, rng.integers(1 << 40, size=1250))), f"s{i % 3}") for i in range(300)]
    make(rows + [(1000 + i, t, s) for i, t, s in rows[::10]]).write.parquet(str(tmp_path / "long"))
    return spark.read.parquet(str(tmp_path / "long"))


def test_mixing_shuffles_texts_twice(spark, long_texts, shuffled):
    once = shuffled(lambda: long_texts.repartition(4, "doc_id"))
    assert shuffled(lambda: corpus_pipeline.mix_sources(spark, long_texts, "")) < 2.5 * once


def test_near_dedup_leaves_kept_texts_in_place(spark, long_texts, shuffled):
    once = shuffled(lambda: long_texts.repartition(4, "doc_id"))
    assert shuffled(lambda: corpus_pipeline.drop_near_duplicates(spark, long_texts, "")) < once
    kept = corpus_pipeline.drop_near_duplicates(spark, long_texts, "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(300))


def test_marks_without_room_change_nothing(make, monkeypatch):
    """All rows share a few marks: rows that stay are marked by chance, and are joined exactly; so are repeated ids, null ids and texts."""
    rows = [(i % 40 or None, f"text number {i % 50} of a few, no two alike: {i % 50}", "s") for i in range(200)] + [(7, None, "s")] * 2
    def ids(df):
        return sorted((r.doc_id or 0, r.text or "") for r in df.collect())

    want = ids(minhash.drop_near_duplicates(make(rows)))
    assert len(want) == 52 and len(set(want)) == 51
    monkeypatch.setattr(minhash, "_marks", lambda rows, f=minhash._marks: f(rows, 8))
    assert ids(minhash.drop_near_duplicates(make(rows))) == want
