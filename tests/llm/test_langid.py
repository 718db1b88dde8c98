import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import langid
from sparkloom.llm.langid import Settings


@pytest.fixture(scope="module")
def filters(documents):
    return langid.fit(langid.training_rows(documents))


def test_split_is_by_the_id(documents):
    kept = {r.doc_id for r in langid.training_rows(documents).collect()}
    assert kept == {r.doc_id for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}


def test_held_out_accuracy(documents, filters):
    out = langid.identify(documents.filter(langid.remainder(F.col("doc_id")) == 1), filters)
    rows = out.collect()
    assert len(rows) > 30 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_filters_hold_all_members_and_few_others():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 40, 20000).astype(np.uint64)
    members = np.zeros((20000, 10), np.int64)
    members[np.arange(20000), rng.integers(0, 10, 20000)] = 1
    f = langid.Filters([f"l{i}" for i in range(10)], codes, members, Settings(slot_bits=16))
    slots = f._slots(codes)
    for lang in range(10):
        plane, bit = divmod(lang, 8)
        found = (f.slots[plane][slots[0]] & f.slots[plane][slots[1]]) >> bit & 1
        assert found[members[:, lang] == 1].all()
        assert np.mean(found[members[:, lang] == 0]) == pytest.approx(f.false_rate[lang], abs=0.02)


def test_odd_rows(odd, none, filters):
    rows = {(r.doc_id, r.text): r for r in langid.identify(odd, filters).collect()}
    assert {k[0]: r.lang_pred for k, r in rows.items() if k[0] in (1, 2, 3, 9)} == {1: "und", 2: "und", 3: "und", 9: "und"}
    assert all(r.lang_pred in (*filters.languages, "und") and 0 <= r.score <= 1 for r in rows.values())
    assert next(r for k, r in rows.items() if k[0] == 8).lang_pred in filters.languages
    assert langid.identify(none, filters).count() == 0
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(odd, filters).columns == [*odd.columns, "lang_pred", "score"]


def test_a_long_text_counts_whole(spark, filters, documents):
    fr = " ".join(r.text for r in documents.filter("lang = 'fr'").collect())
    en = next(r.text for r in documents.filter("lang = 'en'").collect())
    df = spark.createDataFrame([(en + fr * 10,)], "text string")
    assert langid.identify(df, filters).first().lang_pred == "fr"


def test_memory_of_a_prediction(filters):
    texts = ["Long texts are read a bounded part at a time. " * 70] * 500
    tracemalloc.start()
    filters.predict(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
