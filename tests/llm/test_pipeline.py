import zlib

import numpy as np

import corpus_pipeline
from sparkloom.llm import langid, minhash, packing, queries

from .conftest import ODD
from .test_line_dedup import by_hand
from .test_minhash import classes, linked_in_a_band, needles


def test_stages_by_hand(spark, documents, tmp_path):
    """Each stage on what the one before it wrote, against brute force on its own input."""
    docs = documents.limit(150)
    written = []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, "")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == documents.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        written.append(docs.collect())
    known, lines, near, mixed, packed = written
    clean = {r.doc_id for r in documents.limit(150).collect() if any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in known} == clean
    rows = [(r.doc_id, r.text, r.source) for r in known]
    assert {(r.doc_id, r.source, r.text) for r in lines} == set(by_hand(rows, queries.LINE_RATIO, queries.LINE_MIN_PAGES))
    assert all(r.n_chars == len(r.text) for r in lines)
    rows = [(r.doc_id, r.text, r.source) for r in lines]
    assert sorted(r.doc_id for r in near) == sorted(set(classes(rows)))
    texts = {r.doc_id: r.text for r in near}
    assert all(texts[r.doc_id].startswith(r.text) for r in mixed)  # a copy taken in part is cut
    assert len({(r.doc_id, r.text) for r in mixed if r.text != texts[r.doc_id]}) <= len({r.source for r in mixed})
    encoder = packing.WordEncoder(queries.word_tokenizer())
    ids = {(r.doc_id, r.text): np.array([*encoder.library.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in mixed}
    assert sum(p.length for p in packed) == sum(len(ids[r.doc_id, r.text]) for r in mixed)
    of = {}
    for (d, _), x in ids.items():
        of.setdefault(d, []).append(x)
    assert all(any(p.ids_crc32 == zlib.crc32(x[p.start : p.start + p.length].tobytes()) and len(x) == p.doc_tokens for x in of[p.doc_id]) for p in packed)


def test_near_dedup_misses_no_link_in_a_bucket(spark, make, monkeypatch):
    """One row of each class stays, with a single band, which makes one large bucket of each group's texts."""
    bands = minhash.Bands(1, 1, 1)
    monkeypatch.setitem(minhash.near_classes.__kwdefaults__, "bands", bands)
    rng = np.random.default_rng(3)
    rows = [(1000 * g + i, t, "s") for g in range(2) for i, t in enumerate(needles(rng, 150))]
    want, _ = linked_in_a_band(rows, bands)
    kept = corpus_pipeline.drop_near_duplicates(spark, make(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_odd_rows_pass_all_stages(spark, odd, none, tmp_path):
    docs = odd.withColumn("lang", langid.F.lit("en"))
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, "")
    assert docs.count() > 0
    docs = none
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, "")
    assert docs.count() == 0
    assert len(ODD)
