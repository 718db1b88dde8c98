import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import packing, queries

from .conftest import ODD


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(queries.word_tokenizer())


def test_encoder_is_the_library(encoder, documents):
    random.seed(1)
    letters = "aA'sS tTdDéÉüß0½ \n\t.,!?-_#日🎉İΣ́\u00ad\x00\x1c\u3000"
    texts = ["", "don't we'll I'd 'tis ''s x'RE", "<|endoftext|> x", "É K ſ ①", *[t for _, t, _ in ODD if t], *[r.text for r in documents.limit(40).collect()]]
    texts += ["".join(random.choices(letters, k=random.randint(1, 40))) for _ in range(500)]
    assert encoder.known
    for text in texts:
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def stream(encoder, text):
    return np.array([*encoder.library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check(pieces, rows, encoder, length):
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for doc, text in rows:
        ids, at = stream(encoder, text), 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for k, own in sequences.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == length or k == len(sequences) - 1 and at < length


def test_pieces(documents, encoder):
    pieces = packing.pack(documents.repartition(3), queries.word_tokenizer(), length=512).collect()
    check(pieces, [(r.doc_id, r.text) for r in documents.collect()], encoder, 512)


def test_odd_rows(odd, none, encoder):
    pieces = packing.pack(odd, queries.word_tokenizer(), length=64)
    rows = [(r[0], r[1]) for r in ODD if r[0] != 4]
    whole = pieces.collect()
    check([p for p in whole], [], encoder, 64)
    for doc, text in rows:
        own = sorted((p for p in whole if p.doc_id == doc), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(stream(encoder, text))
    assert sum(p.length for p in whole if p.doc_id == 4) == 2 * len(stream(encoder, "same text in two rows of five"))
    assert packing.pack(none, queries.word_tokenizer()).count() == 0


def test_sequences_are_padded(documents, encoder):
    pieces = packing.pack(documents, queries.word_tokenizer(), length=4096, with_ids=True)
    rows = packing.sequences(pieces, length=4096, pad_id=0).orderBy("sequence_id").collect()
    ids = [x for r in rows for x in r.ids]
    want = sum(len(stream(encoder, r.text)) for r in documents.collect())
    assert all(len(r.ids) == 4096 for r in rows) and len(ids) - want < 4096
    few = packing.pack(documents.limit(0).unionByName(documents.sparkSession.createDataFrame([(1, "a b c", "en", "s", 5)], documents.schema)), queries.word_tokenizer(), with_ids=True)
    assert [len(r.ids) for r in packing.sequences(few).collect()] == [4]


def test_the_store_of_pieces_is_small():
    encoder = packing.WordEncoder(queries.word_tokenizer())
    texts = [" ".join(f"w{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}{chr(97 + n // 676 % 26)}{chr(97 + n // 17576 % 26)}" for n in range(at, at + 1000)) for at in range(0, 450_000, 1000)]
    first = [encoder.encode(t) for t in texts[:20]]
    for t in texts:
        encoder.encode(t)
    assert len(encoder.pieces) <= 301_000
    assert [encoder.encode(t) for t in texts[:20]] == first == [encoder._whole(t) for t in texts[:20]]
    assert encoder.encode(texts[400]) == encoder._whole(texts[400])
