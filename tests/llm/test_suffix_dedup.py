import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from sparkloom.llm import suffix_dedup
from sparkloom.llm.suffix_dedup import EnhancedSuffixArray

from .conftest import ODD


def by_hand(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + least] for b in data for i in range(len(b) - least + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(df, rows, **how):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(df, **how).collect())
    assert got == sorted((str(r[0]), *x) for r, x in zip(rows, by_hand([r[1] for r in rows], how.get("least", 200)), strict=True))


def test_maximal_repeats():
    strings = [b"xxabcabcdyy", b"zzabcabcdww", b"qqabcabceww", b"abcabc"]
    array = EnhancedSuffixArray(strings, np.zeros(4, np.int64), 3)
    found = {}
    for length, suffixes in array.repeats(3):
        key = bytes(array.data[suffixes[0] : suffixes[0] + length])
        found[key] = sorted(int(s) for s in suffixes)
        assert all(bytes(array.data[s : s + length]) == key for s in suffixes)
    whole = b"\x00".join(strings)
    want = {}
    for s in strings:
        for i in range(len(s)):
            for j in range(i + 3, len(s) + 1):
                sub = s[i:j]
                places = [k for k in range(len(whole)) if whole[k : k + len(sub)] == sub]
                ends = [p for p in places if sub.count(b"\x00") == 0]
                left = {whole[p - 1] if p and whole[p - 1] else -1 - p for p in ends}
                right = {whole[p + len(sub)] if p + len(sub) < len(whole) and whole[p + len(sub)] else -1 - p for p in ends}
                if len(ends) > 1 and len(left) > 1 and len(right) > 1:
                    want[sub] = len(ends)
    assert {k: len(v) for k, v in found.items()} == want


@pytest.mark.parametrize("how", [{}, {"suffix_rows": 1}, {"suffix_rows": 6}, {"suffix_rows": 1, "least": 64}, {"broadcast_rows": 0}])
def test_against_brute_force(make, how):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words, n))
    passages = [say(80) for _ in range(4)]
    texts = [say(int(rng.integers(1, 300))) for _ in range(40)]
    texts += [say(30) + passages[i % 4][: int(rng.integers(150, 400))] + say(40) + passages[(i + 1) % 4] for i in range(20)]
    texts += [texts[3], texts[3], "ab" * 300, "c" * 999, passages[0] + passages[0]]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    check(make(rows), rows, **how)


def test_long_texts_are_cut_without_loss(make):
    rng = np.random.default_rng(4)
    part = "".join(map(chr, rng.integers(97, 123, 300)))
    long = "".join(map(chr, rng.integers(97, 123, (1 << 20) + 5000)))
    at = (1 << 20) - 4096 - 150
    rows = [(1, long[:at] + part + long[at:], "s"), (2, part, "s")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(make(rows)).collect()}
    assert got == {1: (300, 1), 2: (300, 1)}


def test_least_has_bounds(make):
    for least in (63, 4098):
        with pytest.raises(ValueError, match="least"):
            suffix_dedup.remove_repeats(make([(1, "a", "s")]), least)


def test_odd_rows(odd, none):
    small = [r for r in ODD if r[0] != 7]
    check(odd.filter("doc_id is null or doc_id <> 7"), small)
    long = [r for r in suffix_dedup.remove_repeats(odd).collect() if r.doc_id == 7]
    assert (long[0].n_bytes, long[0].n_removed, long[0].n_spans) == (300000, 300000, 1)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_arrays_are_small_whatever_a_batch_holds(spark):
    rows = [(a, c, bytes([65 + a % 26]) * 9) for a in range(900) for c in range(1500 if a == 400 else a % 11 + 1)]
    members = spark.createDataFrame(rows, "anchor long, content long, bytes binary")

    def work(rows, array):
        return pd.DataFrame({"anchor": rows["anchor"].unique(), "rows": len(rows), "held": len(array.base)})

    found = suffix_dedup._by_anchor(members, 3, work, "anchor long, rows long, held long").collect()
    assert sorted(r.anchor for r in found) == list(range(900))  # each anchor as a whole in one array
    assert sum({(r.rows, r.held): r.rows for r in found if r.anchor == 400}.values()) == 1500
    assert all(r.rows == r.held <= 1000 for r in found if r.anchor != 400)


def test_memory_of_a_suffix_array():
    rng = np.random.default_rng(5)
    strings = [rng.integers(97, 123, 300, np.uint8).tobytes() for _ in range(1000)]
    tracemalloc.start()
    array = EnhancedSuffixArray(strings, np.zeros(1000, np.int64), 200)
    took, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert took < 60 * len(array.data) and most < 110 * len(array.data)
