import re
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from sparkloom.llm import minhash
from sparkloom.llm.minhash import Bands, band_keys, shingles, signature

from .conftest import ODD


def runs(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def classes(rows, similarity=0.8):
    """Least id of each row's class, by comparing all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [runs(t) if t is not None else Counter() for _, t, _ in rows]
    for a, b in combinations(range(len(rows)), 2):
        ta, tb = rows[a][1], rows[b][1]
        if ta is None or tb is None:
            continue
        both = (sets[a] & sets[b]).total()
        if ta == tb or both and both >= similarity * (sets[a] | sets[b]).total():
            parent[find(a)] = find(b)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return [least.get(find(i)) for i in range(len(rows))]


def test_shingles_are_those_of_words():
    for text in ("The quick, brown fox jumps over the lazy dog. " * 3, "a b", "", "É a-b_c d e f É A B C D E", "!!"):
        found, times = shingles(text.encode())
        assert len(found) == len(runs(text)) and (not len(found) or times.sum() >= len(found))
    assert (shingles(b"A b c d e f")[0] == shingles(b"a, B\nc d (e) f!")[0]).all()
    assert not set(shingles(b"ab c d e f")[0]) & set(shingles(b"a bc d e f")[0])


@pytest.mark.parametrize("n", [1, 20, 400, 5000])
def test_signatures_estimate_similarity(n):
    rng, bands, errors = np.random.default_rng(n), Bands(), []
    for _ in range(20):
        all_ = rng.integers(0, 1 << 62, n + n // 4).astype(np.uint64)
        a, b = np.sort(all_[:n]), np.sort(all_[n // 4 :])
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((signature(a, np.ones(len(a)), bands) == signature(b, np.ones(len(b)), bands)).mean() - real)
    assert abs(np.mean(errors)) < 0.03


def test_weights_count():
    rng, bands = np.random.default_rng(1), Bands()
    errors = []
    for _ in range(20):
        e = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        a, b = rng.uniform(0.2, 3.0, 300), rng.uniform(0.2, 3.0, 300)
        real = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append((signature(e, a, bands) == signature(e, b, bands)).mean() - real)
    assert abs(np.mean(errors)) < 0.03


def test_occurrences_weigh():
    text = "a b c d e a b c d e a b c d e x"
    found, times = shingles(text.encode())
    numbered = minhash.occurrences(found, times)
    assert len(numbered) == len(set(numbered.tolist())) == runs(text).total() and set(found.tolist()) <= set(numbered.tolist())


@pytest.mark.parametrize("scale", [5e-4, 1.0, 3e5])
def test_weights_of_any_scale(scale):
    rng, bands = np.random.default_rng(4), Bands()
    e = np.sort(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    a, b = rng.uniform(0.5, 1.0, 400) * scale, rng.uniform(0.5, 1.0, 400) * scale
    tracemalloc.start()
    same = (signature(e, a, bands) == signature(e, b, bands)).mean()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and abs(same - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.12
    assert (signature(e, np.zeros(400), bands) == 0).all()
    same_unit = signature(e, a, Bands(unit=scale))
    assert (same_unit == signature(e, a / scale, bands)).all()


def test_similar_sets_share_a_band():
    rng, bands = np.random.default_rng(2), Bands()
    for _ in range(200):
        all_ = rng.integers(0, 1 << 62, 110).astype(np.uint64)
        a, b = np.sort(all_[:99]), np.sort(all_[11:])
        assert set(band_keys(signature(a, np.ones(len(a)), bands), bands)) & set(band_keys(signature(b, np.ones(len(b)), bands), bands))


def edited(words, k, rng):
    out = list(words)
    for i in rng.choice(len(out), k, replace=False):
        out[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def test_classes_against_brute_force(make):
    rng = np.random.default_rng(5)
    rows = []
    for group in range(6):
        words = [f"w{x}" for x in rng.integers(0, 1 << 20, 120)]
        rows += [(len(rows) + i, edited(words, int(rng.integers(0, 5)), rng), "s") for i in range(12)]
    passage = [f"p{x}" for x in range(60)]
    rows += [(len(rows) + i, " ".join(passage + [f"q{i}_{j}" for j in range(40)]), "s") for i in range(30)]
    rows += [(500 + i, rows[i][1], "s") for i in range(10)]
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(make(rows)).collect()}
    want = dict(zip((r[0] for r in rows), classes(rows), strict=True))
    assert {k: v[0] for k, v in got.items()} == want
    assert {k for k, v in got.items() if v[1]} == set(want.values())
    for how in ({"broadcast_rows": 0}, {"exact": True}, {"orders": minhash.Orders(whole=4)}):
        again = minhash.near_duplicates(make(rows), **how)
        assert {r.doc_id: r.class_id for r in again.collect()} == want, how


def test_near_copies_of_an_absent_text(make, monkeypatch):
    """Each differs from the same text in 2 to 4 words: each is checked against a few dozen at most, and links at the similarity stay in a class."""
    rng, checked, plain = np.random.default_rng(7), {}, minhash._linked
    words = [f"w{x}" for x in rng.integers(0, 1 << 20, 120)]
    for m in (500, 2000):
        rows = [(i, edited(words, int(rng.integers(2, 5)), rng), "s") for i in range(m)]

        def counted(pairs, sets, similarity, m=m):
            checked[m] = checked.get(m, 0) + pairs.count()
            return plain(pairs, sets, similarity)

        monkeypatch.setattr(minhash, "_linked", counted)
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make(rows)).collect()}
        sets = [set(runs(t)) for _, t, _ in rows]
        element = {e: k for k, e in enumerate({e for s in sets for e in s})}
        table = np.zeros((m, len(element)), np.float32)
        for i, s in enumerate(sets):
            table[i, [element[e] for e in s]] = 1
        both, size = table @ table.T, table.sum(1)
        a, b = np.nonzero(np.triu(both >= 0.8 * (size[:, None] + size - both) - 1e-6, 1))
        together = np.mean([got[x] == got[y] for x, y in zip(a, b, strict=True)])
        assert len(a) > 100 and together >= 0.99, (m, len(a), together)
    assert all(n < 50 * m for m, n in checked.items()), checked  # all pairs: 500 and 2000 halved a text


def needles(rng, decoys):
    """Texts with 4 words of one text replaced, of which each two have one place 4 words apart, so that the runs they lack have one in common: just enough for a link; and decoys with 7."""
    words, texts = [f"w{x}" for x in rng.integers(0, 1 << 40, 360)], []

    def replaced(places):
        return " ".join(f"new{rng.integers(1 << 40)}" if k in places else w for k, w in enumerate(words))

    for p in range(6, 320, 40):
        texts += [replaced({p, p + 10, p + 15, p + 20}), replaced({p + 4, p + 25, p + 30, p + 35})]
    return texts + [replaced(set((5 + rng.integers(5) + 5 * rng.choice(69, 7, replace=False)).tolist())) for _ in range(decoys)]


def linked_in_a_band(rows, bands):
    """Least id of each row's class, of links between texts that share a band."""
    parts = [shingles(t.encode()) for _, t, _ in rows]
    keys = np.stack([band_keys(signature(*p, bands), bands) for p in parts])
    element = {e: k for k, e in enumerate(np.unique(np.concatenate([p[0] for p in parts])).tolist())}
    table = np.zeros((len(rows), len(element)), np.float32)
    for i, (found, times) in enumerate(parts):
        assert times.max() == 1
        table[i, [element[e] for e in found.tolist()]] = 1
    both, size = table @ table.T, table.sum(1)
    linked = (both >= 0.8 * (size[:, None] + size - both) - 1e-6) & (keys[:, None] == keys[None]).any(2)
    a, b = np.nonzero(linked)
    least = np.array([r[0] for r in rows])
    while (least[a] != least[b]).any():
        np.minimum.at(least, a, least[b])
    return dict(zip((r[0] for r in rows), least.tolist(), strict=True)), len(a) - len(rows)


@pytest.mark.parametrize("how", [{}, {"tile": 40}, {"elements": 500}, {"looked_at": 1, "tile": 30}])
def test_no_link_in_a_bucket_is_missed(make, how):
    """A single band makes one large bucket a text; each link in it must be found, however many texts that aren't linked are as near."""
    rng, bands = np.random.default_rng(3), Bands(1, 1, 1)
    rows = [(1000 * g + i, t, "s") for g in range(2) for i, t in enumerate(needles(rng, 150))]
    want, links = linked_in_a_band(rows, bands)
    assert links >= 16
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(make(rows), bands=bands, orders=minhash.Orders(**how)).collect()} == want


def test_odd_rows(odd, none):
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(odd).collect())
    assert got == Counter(zip((r[0] for r in ODD), (c if c is not None else r[0] for c, r in zip(classes(ODD), ODD, strict=True)), strict=True))
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "8", "9", "None"]
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(none).count() == 0
