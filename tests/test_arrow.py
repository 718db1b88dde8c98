import numpy as np
import pyarrow as pa

from sparkloom.functions import arrow
from sparkloom.operators import merging


def test_parts_are_bounded_and_whole():
    texts = pa.array(["x" * (i % 70) for i in range(500)] + [None, "y" * 9999, ""])
    cut = list(arrow.parts(texts, 1000))
    assert pa.concat_arrays(cut).equals(texts) and all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= 1000 for p in cut)
    lists = pa.array([["a"] * (i % 9) for i in range(300)] + [None, []])
    assert pa.concat_arrays(list(arrow.parts(lists, 400))).equals(lists) and len(list(arrow.parts(lists, 400))) > 10
    assert arrow.PART <= 1 << 20 and merging.BLOCK <= 1_000_000


def test_each_value_is_looked_up_once_and_few_are_kept():
    asked = []
    find = arrow.kept(lambda v: asked.append(v) or len(v), 2)
    for _ in range(2):
        indices, table = arrow.by_value(pa.array(["a", "bb", "a", "ccc", "bb"]), find)
        assert [table[i] for i in indices] == [1, 2, 1, 3, 2]
    assert asked == [b"a", b"bb", b"ccc", b"ccc"]


def test_runs_are_spread():
    offsets, values = arrow.spread(np.array([0, 2, 2, 3]), np.array([1, 0, 1]), np.array([0, 2]), np.array([7, 8], np.int32), [1])
    assert offsets.tolist() == [0, 3, 4, 7] and values.tolist() == [7, 8, 1, 1, 7, 8, 1]
