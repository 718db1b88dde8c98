import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing

from .conftest import ODD


def fill(sizes, weights, cap):
    """Targets by sharing the excess anew until none is above its cap."""
    total, target, capped = sum(sizes), [0.0] * len(sizes), set()
    left = float(total)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        w = sum(weights[i % len(weights)] for i in free)
        for i in free:
            target[i] = left * weights[i % len(weights)] / w
        over = [i for i in free if target[i] > cap * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = cap * sizes[i]
            capped.add(i)
        left = total - sum(target[i] for i in capped)


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 100], [1, 1, 100, 3, 50], [7], [0, 5]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}" if i < len(sizes) - 1 else None, s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r["rank"]: r.target for r in mixing.targets(df, mixing.Recipe()).collect()}
    assert [got[i] for i in range(len(sizes))] == pytest.approx(fill(sizes, (5, 2, 1), 3))


def test_plan(documents):
    rows = mixing.mix_plan(documents).collect()
    per = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in rows:
        assert r.mix_size == len(re.findall("[^\x20\x09-\x0d]+", r.text)) and r.mix_taken == sum(r.mix_lengths) <= 3 * r.mix_size and len(r.mix_positions) == len(r.mix_lengths) <= 3
        assert all(0 <= p <= 1 for p in r.mix_positions) and r.mix_positions == sorted(r.mix_positions)
        s = per[r.source]
        s[0] += r.mix_size
        s[1] += r.mix_taken
        s[2], s[3] = r.mix_target, max(s[3], r.mix_size)
    names = sorted(per)
    assert [per[n][2] for n in names] == pytest.approx(fill([per[n][0] for n in names], (5, 2, 1), 3))
    assert all(abs(per[n][1] - per[n][2]) <= 0.5 for n in names)


def test_positions_by_hand(spark):
    """Sources of 1, 10 and 50 rows and a null one: words taken and times against a walk over every word."""
    rows = [(i, " ".join(["w"] * (i % 7)), f"s{s}" if s else None) for i, s in enumerate([1] + [2] * 10 + [3] * 50 + [0] * 30)]
    rows[0] = (0, "a b  c\nd e", "s1")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    recipe = mixing.Recipe()
    got = {r.doc_id: r for r in mixing.mix_plan(df, recipe).collect()}
    order = {r.doc_id: r.o for r in df.select("doc_id", F.xxhash64(F.lit(recipe.seed), "doc_id", "text").alias("o")).collect()}
    names = ["s1", "s2", "s3", None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in names]
    wanted = fill(sizes, recipe.weights, recipe.cap)

    def when(share, knots):
        fine = [(x / 20000, knots_at(knots, x / 20000)) for x in range(20001)]
        total = sum((a + b) / 2 for (_, a), (_, b) in zip(fine, fine[1:], strict=False))
        so_far = 0.0
        for (_, a), (x, b) in zip(fine, fine[1:], strict=False):
            so_far += (a + b) / 2
            if so_far >= share * total:
                return x
        return 1.0

    def knots_at(knots, x):
        (p, a), (q, b) = next((u, v) for u, v in zip(knots, knots[1:], strict=False) if u[0] <= x <= v[0])
        return a + (b - a) * (x - p) / (q - p)

    for k, name in enumerate(names):
        own = sorted((i for i, _, s in rows if s == name), key=lambda i: order[i] % 2**64)
        stream = [(i, e) for e in range(3) for i in own for _ in range(len(rows[i][1].split()))][: round(wanted[k])]
        taken = {}
        for place, key in enumerate(stream):
            taken.setdefault(key, []).append(place)
        for i in own:
            copies = [taken[i, e] for e in range(3) if (i, e) in taken]
            if not rows[i][1]:
                continue
            assert got[i].mix_lengths == [len(c) for c in copies] and got[i].mix_taken == sum(map(len, copies))
            for at, c in zip(got[i].mix_positions, copies, strict=True):
                assert at == pytest.approx(when((c[0] + len(c) / 2) / wanted[k], recipe.schedules[k % 3]), abs=2e-4)
        assert abs(len(stream) - wanted[k]) <= 0.5
    mixed = mixing.mix(df, recipe, position="at").collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.mix_taken for r in got.values())
    cut = [r for r in mixed if r.text != rows[r.doc_id][1]]
    assert len(cut) <= 4 and all(rows[r.doc_id][1].startswith(r.text) for r in cut)


def test_reruns_and_partitions_agree(documents):
    first = sorted((r.doc_id, r.mix_positions) for r in mixing.mix_plan(documents).collect())
    assert first == sorted((r.doc_id, r.mix_positions) for r in mixing.mix_plan(documents.repartition(7)).collect())


def test_mix_is_ordered_and_follows_the_schedule(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    recipe = mixing.Recipe(weights=(1.0, 1.0), schedules=(((0.0, 2.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0))))
    rows = mixing.mix(df, recipe, position="at").collect()
    assert len(rows) == 4000 and [r["at"] for r in rows] == sorted(r["at"] for r in rows)
    early = sum(r["at"] < 0.5 for r in rows if r.source == "x") / 2000
    assert early == pytest.approx(0.75, abs=0.01)
    assert sum(r["at"] < 0.5 for r in rows if r.source == "y") / 2000 == pytest.approx(0.5, abs=0.01)


def test_odd_rows(odd, none):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == len(ODD) and {r.mix_size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0
