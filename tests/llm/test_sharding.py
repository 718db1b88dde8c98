import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import sharding

from .conftest import ODD


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws(documents, law):
    rows = sharding.shard_documents(documents, 7, law=law).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    else:
        assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_groups_stay_together(make):
    rows = [(i, f"text {i // 4}", "s") for i in range(800)]
    placed = sharding.shard_documents(make(rows), 10).collect()
    groups = defaultdict(set)
    for r in placed:
        groups[r.doc_id // 4].add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 50  # of 200; by chance all but a few would be apart


def test_partitions_change_nothing(documents):
    one, two = (sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(documents.repartition(n), 10).collect()) for n in (2, 9))
    assert one == two


def test_a_group_larger_than_a_shard(make):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", "s") for i in range(900)]
    placed = sharding.shard_documents(make(rows), 10).collect()
    assert set(Counter(r.shard for r in placed).values()) == {90}


def test_large_groups_take_few_shards(make):
    """A third of all rows fills 13.3 of 40 shards, a tenth 4."""
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 10 == 1 else f"t{i // 2}", "s") for i in range(4000)]
    for law in ("rows", "bytes"):
        taken = defaultdict(set)
        for r in sharding.shard_documents(make(rows), 40, law=law).collect():
            taken[rows[r.doc_id][1]].add(r.shard)
        assert len(taken["hot"]) <= 16 and len(taken["warm"]) <= 6


def test_propagation_cuts_fewer_edges(spark):
    """Two rings of cliques: labels start at random, and move together under the quotas."""
    nodes = spark.range(400).select("id", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("shard"))
    pairs = nodes.select("id").alias("a").join(nodes.select("id").alias("b"), (F.floor(F.col("a.id") / 10) == F.floor(F.col("b.id") / 10)) & (F.col("a.id") != F.col("b.id")))
    edges = pairs.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))

    def cut(labels):
        at = {r.id: r.shard for r in labels.collect()}
        return sum(at[r.src] != at[r.dst] for r in edges.collect()), Counter(at.values())

    before, _ = cut(nodes)
    after, loads = cut(sharding.propagate(nodes, edges, 4, rounds=6, slack=0.2))
    assert after < before / 2 and max(loads.values()) <= 400 / 4 * 1.5


def test_odd_rows(odd, none):
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == len(ODD) and sorted(Counter(r.shard for r in rows).values()) == [3, 4, 4]
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id == 1} == {(16, 0)}
    assert sharding.shard_documents(odd, 40).select("shard").distinct().count() == len(ODD)
    assert sharding.shard_documents(none, 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(odd, 3, law="luck")
