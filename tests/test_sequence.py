import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import noise, sequence


def arrays(spark, rows):
    return spark.createDataFrame(rows, "k long, t array<int>")


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize(("n", "want"), [(128, (141, 29)), (256, (284, 58)), (512, (568, 114)), (1024, (1137, 229))])
def test_length_solver(n, want):
    assert sequence.solve_lengths(n) == want


def test_half_density_is_cut_by_one():
    plain = sequence.corrupted_lengths(sequence.solve_lengths(100, 0.5, 3.0)[0], 0.5, 3.0)
    assert plain.targets <= 100


def test_random_chunk_start_is_in_tokens(spark):
    df = arrays(spark, [(k, list(range(65537))) for k in range(8)])
    starts = {c[0] for c in one(df, sequence.random_chunk(F.col("t"), 65536, F.col("k")))}
    assert starts <= {0, 1}


def test_random_chunk_needs_a_length():
    with pytest.raises(ValueError):
        sequence.random_chunk(None, None, None)


def test_short_and_empty_chunks_stay(spark):
    df = arrays(spark, [(1, [5, 6]), (2, [])])
    assert one(df, sequence.random_chunk(F.col("t"), 4, F.col("k"))) == [[5, 6], []]
    chunks = one(df, sequence.random_chunk(F.col("t"), 4, F.col("k"), uniform_start=True))
    assert chunks[1] == [] and len(chunks[0]) <= 2


def test_pad_drops_last_and_keeps_width(spark):
    df = arrays(spark, [(0, [5, 6, 1]), (0, [7, 1])])
    rows = sorted(r.padded for r in sequence.pad_batch(df, "t", "k").collect())
    assert rows == [[5, 6, 0], [7, 0, 0]]
    first = sorted(r.padded for r in sequence.pad_batch(df, "t", "k", first=True).collect())
    assert first == [[0, 0, 7], [0, 5, 6]]
    assert [r.padded for r in sequence.pad_batch(arrays(spark, [(0, [9])]), "t", "k", first=True).collect()] == [[0]]


def test_split_keeps_or_drops_the_tail(spark):
    df = arrays(spark, [(1, [3, 4, 5, 1]), (2, [6, 0, 7, 1])])
    keep = sequence.split_tokens(df, "t", "k", 3, drop_last_segment=False)
    assert sorted(r.input_ids for r in keep.collect()) == [[3, 4, 5], [6, 7]]
    drop = sequence.split_tokens(df, "t", "k", 3)
    assert [r.input_ids for r in drop.collect()] == [[3, 4, 5]]


def test_split_of_nothing(spark):
    df = arrays(spark, [(1, [1]), (2, None)])
    assert sequence.split_tokens(df, "t", "k", 3, drop_last_segment=False).count() == 0
    assert sequence.split_tokens(df.limit(0), "t", "k", 3).count() == 0


def test_split_does_not_depend_on_partitions(spark):
    df = arrays(spark, [(k, [*range(3, 3 + k % 9), 1]) for k in range(700)])
    want = sorted(map(tuple, sequence.split_tokens(df.repartition(1), "t", "k", 5).collect()), key=str)
    for n in (8, 31):
        assert sorted(map(tuple, sequence.split_tokens(df.repartition(n), "t", "k", 5).collect()), key=str) == want


def test_log_uniform_quirk(spark):
    df = arrays(spark, [(k, [*range(3, 43), 1]) for k in range(128)])
    faithful = sequence.split_tokens(df, "t", "k", 512, shortest=64, drop_last_segment=False).agg(F.max(F.size("input_ids"))).first()[0]
    corrected = sequence.split_tokens(df, "t", "k", 512, shortest=64, drop_last_segment=False, corrected=True).agg(F.max(F.size("input_ids"))).first()[0]
    assert 4 <= faithful <= 6 and 64 <= corrected <= 512
    assert sequence.split_tokens(df, "t", "k", 512, shortest=64).count() == 0


TOKENS, MASK = list(range(10, 20)), [c == "1" for c in "0011000100"]


def test_sentinels_by_hand(spark):
    df = spark.createDataFrame([(TOKENS, MASK)], "t array<int>, m array<boolean>")
    assert one(df, noise.sentinels(F.col("t"), F.col("m"), 100)) == [[10, 11, 100, 14, 15, 16, 101, 18, 19]]
    assert one(df, noise.kept_sentinels(F.col("t"), F.col("m"), 100)) == [[100, 12, 13, 101, 17, 102]]
    assert one(df, noise.sentinels(F.col("t"), F.col("m"), 100, descending=True)) == [[10, 11, 100, 14, 15, 16, 99, 18, 19]]


def test_noise_mask_counts(spark):
    df = spark.range(20)
    for mask in one(df, noise.noise_mask(F.lit(568), 0.15, 3.0, 1, F.col("id"))):
        starts = [i for i in range(568) if mask[i] and not (i and mask[i - 1])]
        assert len(mask) == 568 and sum(mask) == 85 and len(starts) == 28 and not mask[0]


def test_corruption_can_be_undone(spark):
    df = spark.range(30).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(1), F.lit(141)), lambda i: (i + 2).cast("int")).alias("t"))
    for r in noise.denoise(df, "t", 32000, 3, F.col("k")).collect():
        spans, now = {}, None
        for x in r.labels[:-1]:
            if x >= 32000:
                now = spans.setdefault(x, [])
            else:
                now.append(x)
        whole = [y for x in r.input_ids[:-1] for y in (spans[x] if x >= 32000 else [x])]
        assert whole == list(range(3, 144)) and len(r.input_ids) == 128 and len(r.labels) == 29
        assert r.decoder_input_ids == [0, *r.labels[:-1]]


def test_compositions_are_even(spark):
    ends = one(spark.range(3000), noise.segmentation(F.lit(4), F.lit(2), 7, F.col("id")))
    counts = [sum(e[0] == c for e in ends) for c in (1, 2, 3)]
    assert sum((c - 1000) ** 2 / 1000 for c in counts) < 13.8  # chi-square, 2 degrees, 0.1 %


def test_impossible_lengths_are_left_out(spark):
    df = arrays(spark, [(1, [5]), (2, []), (3, list(range(3, 40)))])
    assert [r.k for r in noise.denoise(df, "t", 100, F.col("k")).collect()] == [3]


def test_shift_and_width_check(spark):
    df = spark.createDataFrame([([7, -100, 9],), ([],)], "l array<int>")
    assert one(df, noise.shift_right(F.col("l"))) == [[0, 7, 0], []]
    rows = spark.createDataFrame([([1, 2], [3])], "input_ids array<int>, labels array<int>")
    assert noise.check_widths(rows, 2, 1).first().ok and not noise.check_widths(rows, 3, 1).first().ok
    with pytest.raises(Exception, match="expected 3 inputs"):
        noise.check_widths(rows, 3, 1, fail=True).collect()


def test_encode_input_of_short_texts(spark):
    df = arrays(spark, [(1, list(range(3, 9))), (2, list(range(3, 60)))])
    assert {r.k: r.ok for r in noise.encode_input(df, "t", F.col("k"), 100).collect()} == {1: False, 2: True}


def test_rows_are_tokenised_once(spark):
    """Numbering, over several slices too, reads no tokens where each row is said to have some."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<int>")
    def ids(keys: pd.Series) -> pd.Series:
        seen.add(len(keys))
        return keys.map(lambda k: [k + 3] * 4 + [1])

    df = spark.range(40_000).select(F.col("id").alias("k"), ids("id").alias("t"))
    assert sequence.prepare(df, "t", "k", 4, filled=True).count() == 40_000
    assert seen.value == 40_000


def drawn(label, n):
    return [int(hashlib.md5(f"{label}:{i}".encode()).hexdigest()[:15], 16) for i in range(1, n + 1)]


def test_words_and_noise_by_their_definition(spark):
    """Against each draw made by itself: ids of words, masks of many lengths, and both sides of corruption."""
    texts = ["a b  c", "", None, " über a\nb x ", "z " * 999]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, s string")
    want = {k: [int(hashlib.md5(f"word:{w}".encode()).hexdigest()[:15], 16) % 31997 + 3 for w in (t or "").split(" ") if w] + [1] for k, t in enumerate(texts)}
    assert {r.k: r.i for r in df.select("k", sequence.word_ids(F.col("s")).alias("i")).collect()} == want
    rows = spark.range(2, 90).select(F.col("id").alias("n"), F.sequence(F.lit(1), F.col("id").cast("int")).alias("t"))
    mask = noise.noise_mask(F.col("n").cast("int"), 0.3, 2.0, 7, F.col("n"))
    for r in noise.denoise(rows.withColumn("m", mask), "t", 500, 7, F.col("n"), density=0.3, mean_span=2.0).collect():
        z = max(min(round(r.n * 0.3), r.n - 1), 1)
        s = max(round(z / 2.0), 1)
        ends = {}
        for kind, items in (("keep", r.n - z), ("noise", z)):
            h = drawn(f"7:{r.n}:{kind}", items - 1)
            ends[kind] = [0, *sorted(sorted(range(1, items), key=lambda i, h=h: h[i - 1])[: s - 1]), items]
        inputs, labels, wanted = [], [], []
        for j in range(s):
            k0, k1, z0, z1 = ends["keep"][j], ends["keep"][j + 1], ends["noise"][j], ends["noise"][j + 1]
            inputs += [*range(k0 + z0 + 1, k1 + z0 + 1), 500 + j]
            labels += [500 + j, *range(k1 + z0 + 1, k1 + z1 + 1)]
            wanted += [False] * (k1 - k0) + [True] * (z1 - z0)
        assert (r.m, r.input_ids, r.labels) == (wanted, [*inputs, 1], [*labels, 1])


def test_sentinels_of_nulls_and_empty_rows(spark):
    df = spark.createDataFrame([([1, 2], [True, True]), (None, [True]), ([], []), ([3], None), ([4, 5], [False, True])], "t array<int>, m array<boolean>")
    assert one(df, noise.sentinels(F.col("t"), F.col("m"), 9)) == [[9], None, [], None, [4, 9]]
    assert one(spark.range(1), noise.noise_mask(F.lit(3), 0.7, 1.0, F.col("id"))) == [None]
