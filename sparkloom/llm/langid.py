"""Language ID by language-bitmask n-gram filters: bit-sliced Bloom filters, popcounts, false positives corrected."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stage, unit

# Odd multipliers of the filter's hashes.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_CHUNK = 1 << 16


def _fold_table() -> np.ndarray:
    """Bytes as they are compared: A-Z lower-cased, other ASCII than letters blank."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[i for i in range(128) if not 97 <= table[i] <= 122]] = 32
    return table


@dataclass(frozen=True)
class Settings:
    """sizes: of the byte n-grams. sample_rows: labelled rows a language that are learned from, as expected by a hash of the id.

    An n-gram belongs to each language where it is at least near times as frequent as in the one where it is most frequent,
    and which has it min_count times; max_ngrams bounds those that go into the filters.
    """

    sizes: tuple[int, ...] = (2, 3, 4)
    sample_rows: int = 1500
    near: float = 0.3
    min_count: int = 5
    slot_bits: int = 21
    slots: int = 6
    hashes: int = 2


def _grams(data: np.ndarray, doc: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, documents) of the n-grams that lie within one document, a bounded part at a time."""
    for at in range(0, len(data), _CHUNK):
        part = data[at : at + _CHUNK + max(sizes) - 1].astype(np.uint64)
        of = doc[at : at + _CHUNK + max(sizes) - 1]
        for n in sizes:
            m = min(len(part) - n + 1, _CHUNK)
            if m <= 0:
                continue
            code = np.full(m, n, np.uint64)
            for k in range(n):
                code = (code << np.uint64(8)) | part[k : k + m]
            inside = of[:m] == of[n - 1 : n - 1 + m]
            yield code[inside], of[:m][inside]


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as folded bytes, each between blanks, and the number of the text at each byte."""
    raw = [b" " + (t or "").encode("utf-8", "replace") + b" " for t in texts]
    data = _fold_table()[np.frombuffer(b"".join(raw), np.uint8)]
    return data, np.repeat(np.arange(len(raw)), [len(r) for r in raw])


class Filters:
    """Slots of bit masks: bit l % 8 of byte l // 8 in a slot is set if an n-gram of language l falls there."""

    def __init__(self, languages: list[str], codes: np.ndarray, members: np.ndarray, settings: Settings):
        self.bits = max(settings.slot_bits, (settings.slots * max(1, len(codes)) - 1).bit_length())
        self.languages, self.settings = languages, settings
        planes = max(1, -(-len(languages) // 8))
        self.slots = np.zeros((planes, 1 << self.bits), np.uint8)
        for plane in range(planes):
            own = members[:, plane * 8 : plane * 8 + 8]
            mask = (own << np.arange(own.shape[1])).sum(1).astype(np.uint8)
            for h in self._slots(codes):
                np.bitwise_or.at(self.slots[plane], h, mask)
        fill = np.concatenate([[np.mean(p >> b & 1) for b in range(8)] for p in self.slots])[: len(languages)]
        self.false_rate = fill**settings.hashes

    def _slots(self, codes: np.ndarray) -> list[np.ndarray]:
        right = np.uint64(64 - self.bits)
        return [((codes ^ (codes >> np.uint64(23))) * np.uint64(m) >> right).astype(np.int64) for m in _ODD[: self.settings.hashes]]

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: hits of each language, corrected for false positives, and the number of n-grams."""
        data, doc = _joined(texts)
        n, planes = len(texts), len(self.slots)
        seen = np.zeros((planes, n * 256), np.int64)
        total = np.zeros(n, np.int64)
        for codes, of in _grams(data, doc, self.settings.sizes):
            total += np.bincount(of, minlength=n)
            slots = self._slots(codes)
            for plane in range(planes):
                mask = self.slots[plane][slots[0]]
                for s in slots[1:]:
                    mask = mask & self.slots[plane][s]
                seen[plane] += np.bincount(of * 256 + mask, minlength=n * 256)
        bits = np.arange(256)[:, None] >> np.arange(8) & 1
        hits = np.concatenate([p.reshape(n, 256) @ bits for p in seen], 1)[:, : len(self.languages)]
        return np.maximum(0, (hits - total[:, None] * self.false_rate) / (1 - self.false_rate)), total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score: the most corrected hits (ties: the language most rows are learned from), and their share of all languages'."""
        hits, _ = self.count(texts)
        best = hits.argmax(1)
        score = hits[np.arange(len(best)), best] / np.maximum(hits.sum(1), 1e-12)
        return [self.languages[b] for b in best], np.clip(score, 0.0, 1.0)


def remainder(id: Column) -> Column:
    """crc32 of the id as text, mod 3; null for a null id."""
    return (F.crc32(F.encode(id.cast("string"), "UTF-8")) % 3).cast("int")


def fit(labelled: DataFrame, settings: Settings = Settings(), *, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters | None:
    """Filters learned from labelled; None if it has no row with text and label.

    What goes to the driver is one count a language and the n-grams of the sample, which settings.sample_rows bounds. Rows with a null id are taken
    or left together; repeated rows count as often as they stand there; of languages with equally many rows the lesser name is first.
    """
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    languages = sorted(counts, key=lambda k: (-counts[k], k))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, settings.sample_rows / counts[k]))])
    chosen = rows.filter(unit(F.xxhash64(F.lit(5), id)) < share[F.col(lang)]).select(text, lang)
    number = {k: i for i, k in enumerate(languages)}
    sizes = settings.sizes

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby(lang):
                for at in range(0, len(own), 100):
                    data, doc = _joined(own[text].iloc[at : at + 100].tolist())
                    for codes, _ in _grams(data, doc, sizes):
                        code, n = np.unique(codes, return_counts=True)
                        yield pd.DataFrame({"code": code.astype(np.int64), "lang": number[name], "n": n.astype(np.int64)})

    sums = chosen.mapInPandas(tally, "code long, lang int, n long").groupBy("code", "lang").agg(F.sum("n").alias("n"))
    sums = stage(sums, "langid-ngrams")
    totals = F.sum("n").alias("n")
    per_lang = {r[0]: r[1] for r in sums.groupBy("lang").agg(totals).collect()}
    rate = F.col("n") / F.create_map(*[F.lit(x) for k, v in per_lang.items() for x in (k, float(v))])[F.col("lang")]
    entries = sums.filter(F.col("n") >= settings.min_count).withColumn("rate", rate)
    grams = entries.groupBy("code").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("of"))
    grams = grams.select("code", "top", F.transform(F.filter("of", lambda x: x["rate"] >= F.col("top") * F.lit(settings.near)), lambda x: x["lang"]).alias("of"))
    grams = grams.filter(F.size("of") < max(2, len(languages)))
    found = grams.select("code", "of").toPandas()
    members = np.zeros((len(found), len(languages)), np.int64)
    for i, of in enumerate(found["of"]):
        members[i, list(of)] = 1
    return Filters(languages, found["code"].to_numpy(np.int64).astype(np.uint64), members, settings)


def identify(df: DataFrame, filters: Filters | None, *, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language of each whole text and its score (0 to 1).

    A null text, or one without a letter, is 'und' with score 0, and so is every text if nothing was
    learned. A text with letters of which no n-gram is known gets the language that most rows were
    learned from, with score 0. Rows are only mapped; columns named lang_pred or score are replaced, others pass through, and a
    repeated row or an empty table is nothing special.
    """
    names = [c for c in df.columns if c not in (lang_pred, score)]
    kept = df.select(*names).schema
    letter = "__letter"
    while letter in names:
        letter += "_"
    shared = df.sparkSession.sparkContext.broadcast(filters)
    where = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                texts, letters = piece.column(where).to_pylist(), piece.column(len(names)).to_pylist()
                found, scores = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)))
                pred = [p if ok else "und" for p, ok in zip(found, letters, strict=True)]
                sure = np.where(np.array(letters, bool), scores, 0.0)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=[*names, lang_pred, score])

    schema = T.StructType([*kept.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    flagged = df.select(*names, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letter))
    return flagged.mapInArrow(run, schema)


def training_rows(df: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """Rows to learn from: those whose id has another remainder than 1. A row with a null id is none of them."""
    return df.filter(remainder(F.col(id)) != 1)
