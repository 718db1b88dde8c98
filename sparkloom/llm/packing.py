"""Packing: concatenate all documents' tokens and cut the stream into fixed windows."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage, worker_cache

_FULL = 300_000
# What the vocabulary's file says of splitting a lower-cased text into pieces; white space is dropped.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")
# Texts with these go through the library whole: its lower-casing, spaces or byte names differ from Python's.
_ODD = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\xa0\u0130\u03a3\u1680\u2000-\u200f\u2028\u2029\u202f\u205f\u3000]")


class WordEncoder:
    """A tokenizer's ids of a text, as unsigned 16- or 32-bit little-endian bytes.

    The file's normalizer (NFC, blanks, lower case) and splitter are followed here, by the same pattern, and each new
    piece is encoded by the library's model once and kept; at _FULL pieces the first half stays, where the frequent ones are, so memory is
    bounded (some 150 bytes a piece, also while a worker waits for its next task). Texts for which that isn't sure to be the same go through the library whole, and so do all if the file's
    pattern is another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces: dict[str, bytes] = {}
        self.split = regex.compile(_SPLIT)
        said = json.loads(self.library.to_str())
        kinds = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
        patterns = [p["pattern"].get("Regex") for p in (said["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and patterns == [_SPLIT]
        # How byte-level models spell bytes: printable ones as they are, the rest from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.spelled = {b: 256 + i for i, b in enumerate(rest)}

    def _piece(self, piece: str) -> bytes:
        spelled = piece.encode("utf-8").decode("latin-1").translate(self.spelled)
        ids = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(spelled)], self.dtype).tobytes()
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.known or any(s in text for s in self.special) or _ODD.search(text):
            return self._whole(text)
        if text.isascii():
            found = _ASCII_SPLIT.findall(text.lower().replace("\n", " ").replace("\t", " "))
        elif unicodedata.is_normalized("NFC", text):
            found = self.split.findall(text.lower())
        else:
            return self._whole(text)
        if len(self.pieces) > _FULL:
            self.pieces = dict(islice(self.pieces.items(), _FULL // 2))
        known = self.pieces
        try:
            return b"".join([known[p] for p in found])
        except KeyError:
            return b"".join([known[p] if p in known else self._piece(p) for p in found])


def encode_documents(df: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Rows (id, part, before, n, width, ids): ids are the text's and end_id; before counts the ids ahead of it in its part (task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_cache(("words", tokenizer), lambda: WordEncoder(tokenizer))
        part, before, end = TaskContext.get().partitionId(), 0, np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                ids = [encoder.encode(t or "") + end for t in piece.column(1).to_pylist()]
                n = np.array([len(x) // encoder.dtype.itemsize for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([part] * len(n), pa.int64()), pa.array(starts), pa.array(n), pa.array([encoder.dtype.itemsize] * len(n), pa.int32()), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "before", "n", "width", "ids"],
                )

    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, part long, before long, n long, width int, ids binary")


def pack(df: DataFrame, tokenizer: str, *, length: int = 4096, id: str = "doc_id", text: str = "text", end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces (boundary records) of the concatenated stream, cut at every multiple of length.

    A piece has doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id and offset; with_ids adds the ids themselves. All sequences but the last are full.

    The first pass encodes each text once and writes the ids with the count of ids before them in their task;
    the tasks' totals, one number a task, give each task its offset; the second pass cuts. No document is shuffled, and the
    table of totals that is broadcast has a row for each task of the first pass.

    A null text counts as empty and is end_id alone; null or repeated ids and repeated rows are
    documents of their own. An empty table gives no piece.
    """
    encoded = stage(encode_documents(df, tokenizer, id=id, text=text, end_id=end_id), "pack-ids", compression="zstd")
    totals = encoded.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    placed = encoded.join(F.broadcast(offsets), "part").select("doc_id", (F.col("ahead") + F.col("before")).alias("at"), "n", "width", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            pieces = (at + n - 1) // length - at // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            seq = at[doc] // length + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(seq * length, at[doc]) - at[doc]
            stop = np.minimum((seq + 1) * length, at[doc] + n[doc]) - at[doc]
            widths, ids = batch.column(3), batch.column(4)
            crc, lists, last = [], [], -1
            for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True):
                if d != last:
                    whole, last = np.frombuffer(ids[d].as_py(), "<u2" if widths[d].as_py() == 2 else "<u4").astype("<u4"), d
                crc.append(zlib.crc32(whole[a:b].tobytes()))
                if with_ids:
                    lists.append(whole[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(doc)), start, stop - start, np.array(crc, np.int64), n[doc], seq, at[doc] + start - seq * length]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    kind = df.schema[id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame, *, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """Training rows (sequence_id, doc_ids, ids) of pack(with_ids=True); a sequence holds length ids at most, so its group is bounded.

    ids are padded to length, except where their number is a power of two.
    """
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    whole = pieces.groupBy("sequence_id").agg(rows.alias("rows")).select("sequence_id", F.col("rows.doc_id").alias("doc_ids"), F.flatten("rows.ids").alias("ids"))
    n = F.size("ids")
    short = ~((n > 0) & (n.bitwiseAND(n - 1) == 0)) & (n < length)
    return whole.withColumn("ids", F.when(short, F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(length) - n))).otherwise(F.col("ids")))
