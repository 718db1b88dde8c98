"""Where rows come from and go to: tables, named sources, text files; tokenizers and metric logs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bpe
from ..operators.splits import limit, percent, split_prefix, split_random


@dataclass(frozen=True)
class Source:
    """A table with its text column, key and limits."""

    column: str = "text"
    key: str = "row_id"
    validation: float = 0.05
    train_limit: float = 1
    validation_limit: float = 1
    seed: int = 42


@dataclass(frozen=True)
class LocalSource(Source):
    """A table on a file system; split at random if it has no validation rows."""

    path: str = ""
    format: str = "parquet"


@dataclass(frozen=True)
class NamedSource(Source):
    """A source of any Spark format by name; split by a prefix if it has no validation rows."""

    name: str = ""
    format: str = "parquet"
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class MultitaskSource:
    """Several sources, one a task."""

    tasks: dict[str, Source] = field(default_factory=dict)


def scan(spark: SparkSession, path: str, *columns: str, format: str = "parquet", **options: str) -> DataFrame:
    """A table, read only in columns."""
    df = spark.read.format(format).options(**options).load(path)
    return df.select(*columns) if columns else df


def scan_text(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """(text): lines of files, one or several."""
    return spark.read.text([files] if isinstance(files, str) else files).withColumnRenamed("value", "text")


def scan_slice(df: DataFrame, key: str, share: float, *, rest: bool = False) -> DataFrame:
    """The first percent(share) % of rows in key's order, or the rest."""
    part = split_prefix(df, share, key, split="__split")
    return part.filter(F.col("__split") == ("train" if rest else "validation")).drop("__split")


def load(spark: SparkSession, source: Source | MultitaskSource) -> DataFrame:
    """Rows with split (train, validation) and, for several tasks, task. Tables without a split column are split."""
    if isinstance(source, MultitaskSource):
        parts = [load(spark, s).withColumn("task", F.lit(name)) for name, s in source.tasks.items()]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part, allowMissingColumns=True)
        return whole
    if isinstance(source, LocalSource):
        df, split = scan(spark, source.path, format=source.format), split_random
    elif isinstance(source, NamedSource):
        df, split = scan(spark, source.name, format=source.format, **source.options), split_prefix
    else:
        raise ValueError("unknown kind of source")
    if "split" not in df.columns:
        df = split(df, source.validation, source.key, **({"seed": source.seed} if split is split_random else {}))
    limits = {"train": source.train_limit, "validation": source.validation_limit}
    if all(v == 1 for v in limits.values()):
        return df
    parts = [limit(df.filter(F.col("split") == s), v, source.key, seed=source.seed).select(*df.columns) for s, v in limits.items()]
    return parts[0].unionByName(parts[1])


def training_texts(spark: SparkSession, *, path: str | None = None, files: str | list[str] | None = None, column: str = "text", format: str = "parquet") -> DataFrame:
    """Texts to train a tokenizer on: a table's train rows, which go before files; one of both must be given."""
    if path:
        df = scan(spark, path, format=format)
        df = df.filter(F.col("split") == "train") if "split" in df.columns else df
        return df.select(F.col(column).alias("text"))
    if files:
        return bpe.lines_of(spark, files)
    raise ValueError("give a table or files to train on")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    system, at = _file_system(spark, path)
    stream = system.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    system, at = _file_system(spark, path)
    if not system.exists(at):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


def save_tokenizer(model: bpe.Model, folder: str, spark: SparkSession | None = None, *, tables: bool = True) -> str:
    """Writes tokenizer.json and tokenizer_config.json (the greatest input length), and with a session or tables its vocabulary and merges as tables.

    All go through Spark's file systems; other files of the folder stay.
    """
    at = spark or SparkSession.active()
    _write_text(at, f"{folder}/tokenizer.json", model.to_json())
    _write_text(at, f"{folder}/tokenizer_config.json", json.dumps({"model_max_length": model.max_length, "clean_up_tokenization_spaces": False}))
    if spark and tables:
        vocabulary, merges = bpe.frames(model, spark)
        vocabulary.write.mode("overwrite").parquet(f"{folder}/vocabulary.parquet")
        merges.write.mode("overwrite").parquet(f"{folder}/merges.parquet")
    return folder


def load_tokenizer(folder: str, spark: SparkSession | None = None) -> bpe.Model:
    """The model saved in a folder, with its normalizers, affixes, dropout and greatest input length."""
    spark = spark or SparkSession.active()
    text = _read_text(spark, f"{folder}/tokenizer.json")
    if text is None:
        raise ValueError(f"no tokenizer in {folder}")
    said = json.loads(_read_text(spark, f"{folder}/tokenizer_config.json") or "{}")
    return bpe.Model.from_json(text, max_length=said.get("model_max_length"))


def save_fast_tokenizer(model: bpe.Model, folder: str, *, max_length: int | None = None, extra: tuple[str, ...] = (), extra_ids: int = 100) -> bpe.Model:
    """The same with extra_ids sentinel tokens and then the user's, after all others, and the greatest input length."""
    vocabulary = dict(model.vocabulary)
    for token in (*(f"<extra_id_{i}>" for i in range(extra_ids)), *extra):
        vocabulary.setdefault(token, len(vocabulary))
    grown = replace(model, vocabulary=vocabulary, special=(*model.special, *(t for t in vocabulary if t not in model.vocabulary)), max_length=max_length, extra={})
    save_tokenizer(grown, folder)
    return grown


def cached(df: DataFrame, path: str, *, overwrite: bool = False) -> DataFrame:
    """df as written to path; what is there already is read, unless overwritten."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    if overwrite or not there:
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


__all__ = [
    "LocalSource", "MultitaskSource", "NamedSource", "Source", "cached", "load", "load_tokenizer", "percent", "save_fast_tokenizer", "save_tokenizer", "scan", "scan_slice",
    "scan_text", "training_texts",
]
