"""The two runs: training a tokenizer, and preparing pre-training batches."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batching, bpe, noise, ordering, sequence
from ..operators.splits import limit
from ..sources import tables
from .specs import PrepSpec, RunSpec, TokenizerSpec, TokenizerTrainerSpec


def train_tokenizer(spark: SparkSession, trainer: TokenizerTrainerSpec, spec: TokenizerSpec = TokenizerSpec()) -> bpe.Model:
    """Counts words by Spark, finds the merges, saves tokenizer.json and the vocabulary with sentinels."""
    texts = tables.training_texts(spark, path=trainer.dataset_path, files=list(trainer.dataset_files) or None, column=trainer.column)
    model = bpe.train(
        texts, "text", spec.vocab_size, min_frequency=spec.min_frequency, user=spec.special_tokens, prefix_space=spec.add_prefix_space, form=spec.unicode_form, nmt=spec.nmt,
        collapse=spec.collapse_spaces, lower=spec.lowercase, dropout=spec.dropout, continuing_prefix=spec.continuing_subword_prefix, end_of_word=spec.end_of_word_suffix, trim_offsets=spec.trim_offsets,
    )
    return tables.save_fast_tokenizer(model, trainer.save_folder, max_length=trainer.model_max_length, extra=trainer.additional_special_tokens)


def segments(df: DataFrame, model: bpe.Model, source: tables.Source, prep: PrepSpec, *, size: float = 1.0, seed: int = 42) -> DataFrame:
    """Texts to segments whose corrupted inputs have the input length; a limit holds for rows and again for segments."""
    raw, _ = sequence.solve_lengths(prep.input_length, prep.noise_density, prep.mean_span)
    key = source.key
    if size != 1:
        df, key = limit(df, size, source.key, seed=seed).drop(source.key), "draw_id"
    coded = df.select(F.col(key), bpe.encode(F.col(source.column), model).alias("input_ids"))
    cut = sequence.prepare(coded, "input_ids", key, raw, seed=seed)
    numbered = ordering.number(cut, F.col("batch_id"), tie=F.col("seg_id"), name="chunk")
    if size == 1:
        return numbered
    return limit(numbered, size, "chunk", seed=seed).drop("chunk").withColumnRenamed("draw_id", "chunk")


def epoch_batches(chunks: DataFrame, prep: PrepSpec, model: bpe.Model, *, epoch: int = 0, seed: int = 42, train: bool = True) -> DataFrame:
    """An epoch's examples with their place. Noise is drawn anew each epoch, as a function of epoch and chunk. Tasks (a column task) take turns."""
    sentinel = model.vocabulary.get("<extra_id_0>", len(model.vocabulary))
    size, how = prep.train_batch if train else prep.valid_batch, {"workers": prep.workers, "devices": prep.devices, "shuffled": train, "drop_last": True, "seed": seed, "epoch": epoch}
    if "task" in chunks.columns:
        placed, key = batching.multitask(chunks.drop("batch_id"), "task", "chunk", size, **how), [F.col("task"), F.col("chunk")]
    else:
        placed, key = batching.iterate(chunks.drop("batch_id"), "chunk", size, **how), [F.col("chunk")]
    return noise.denoise(placed, "input_ids", sentinel, seed, "noise", epoch, *key, density=prep.noise_density, mean_span=prep.mean_span, start=prep.decoder_start)


def prepare(spark: SparkSession, source: tables.Source | tables.MultitaskSource, tokenizer: str, prep: PrepSpec = PrepSpec(), run: RunSpec = RunSpec()) -> dict[str, DataFrame]:
    """{'train', 'validation'}: segments of a source, written to the output folder and read back (or read, if they are there).

    Each task of a MultitaskSource is prepared by its own settings, in a folder of its own, and its segments have its name as task.
    """
    if isinstance(source, tables.MultitaskSource):
        parts = {task: prepare(spark, s, tokenizer, prep, replace(run, output_dir=f"{run.output_dir}/{task}")) for task, s in source.tasks.items()}
        if not parts:
            raise ValueError("no tasks")
        out = {}
        for task, splits in parts.items():
            for split, chunks in splits.items():
                one = chunks.withColumn("task", F.lit(task))
                out[split] = out[split].unionByName(one) if split in out else one
        return out
    model = tables.load_tokenizer(tokenizer, spark)
    rows = tables.load(spark, source)
    out = {}
    for split, size in (("train", prep.train_limit), ("validation", prep.valid_limit)):
        chunks = segments(rows.filter(F.col("split") == split), model, source, prep, size=size, seed=run.seed)
        out[split] = tables.cached(chunks, f"{run.output_dir}/{split}", overwrite=run.overwrite_cache)
    return out


def write_batches(chunks: dict[str, DataFrame], model: bpe.Model, prep: PrepSpec = PrepSpec(), run: RunSpec = RunSpec()) -> dict[str, DataFrame]:
    """{'train', 'validation'}: the examples of run.epochs epochs (one for validation, not shuffled) with epoch, batch_id, pos, worker_id, device_id, written and read back."""
    out = {}
    for split, epochs in (("train", run.epochs), ("validation", 1)):
        whole = None
        for epoch in range(epochs):
            one = epoch_batches(chunks[split], prep, model, epoch=epoch, seed=run.seed, train=split == "train").withColumn("epoch", F.lit(epoch))
            whole = one if whole is None else whole.unionByName(one)
        if whole is not None:
            out[split] = tables.cached(whole, f"{run.output_dir}/batches/{split}", overwrite=run.overwrite_cache)
    return out
