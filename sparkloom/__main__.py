"""python -m sparkloom train-tokenizer | prepare: the two runs from a command line."""

from __future__ import annotations

import argparse
import json

from .plans.prepare import prepare, train_tokenizer, write_batches
from .plans.specs import compose
from .session import session
from .sources.tables import load_tokenizer


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkloom")
    commands = parser.add_subparsers(dest="command", required=True)
    train = commands.add_parser("train-tokenizer")
    train.add_argument("--table")
    train.add_argument("--files", nargs="*", default=())
    train.add_argument("--column", default="text")
    train.add_argument("--vocab-size", type=int, default=32000)
    train.add_argument("--out", default="tokenizer")
    prep = commands.add_parser("prepare")
    prep.add_argument("--table")
    prep.add_argument("--column", default="text")
    prep.add_argument("--key", default="row_id")
    prep.add_argument("--tokenizer", required=True)
    prep.add_argument("--input-length", type=int, default=512)
    prep.add_argument("--out", default="out")
    prep.add_argument("--seed", type=int, default=42)
    prep.add_argument("--epochs", type=int, default=3)
    prep.add_argument("--batch", type=int, default=8)
    prep.add_argument("--devices", type=int, default=1)
    prep.add_argument("--workers", type=int, default=1)
    prep.add_argument("--overwrite", action="store_true")
    for command in (train, prep):
        command.add_argument("--set", nargs="*", default=(), metavar="GROUP=NAME or GROUP.FIELD=VALUE", help="any setting of the registry; takes precedence over the other options")
    args = parser.parse_args(arguments)
    quoted = lambda what, value: [f"{what}={json.dumps(value)}"]
    spark = session("sparkloom")
    if args.command == "train-tokenizer":
        own = quoted("tokenizer_trainer.column", args.column) + quoted("tokenizer_trainer.save_folder", args.out) + quoted("tokenizer.vocab_size", args.vocab_size)
        own += quoted("tokenizer_trainer.dataset_path", args.table) + quoted("tokenizer_trainer.dataset_files", args.files)
        made = compose(args.command, *own, *args.set)
        train_tokenizer(spark, made["tokenizer_trainer"], made["tokenizer"])
    else:
        own = ["dataset=local", *quoted("dataset.path", args.table)] if args.table else []
        for what, value in (
            ("dataset.column", args.column), ("dataset.key", args.key), ("dataset.seed", args.seed), ("data.input_length", args.input_length), ("data.train_batch", args.batch), ("data.valid_batch", args.batch),
            ("data.devices", args.devices), ("data.workers", args.workers), ("training.output_dir", args.out), ("training.overwrite_cache", args.overwrite), ("training.seed", args.seed), ("training.epochs", args.epochs),
        ):
            own += quoted(what, value)
        made = compose(args.command, *own, *args.set)
        spec, run = made["data"], made["training"]
        chunks = prepare(spark, made["dataset"], args.tokenizer, spec, run)
        write_batches(chunks, load_tokenizer(args.tokenizer, spark), spec, run)


if __name__ == "__main__":
    main()
