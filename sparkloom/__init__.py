"""A PySpark-native corpus preparation engine."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .plans.prepare import epoch_batches, prepare, train_tokenizer, write_batches  # noqa: E402
from .plans.specs import REGISTRY, PrepSpec, RunSpec, TokenizerSpec, TokenizerTrainerSpec, compose  # noqa: E402
from .sources.tables import LocalSource, MultitaskSource, NamedSource, load_tokenizer, save_tokenizer  # noqa: E402

__all__ = [
    "REGISTRY", "LocalSource", "MultitaskSource", "NamedSource", "PrepSpec", "RunSpec", "TokenizerSpec", "TokenizerTrainerSpec", "compose", "epoch_batches", "load_tokenizer", "prepare", "save_tokenizer",
    "train_tokenizer", "write_batches",
]
