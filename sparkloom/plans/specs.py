"""What a run is made of: frozen settings, built by name."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

from ..functions import metrics
from ..sources.tables import LocalSource, MultitaskSource, NamedSource


@dataclass(frozen=True)
class TokenizerSpec:
    vocab_size: int = 32000
    min_frequency: int = 2
    add_prefix_space: bool = False
    special_tokens: tuple[str, ...] = ()
    unicode_form: str | None = "nfkc"
    nmt: bool = False
    collapse_spaces: bool = True
    lowercase: bool = False
    dropout: float | None = None
    continuing_subword_prefix: str | None = None
    end_of_word_suffix: str | None = None
    trim_offsets: bool = False


@dataclass(frozen=True)
class TokenizerTrainerSpec:
    """A table goes before files."""

    dataset_path: str | None = None
    dataset_files: tuple[str, ...] = ()
    column: str = "text"
    save_folder: str = "tokenizer"
    model_max_length: int | None = None
    additional_special_tokens: tuple[str, ...] = ()


@dataclass(frozen=True)
class PrepSpec:
    validation_size: float = 0.05
    train_batch: int = 8
    valid_batch: int = 8
    input_length: int = 512
    noise_density: float = 0.15
    mean_span: float = 3.0
    train_limit: float = 1.0
    valid_limit: float = 1.0
    decoder_start: int = 0
    workers: int = 1
    devices: int = 1


@dataclass(frozen=True)
class RunSpec:
    output_dir: str = "out"
    cache_dir: str | None = None
    overwrite_cache: bool = False
    seed: int = 42
    epochs: int = 3
    logging_steps: int = 500
    valid_steps: int = 2000
    save_steps: int = 500


@dataclass(frozen=True)
class AdamSpec:
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-8
    eps_root: float = 1e-3


@dataclass(frozen=True)
class AdamWSpec(AdamSpec):
    weight_decay: float = 1e-4


@dataclass(frozen=True)
class AdafactorSpec:
    min_dim_size_to_factor: int = 128
    decay_rate: float = 0.8
    decay_offset: int = 0
    multiply_by_parameter_scale: bool = True
    clipping_threshold: float = 1.0
    momentum: float | None = None
    weight_decay_rate: float | None = None
    dtype_momentum: str = "float32"
    eps: float = 1e-30
    factored: bool = True


@dataclass(frozen=True)
class AdagradSpec:
    initial_accumulator: float = 0.1
    eps: float = 1e-7


@dataclass(frozen=True)
class ScheduleSpec:
    kind: str = "linear"
    learning_rate: float | None = None
    init: float = 0.0
    warmup: int = 0
    power: float = 1.0

    def column(self, step, train_steps: int | None):
        """The rate at a step."""
        more = {"power": self.power} if self.kind == "polynomial" else {}
        return metrics.schedule(self.kind, step, rate=self.learning_rate, steps=train_steps, init=self.init, warmup=self.warmup, **more)


@dataclass(frozen=True)
class Registry:
    """Kinds of settings by group and name."""

    groups: dict[str, dict[str, type]] = field(default_factory=dict)

    def add(self, group: str, name: str, kind: type) -> None:
        self.groups.setdefault(group, {})[name] = kind

    def build(self, group: str, name: str, **values: Any):
        """Settings of a kind; an unknown group, name or value is an error."""
        try:
            kind = self.groups[group][name]
        except KeyError:
            raise ValueError(f"unknown {group}: {name}") from None
        if unknown := set(values) - {f.name for f in fields(kind)}:
            raise ValueError(f"{group}/{name} has no {', '.join(sorted(unknown))}")
        return kind(**values)


REGISTRY = Registry()
for _group, _kinds in {
    "tokenizer": {"byte_level_bpe": TokenizerSpec},
    "tokenizer_trainer": {"byte_level_bpe": TokenizerTrainerSpec},
    "dataset": {"local": LocalSource, "named": NamedSource, "multitask": MultitaskSource},
    "data": {"span_corruption": PrepSpec},
    "training": {"default": RunSpec},
    "optimizer": {"adam": AdamSpec, "adamw": AdamWSpec, "adafactor": AdafactorSpec, "adagrad": AdagradSpec},
    "schedule": {"default": ScheduleSpec},
}.items():
    for _name, _kind in _kinds.items():
        REGISTRY.add(_group, _name, _kind)

# The kinds of settings that each run is made of, unless told otherwise.
DEFAULTS = {
    "train-tokenizer": {"tokenizer": "byte_level_bpe", "tokenizer_trainer": "byte_level_bpe"},
    "prepare": {"dataset": "named", "data": "span_corruption", "training": "default", "optimizer": "adamw", "schedule": "default"},
}


def _value(text: str) -> Any:
    """JSON (lists as tuples), or else the text itself."""
    try:
        value = json.loads(text)
    except ValueError:
        return text
    return tuple(value) if isinstance(value, list) else value


def compose(run: str, *settings: str, registry: Registry = REGISTRY) -> dict[str, Any]:
    """The settings of a run by group: 'group=name' chooses a kind, 'group.field=value' sets a value, the last one counts."""
    names, values = dict(DEFAULTS[run]), {}
    for setting in settings:
        what, equals, text = setting.partition("=")
        group, dot, name = what.partition(".")
        if not equals or group not in names:
            raise ValueError(f"{run} has no setting {setting}")
        if dot:
            values.setdefault(group, {})[name] = _value(text)
        else:
            names[group] = text
    return {group: registry.build(group, name, **values.get(group, {})) for group, name in names.items()}
