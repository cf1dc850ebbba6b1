"""Parameters shared by the packing operators."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

# Defaults and the least stand-in for "no sample cap" (a pack has no more samples than tokens).
DEFAULT_SEQ_LENGTH = 32768
DEFAULT_MAX_SAMPLES = 128
DEFAULT_MAX_SAMPLE_LENGTH = 5120
DEFAULT_BATCH_SIZE = 8
DEFAULT_SHUFFLE_BUFFER_FACTOR = 10
PACKS_PER_BUFFER_FACTOR = 100
NO_SAMPLE_CAP = 1_000_000
STRATEGIES = ("greedy", "pool", "first_fit")


@dataclass(frozen=True)
class PackConfig:
    """How triplets become samples and samples become fixed-length rows.

    ``max_sample_length`` limits a whole sample (all its slots joined). ``max_samples=None`` lifts
    the per-pack sample cap.
    """

    eos_token_id: int
    seq_length: int = DEFAULT_SEQ_LENGTH
    max_samples: int | None = DEFAULT_MAX_SAMPLES
    max_sample_length: int | None = DEFAULT_MAX_SAMPLE_LENGTH
    num_negatives: int = 1
    pad_token_id: int = 0
    add_special_tokens: bool = True
    strategy: str = "greedy"
    batch_size: int = DEFAULT_BATCH_SIZE
    shuffle: bool = True
    shuffle_buffer_factor: int | None = DEFAULT_SHUFFLE_BUFFER_FACTOR
    seed: int | None = None

    def __post_init__(self) -> None:
        if self.num_negatives <= 0:
            raise ValueError("num_negatives must be greater than 0")
        if self.seq_length <= 0:
            raise ValueError("seq_length must be greater than 0")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}, expected one of {STRATEGIES}")
        if self.max_sample_length and self.max_sample_length > self.seq_length:
            warnings.warn(
                f"max_sample_length {self.max_sample_length} is above seq_length "
                f"{self.seq_length} and is lowered to it",
                stacklevel=2,
            )
            object.__setattr__(self, "max_sample_length", self.seq_length)

    @property
    def num_slots(self) -> int:
        """Anchor, positive and the negatives."""
        return 2 + self.num_negatives

    @property
    def sample_cap(self) -> int:
        return max(NO_SAMPLE_CAP, self.seq_length) if self.max_samples is None else self.max_samples

    @property
    def shuffle_buffer(self) -> int | None:
        """Packs among which the shuffle moves; None for all."""
        return self.shuffle_buffer_factor and self.shuffle_buffer_factor * PACKS_PER_BUFFER_FACTOR

    def with_(self, **changes) -> "PackConfig":
        return replace(self, **changes)


def resolve_eos(explicit: int | None = None, tokenizer: object | None = None) -> int:
    """The end-of-text id: the argument wins, then the tokenizer's own, otherwise an error."""
    if explicit is not None:
        return explicit
    own = getattr(tokenizer, "eos_token_id", None)
    if own is None:
        raise ValueError("give eos_token_id or a tokenizer that has one")
    return own
