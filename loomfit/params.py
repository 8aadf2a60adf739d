"""Hyper-parameters of the two estimators."""

from __future__ import annotations

from dataclasses import dataclass

SAMPLING_MODES = ("WINDOW", "ITEM2VEC", "ITEM2VEC_POS2NEG")


@dataclass(frozen=True)
class TrainParams:
    """What training needs; checked on creation."""

    vector_size: int = 100
    negative: int = 5
    num_iterations: int = 1
    learning_rate: float = 0.025
    num_partitions: int = 1
    pow: float = 0.0
    lambda_l: float = 0.0
    lambda_r: float = 0.0
    use_bias: bool = False
    implicit: bool = True
    gamma: float = 1.0
    seed: int = 0
    batch_size: int = 1024
    checkpoint_path: str | None = None
    checkpoint_interval: int = 0

    def __post_init__(self) -> None:
        for name in ("vector_size", "negative", "num_iterations", "learning_rate", "num_partitions", "batch_size"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        for name in ("pow", "lambda_l", "lambda_r", "gamma"):
            if not getattr(self, name) >= 0:
                raise ValueError(f"{name} must not be negative")
        if self.checkpoint_interval < 0:
            raise ValueError("checkpoint_interval must not be negative")
        if bool(self.checkpoint_path) != bool(self.checkpoint_interval):
            raise ValueError("checkpoint_path and checkpoint_interval go together")

    @property
    def width(self) -> int:
        """Length of a vector: with a bias, that is its last value."""
        return self.vector_size + self.use_bias

    @property
    def negatives(self) -> int:
        """Negatives drawn per pair; explicit training draws none."""
        return self.negative if self.implicit else 0

    def salt(self, epoch: int, rotation: int) -> tuple[int, int, int]:
        """What draws and the order of pairs in a rotation depend on."""
        return self.seed & 0xFFFFFFFF, epoch, rotation
