"""The train/test pair every stage takes and returns.

One DataFrame per split holds the features *and* the label, keyed by an explicit
``row_id`` column, so no stage ever aligns two frames by position.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import DataFrame


class Splits(NamedTuple):
    train: DataFrame
    test: DataFrame

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> "Splits":
        """Apply the same DataFrame transformation to both splits."""
        return Splits(fn(self.train), fn(self.test))

    def items(self):
        return (("train", self.train), ("test", self.test))
