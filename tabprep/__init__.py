"""tabprep: preparing, describing and testing tabular data against a continuous
target, written as Spark DataFrame plans.

Sub-packages:

- ``sources``    reading, validating, checkpointing (S1-S6) and the flights fixture view
- ``functions``  column functions for the scalar features (F1-F13)
- ``operators``  filters, sampling, joins, cleaning, encoding, statistics, tests, models
- ``plans``      the end-to-end flight plan and the registered queries with their SQL oracles
- ``streaming``  the stateless feature stage applied to a streaming source
"""

from tabprep.errors import (  # noqa: F401
    EmptyInputError,
    MissingColumnsError,
    MissingSourceError,
    SingleClassError,
    UnknownStrategyError,
)
from tabprep.splits import Splits  # noqa: F401

__all__ = [
    "Splits",
    "EmptyInputError",
    "MissingColumnsError",
    "MissingSourceError",
    "SingleClassError",
    "UnknownStrategyError",
]
