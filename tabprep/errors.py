"""Typed errors. Where the studied pipeline printed a message and carried on with
half-built state, these are raised instead."""


class TabprepError(Exception):
    """Base class of every error raised by the library."""


class MissingSourceError(TabprepError, FileNotFoundError):
    """The input path does not exist."""


class EmptyInputError(TabprepError):
    """A table has no rows (at load, or after a filter)."""


class MissingColumnsError(TabprepError, KeyError):
    """Columns required by a step are absent."""

    def __init__(self, missing):
        self.missing = list(missing)
        super().__init__(f"missing required columns: {self.missing}")

    def __str__(self):  # KeyError quotes its argument otherwise
        return f"missing required columns: {self.missing}"


class SingleClassError(TabprepError):
    """One of the two target classes needed for balancing is empty."""


class UnknownStrategyError(TabprepError, ValueError):
    """A strategy name that the operator does not know."""


class MalformedRecordsError(TabprepError, ValueError):
    """Records of a text file have more fields than its header."""

    def __init__(self, count: int, path: str):
        self.count = count
        super().__init__(f"{count} record(s) of {path} have more fields than the header")


class CheckpointError(TabprepError):
    """A folder holds no finished checkpoint, or not what its manifest says."""
