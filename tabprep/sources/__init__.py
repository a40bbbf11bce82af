"""Sources, sinks and validation (S1-S6) and the flights fixture view."""

from tabprep.sources.checkpoint import load_splits, save_splits, stage_report  # noqa: F401
from tabprep.sources.fixtures import flights_view, table  # noqa: F401
from tabprep.sources.readers import (  # noqa: F401
    nan_to_null,
    read_flights,
    require_classes,
    require_columns,
    require_rows,
)
