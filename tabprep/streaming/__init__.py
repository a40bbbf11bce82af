"""Streaming use of the stateless stages.

The studied pipeline reads one file once and has no streaming stage, no
windows, watermarks or state. What carries over to Structured Streaming
unchanged is the stateless part of the plan - P1 (completed flights), P2
(null-safe clip) and the scalar features F1-F11 - because each is a plain
projection or filter. Fitted state (hour map, label codes, scaler
parameters) is applied the same way as on batch data: a broadcast lookup or
literals, which streaming micro-batches accept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabprep.operators import features, filters


def stateless_flight_stage(stream: DataFrame, label: str = "arr_delay") -> DataFrame:
    """P1 -> P2 -> F1-F11 on a (streaming or batch) flights DataFrame."""
    completed = filters.keep_completed(stream)
    return features.engineer_features(filters.clip_lower(completed, label, 0.0))


def apply_hour_map(stream: DataFrame, state: features.TargetMean) -> DataFrame:
    """E4 apply on a stream with a map fitted on batch training data."""
    return features.apply_target_mean(stream, state)
