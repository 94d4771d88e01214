"""Scan events as a stream: debounce with state, and history kept as a log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.functions.codes import is_valid_ean, normalize_barcode
from pyspark.sql import functions as F


def valid_scans(scans: DataFrame, code: str = "code") -> DataFrame:
    """Normalised codes whose check digit holds; misread codes never reach a lookup."""
    return scans.withColumn(code, normalize_barcode(F.col(code))).filter(is_valid_ean(F.col(code)))


def debounce_window(scans: DataFrame, keys: list[str], at: str, delay: str = "2500 milliseconds") -> DataFrame:
    """Built-in form: the first of each key within the watermark. Enough where scans of other codes
    in between need not reset the rule."""
    return scans.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def debounce_exact(scans: DataFrame, user: str, code: str, at: str, seconds: float = 2.5, delay: str = "1 minute") -> DataFrame:
    """Suppress a code that equals the last one emitted for the user less than ``seconds`` ago.

    State is one (code, time) pair a user, and goes once the watermark is ``seconds`` past it, when it can't
    suppress anything any more. Rows of a batch are ordered by event time inside it; rows later than
    ``delay`` are dropped by the watermark, so an order across batches can't be broken by them.
    """
    schema = scans.schema

    def emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_code, last_at = state.get if state.exists else (None, float("-inf"))
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        keep = []
        for c, t in zip(rows[code], rows[at]):
            now = t.timestamp()
            fresh = c != last_code or now - last_at >= seconds
            keep.append(fresh)
            if fresh:
                last_code, last_at = c, now
        state.update((last_code, last_at))
        state.setTimeoutTimestamp(max(int((last_at + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield rows[keep]

    return scans.withWatermark(at, delay).groupBy(user).applyInPandasWithState(
        emit, schema, "code string, at double", "append", GroupStateTimeout.EventTimeTimeout)
