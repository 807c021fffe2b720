"""Buffers of a stream: units are held back until there are enough for one call of an encoder, or time is up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "held array<string>, flushes long"


def buffered(stream: DataFrame, key: str, unit: str, size: int, *, wait_ms: int | None = None) -> DataFrame:
    """(key, flush, whole, units) of a stream (key, unit): whole buffers of `size` units of each key, numbered from 0.

    What doesn't fill a buffer stays in the key's state, which the checkpoint keeps, so a
    restart goes on with it and no unit is flushed twice.  With wait_ms, a key that gets
    nothing for so long has its rest flushed as it is (whole: false); such a stream needs a
    trigger by time, as one that ends with what is available would wait for ever.  The state
    of a key is less than `size` units; deal units over as many keys as there are to be encoders.
    """

    def flush(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((group[0], done, False, held))
            held, done = [], done + 1
        for frame in frames:
            held += frame[unit].tolist()
            while len(held) >= size:
                out.append((group[0], done, True, held[:size]))
                held, done = held[size:], done + 1
        state.update((held, done))
        if held and wait_ms is not None:
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame(out, columns=[key, "flush", "whole", "units"])

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, stream[unit].cast("string").alias(unit))
    return rows.groupBy(key).applyInPandasWithState(flush, f"{key} {kind}, flush long, whole boolean, units array<string>", STATE, "append", GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
