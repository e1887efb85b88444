"""The change feed: bursts of file events, and state machines over event streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(changes: DataFrame, quiet: str = "3 seconds", late: str | None = None) -> DataFrame:
    """One trigger for each burst of changes (project_id, ts, file_path): a burst ends when nothing comes for ``quiet``.

    The same plan serves a batch and a stream; a stream needs ``late``, the delay until a burst counts as over.
    """
    own = changes.withWatermark("ts", late) if late else changes
    return own.groupBy("project_id", F.session_window("ts", quiet)).agg(F.count("*").alias("changes"), F.min("ts").alias("first"), F.max("ts").alias("last")).select("project_id", "first", "last", "changes")


def states(events: DataFrame, key: str, transitions: list[tuple[str, str, str]], start: str) -> DataFrame:
    """A stream of (key, state, changes) from a stream of events (key string, seq long, action): the state is kept per key.

    Within a micro-batch events apply in order of seq; an action that doesn't fit the state is ignored.
    """
    table = {(a, act): b for a, act, b in transitions}

    def step(k: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        now, changes = state.get if state.exists else (start, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for action in rows["action"]:
            if (now, action) in table:
                now, changes = table[now, action], changes + 1
        state.update((now, changes))
        yield pd.DataFrame({key: [k[0]], "state": [now], "changes": [changes]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, state string, changes long", "state string, changes long", "update", "NoTimeout")
