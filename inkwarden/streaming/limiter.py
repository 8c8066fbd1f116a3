"""Sliding-window rate limiting: greedy, since a request counts only if it was accepted."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(times: Iterable[float], accepted: deque, window: float, most: int) -> list[bool]:
    """Whether each request, in order of time, is accepted; `accepted` holds the times that still count.  A
    request exactly `window` old counts."""
    out = []
    for t in times:
        while accepted and accepted[0] < t - window:
            accepted.popleft()
        out.append(len(accepted) < most)
        if out[-1]:
            accepted.append(t)
    return out


def limit(requests: DataFrame, key: str, ts: str = "ts", tie: str = "event_id", window: float = 60.0, most: int = 20) -> DataFrame:
    """requests with `accepted`.  State runs over all requests of a key in order of time, so each key is one
    group; a key's times stream through in batches of its sorted partition, never as one group in memory."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", accepted boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque()
        for batch in batches:
            seconds = batch[ts].astype("datetime64[us]").astype("int64") / 1e6
            flags = []
            for k, t in zip(batch[key], seconds, strict=True):
                if k != current:
                    current, accepted = k, deque()
                flags += admit([t], accepted, window, most)
            yield batch.assign(accepted=flags)

    return requests.repartition(key).sortWithinPartitions(key, ts, tie).mapInPandas(run, columns)


def limit_stream(requests: DataFrame, key: str, ts: str = "ts", tie: str = "event_id", window: float = 60.0, most: int = 20, idle: str = "1 hour") -> DataFrame:
    """The same over a stream: accepted times are a key's state, which is dropped when the watermark passes
    `window` after its last request.  Requests of a micro-batch are ordered; late ones beyond the watermark go."""
    kind = requests.schema[key].dataType.simpleString()
    tie_kind = requests.schema[tie].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = deque(state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values([ts, tie])
        seconds = list(rows[ts].astype("datetime64[us]").astype("int64") / 1e6)
        flags = admit(seconds, accepted, window, most)
        state.update((list(accepted),))
        state.setTimeoutTimestamp(max(int((seconds[-1] + window) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], tie: rows[tie], "accepted": flags})

    kept = requests.withWatermark(ts, idle).groupBy(key)
    return kept.applyInPandasWithState(run, f"`{key}` {kind}, `{tie}` {tie_kind}, accepted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
