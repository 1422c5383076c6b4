"""A moving-window rate limit: only accepted hits count, so it is a fold in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACCEPTED = "client long, path string, event_id long, ok boolean"


def _fold(held: list[float], at: float, limit: int, window_s: float) -> bool:
    """Drops what has left the window; accepts and keeps the hit if there is room."""
    while held and held[0] <= at - window_s:
        held.pop(0)
    if len(held) < limit:
        held.append(at)
        return True
    return False


def accepted(hits: DataFrame, limit: int = 60, window_s: float = 60.0) -> DataFrame:
    """client, path, event_id, ok: the verdict on every hit (client, path, event_id, ts).

    Hits of a key are met in order of time from sorted partitions, batch by batch; what is
    held is at most ``limit`` instants, however many hits a key has.
    """
    from pyspark.sql import functions as F

    ordered = hits.select("client", "path", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")).repartition("client", "path").sortWithinPartitions("client", "path", "at", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            ok = []
            for client, path, at in zip(batch["client"], batch["path"], batch["at"], strict=True):
                if (client, path) != key:
                    key, held = (client, path), []
                ok.append(_fold(held, at, limit, window_s))
            yield batch[["client", "path", "event_id"]].assign(ok=ok)

    return ordered.mapInPandas(run, ACCEPTED)


def accepted_stream(hits: DataFrame, limit: int = 60, window_s: float = 60.0) -> DataFrame:
    """The same over a stream: the state of a key is its accepted instants."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ok = [_fold(held, t.timestamp(), limit, window_s) for t in rows["ts"]]
        state.update((held,))
        yield pd.DataFrame({"client": key[0], "path": key[1], "event_id": rows["event_id"].to_numpy(), "ok": ok})

    return hits.groupBy("client", "path").applyInPandasWithState(step, ACCEPTED, "held array<double>", "append", GroupStateTimeout.NoTimeout)
