"""Routing and handle expiry as stateful streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyrill.operators.router import Layers

#: The state store that transformWithState needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RouteProcessor(StatefulProcessor):
    """A key's two layers as state; rows of a batch are taken in seq order.

    A row whose seq is not above the last one seen came too late to be applied
    in order and gets the action LATE.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.layers = handle.getValueState("layers", "has_perm boolean, perm string, has_dyna boolean, dyna string, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.layers.get() if self.layers.exists() else (False, None, False, None, None)
        state, last = Layers((old[1],) if old[0] else None, (old[3],) if old[2] else None), old[4]
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        actions = []
        for seq, op, value in zip(frame["seq"], frame["op"], frame["value"], strict=True):
            if last is not None and seq <= last:
                actions.append("LATE")
                continue
            actions.append(state.apply(op, None if pd.isna(value) else value))
            last = int(seq)
        perm, dyna = state.perm, state.dyna
        self.layers.update((perm is not None, perm[0] if perm else None, dyna is not None, dyna[0] if dyna else None, last))
        yield pd.DataFrame({"seq": frame["seq"], "key": key[0], "action": actions})

    def close(self) -> None:
        pass


def route_stream(puts: DataFrame) -> DataFrame:
    """seq, key, action of a stream of (seq, key, op, value) puts."""
    return puts.groupBy("key").transformWithStateInPandas(RouteProcessor(), "seq long, key string, action string", "Append", "None")


def expiry_stream(accesses: DataFrame, handle: str, ts: str, timeout: str, lateness: str) -> DataFrame:
    """handle, start, end, accesses of handles that went idle for `timeout`."""
    rows = accesses.withWatermark(ts, lateness).groupBy(handle, F.session_window(ts, timeout).alias("w"))
    return rows.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("accesses")).select(handle, "start", "end", "accesses")
