"""Review as a stream: the state of each cell (record number and field) under decisions that come in any order.

Decisions wait in the cell's state until the watermark has passed their time; then they are taken in the order of time and id,
each once. So the outcome doesn't depend on the order in which they came, as long as none is later than the watermark allows,
and a restart goes on from the stored state. An undone decision brings back what was before it. A cell that was handed in for
review and has no decision within a given time is reported as stale, by a timer of event time.

The state store has to be RocksDB's: set STATE_STORE in the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What a decision makes of a cell.
STATES = {"submitted": "pending", "approved": "human_approved", "edited": "human_approved", "rejected": "human_rejected"}
OUT = "sku string, field_key string, ts timestamp, decision_id long, decision string, state string, new_value string"


class Cells(StatefulProcessor):
    """State of a cell: waiting decisions by time and id, and the stack of those in force."""

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, decision_id long", "decision string, new_value string")
        self.taken = handle.getListState("taken", "ms long, decision_id long, decision string, new_value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ms, i, decision, value in zip((part["ts"].astype("int64") // _UNIT[str(part["ts"].dtype)]).tolist(), part["decision_id"].tolist(), part["decision"].tolist(), part["new_value"].tolist(), strict=True):
                self.waiting.updateValue((ms, i), (decision, value))
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0], k[1], v[0], v[1]) for k, v in self.waiting.iterator() if k[0] <= now)
        taken = [tuple(x) for x in self.taken.get()] if self.taken.exists() else []
        out = []
        for ms, i, decision, value in due:
            self.waiting.removeKey((ms, i))
            if decision == "undone":
                if taken and taken[-1][2] != "submitted":
                    taken.pop()
            elif not any(t[:2] == (ms, i) for t in taken):
                taken.append((ms, i, decision, value))
                if decision == "submitted":
                    self.handle.registerTimer(ms + self.stale_ms)
            out.append(self._row(key, ms, i, decision, taken))
        if not due and taken and taken[-1][2] == "submitted" and taken[-1][0] + self.stale_ms <= now:
            out.append(self._row(key, now, taken[-1][1], "stale", taken))
        if due:
            if taken:
                self.taken.put(taken)
            else:
                self.taken.clear()
        return iter([pd.DataFrame(out, columns=["sku", "field_key", "ts", "decision_id", "decision", "state", "new_value"])] if out else [])

    @staticmethod
    def _row(key: Any, ms: int, i: int, decision: str, taken: list[tuple]) -> tuple:
        state, value = ("stale", None) if decision == "stale" else (STATES[taken[-1][2]], taken[-1][3]) if taken else ("machine", None)
        return key[0], key[1], pd.Timestamp(ms, unit="ms"), i, decision, state, value

    def close(self) -> None:
        pass


_UNIT = {"datetime64[ns]": 10**6, "datetime64[us]": 10**3, "datetime64[ms]": 1}


def cells(decisions: DataFrame, late: str = "1 hour", stale: str = "7 days") -> DataFrame:
    """OUT: a row for each decision taken on a cell, with the state that it leaves the cell in, and one for each stale cell.

    decisions(sku, field_key, decision_id, ts, decision, new_value) of a stream; decision: submitted, approved, edited, rejected
    or undone, others and those with a null in sku, field_key, decision_id or ts are left out. A decision whose id came before at
    the same time counts once. What comes later than `late` behind the newest time is left out, by the watermark."""
    known = F.col("decision").isin(*STATES, "undone") & F.col("sku").isNotNull() & F.col("field_key").isNotNull() & F.col("decision_id").isNotNull() & F.col("ts").isNotNull()
    rows = decisions.filter(known).select("sku", "field_key", F.col("decision_id").cast("long").alias("decision_id"), F.date_trunc("millisecond", "ts").alias("ts"), "decision", F.col("new_value").cast("string").alias("new_value"))
    wait = int(pd.Timedelta(stale).total_seconds() * 1000)
    return rows.withWatermark("ts", late).groupBy("sku", "field_key").transformWithStateInPandas(statefulProcessor=Cells(wait), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def settled(taken: DataFrame) -> DataFrame:
    """The last row of each cell of what cells() gave, stale reports aside: sku, field_key, decision_id, ts, decision, state, new_value."""
    last = F.max(F.struct("ts", "decision_id", "decision", "state", "new_value")).alias("d")
    return taken.filter("decision <> 'stale'").groupBy("sku", "field_key").agg(last).select("sku", "field_key", "d.*")
