"""Watch mode with timers: bursts of re-scans of a file are debounced, and its findings are held until it is deleted."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "file_path string, change string, rule_id string, line int, severity string, seq long"
COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
FOUND = "array<struct<rule_id:string,line:int,severity:string>>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watch(StatefulProcessor):
    """State of one file: ``held``, its findings by rule and line, and ``waiting``, the newest re-scan of a burst.

    A re-scan waits ``gap`` milliseconds of event time for a newer one; a timer ends the burst. Then the findings that
    were not held are new, and held ones that it lacks are resolved. A deleted file resolves all, and leaves no state; a
    file that nobody has saved for ``ttl`` milliseconds is forgotten without a word (0: never).
    """

    def __init__(self, gap: int, ttl: int):
        self.gap, self.ttl = gap, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "rule_id string, line int", "severity string", self.ttl or None)
        self.waiting = handle.getValueState("waiting", f"at long, seq long, deleted boolean, findings {FOUND}", self.ttl or None)

    def _settle(self, path: str) -> list[tuple]:
        """End the burst that waits: what it changed."""
        _, seq, deleted, findings = self.waiting.get()
        self.waiting.clear()
        now = {} if deleted else {(f[0], int(f[1])): f[2] for f in (findings if findings is not None else [])}
        before = {(k[0], int(k[1])): v[0] for k, v in self.held.iterator()} if self.held.exists() else {}
        out = [(path, "new", r, n, s, seq) for (r, n), s in sorted(now.items()) if (r, n) not in before]
        out += [(path, "resolved", r, n, s, seq) for (r, n), s in sorted(before.items()) if (r, n) not in now]
        for key in before.keys() - now.keys():
            self.held.removeKey(key)
        for key, severity in now.items():
            self.held.updateValue(key, (severity,))
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        new = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        for at, seq, deleted, findings in zip(new["ts"], new["seq"], new["deleted"], new["findings"]):
            at = int(at.timestamp() * 1000)
            if self.waiting.exists() and at - self.waiting.get()[0] >= self.gap:
                out += self._settle(key[0])
            found = [(f["rule_id"], int(f["line"]), f["severity"]) for f in (findings if findings is not None else [])]
            self.waiting.update((at, int(seq), bool(deleted), found))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self.waiting.get()[0] + self.gap)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self._settle(key[0]) if self.waiting.exists() else [], columns=COLUMNS)

    def close(self) -> None:
        pass


def watch(rescans: DataFrame, gap: int = 100, late: str = "1 second", ttl: int = 0) -> DataFrame:
    """New and resolved findings of debounced re-scans: (file_path, ts timestamp, seq, deleted, findings) as a stream.

    gap is in milliseconds of event time. The session keeps its state in RocksDB, which such state needs.
    """
    rescans.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = rescans.withWatermark("ts", late).groupBy("file_path")
    return keyed.transformWithStateInPandas(Watch(gap, ttl), CHANGES, "Append", "EventTime")


def running_totals(changes: DataFrame) -> DataFrame:
    """(severity, held): how many findings are held after all of the changes, for severities that were ever seen."""
    return changes.groupBy("severity").agg(F.sum(F.when(F.col("change") == "new", 1).otherwise(-1)).alias("held"))
