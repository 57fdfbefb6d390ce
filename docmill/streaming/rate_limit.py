"""Sliding rate limit: an event is admitted if fewer than ``limit`` admitted events of its key lie in the window before."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docmill.sources.stored import shipped

shipped(__name__)


def admit(times: list[float], limit: int, seconds: float, held: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Decisions for sorted times, and the admitted times that still count. At exactly ``seconds`` an event is out."""
    window, out = deque(held or ()), []
    for t in times:
        while window and window[0] <= t - seconds:
            window.popleft()
        ok = len(window) < limit
        if ok:
            window.append(t)
        out.append(ok)
    return out, list(window)


def rate_limit(events: DataFrame, key: str, ts: str, event: str, limit: int = 60, seconds: float = 60.0) -> DataFrame:
    """key, event, admitted over a table. A decision depends on the ones before it, so each key runs in time order.

    Events are dealt by key and sorted within partitions; one Arrow map goes along and holds the admitted times of the current key's window
    (``limit`` at most) and nothing else. A key runs in one task, as its order demands, however many events it has. Null keys are one key."""
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    own = events.select(key, event, t.alias("t")).repartition(key).sortWithinPartitions(key, "t", event)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def run(batches):
        import pyarrow as pa

        current, held = object(), []
        for batch in batches:
            keys, times, out = batch.column(key).to_pylist(), batch.column("t").to_pylist(), []
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != current:
                    current, held = keys[at], []
                made, held = admit(times[at:end], limit, seconds, held)
                out += made
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(event), pa.array(out, pa.bool_())], [key, event, "admitted"])

    return own.mapInArrow(run, f"{key} {kinds[key]}, {event} {kinds[event]}, admitted boolean")


class Limiter(StatefulProcessor):
    """The same over a stream, in event time: rows wait in a key's state until the watermark has passed them, and are decided in order then.

    State: the waiting rows, and the admitted times of the last window, which go when the watermark is a window past the last of them."""

    def __init__(self, key: str, event: str, kind: str, limit: int, seconds: float):
        self.key, self.event, self.kind, self.limit, self.seconds = key, event, kind, limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"t long, event {self.kind}")
        self.window = handle.getValueState("window", "times array<double>")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        new = [r for pdf in rows for r in zip(pdf["t"].tolist(), pdf[self.event].tolist(), strict=True)]
        self.waiting.appendList(new)
        for ms in {t // 1000 + 1 for t, _ in new}:  # the watermark that is past a row
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        due = [r for r in rows if r[0] // 1000 < now]
        held = [float(t) for t in self.window.get()[0]] if self.window.exists() else []
        if due:
            left = rows[len(due) :]
            self.waiting.put(left) if left else self.waiting.clear()
            decisions, held = admit([t / 1e6 for t, _ in due], self.limit, self.seconds, held)
            yield pd.DataFrame({self.key: [key[0]] * len(due), self.event: [e for _, e in due], "admitted": decisions})
        until = int((held[-1] + self.seconds) * 1000) + 1 if held else 0
        if until <= now:
            self.window.clear()
        else:
            self.window.update((held,))
            if due:
                self.handle.registerTimer(until)

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, key: str, ts: str, event: str, limit: int = 60, seconds: float = 60.0, late: str = "1 minute") -> DataFrame:
    """key, event, admitted of a stream: what :func:`rate_limit` gives for all rows that are not later than ``late``, whatever their order and batches.

    A row comes out once the watermark (the latest time seen less ``late``) is past it; rows that come after that are dropped by Spark, as
    their decisions would change others that are out. Equal times are in order of ``event``. Needs the RocksDB state store."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    own = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(key, event, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    limiter = Limiter(key, event, kinds[event], limit, seconds)
    return own.groupBy(key).transformWithStateInPandas(statefulProcessor=limiter, outputStructType=f"{key} {kinds[key]}, {event} {kinds[event]}, admitted boolean", outputMode="Append", timeMode="EventTime")
