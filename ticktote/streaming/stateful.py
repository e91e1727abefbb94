"""Keyed state processors for streams: rows wait for the watermark, leave in event-time order, and idle keys are cleared.

Each row goes into its key's buffer. An event-time timer at the earliest buffered row fires once the watermark has
passed it; then all rows before the watermark are processed in the order (ts, event_id), whatever files, batches or
Arrow chunks they came in. The buffer of a key holds what lies between the watermark and the newest row as packed pieces
of an hour, so a release touches the hours that are due and no others. Rows are only ever held in Python as arrays of
PIECE_ROWS, or of one hour if that has more: neither a batch nor a release of a whole key is in memory at once.

A key starts anew with the first row that comes more than idle_ms of event time after its last one. That is decided
row by row, so it does not depend on how rows fall into batches; the timer of an idle key only frees its memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

IDLE_MS = 90 * 24 * 3600 * 1000
HOUR_US = 3600 * 1_000_000
#: rows that are packed, or processed, together
PIECE_ROWS = 1 << 17
ROW = np.dtype([("us", "<i8"), ("event_id", "<i8"), ("value", "<f8")])


class _Base(StatefulProcessor):
    fields: list[tuple] = []

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("s", StructType([StructField(n, t) for n, t in [*self.fields, ("last_ms", LongType())]]))
        place = StructType([StructField("hour", LongType()), StructField("piece", LongType())])
        self.buffer = handle.getMapState("b", place, StructType([StructField("rows", BinaryType())]))
        self.pieces = handle.getValueState("n", StructType([StructField("n", LongType())]))

    def initial(self) -> list:
        raise NotImplementedError

    def step(self, key, p: pd.DataFrame, s: list) -> pd.DataFrame:
        """Output of rows in order; s, the state, is changed in place."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunks, held, piece, first = [], 0, self.pieces.get()[0] if self.pieces.exists() else 0, None

        def pack() -> None:
            nonlocal chunks, held, piece
            a = np.concatenate(chunks)
            chunks, held = [], 0
            hour = a["us"] // HOUR_US
            a, hour = a[np.argsort(hour, kind="stable")], np.sort(hour)
            edges = np.flatnonzero(np.diff(hour)) + 1
            for at, part in zip([0, *edges.tolist()], np.split(a, edges)):
                self.buffer.updateValue((int(hour[at]), piece), (part.tobytes(),))
            piece += 1

        for p in rows:
            p = p[p["event_id"].notna()]  # an end mark is not a row
            if len(p):
                a = np.empty(len(p), ROW)
                a["us"] = p["ts"].to_numpy().astype("datetime64[us]").astype("int64")
                a["event_id"], a["value"] = p["event_id"].astype("int64"), p["value"].astype("float64")
                first = int(a["us"].min()) if first is None else min(first, int(a["us"].min()))
                chunks.append(a)
                held += len(a)
                if held >= PIECE_ROWS:
                    pack()
        if chunks:
            pack()
        if first is not None:
            self.pieces.update((piece,))
            self.handle.registerTimer(first // 1000)
        return iter(())

    def _due(self, until: int, after: list[int | None]) -> Iterator[np.ndarray]:
        """Rows before the watermark in order, some hours at a time; after[0] is the time of the first row that stays."""
        hours: dict[int, list[int]] = {}
        for hour, piece in self.buffer.keys():
            hours.setdefault(hour, []).append(piece)
        ready, size = [], 0
        for hour in sorted(hours):
            if hour * HOUR_US // 1000 >= until:
                after[0] = hour * HOUR_US
                break
            a = np.concatenate([np.frombuffer(self.buffer.getValue((hour, i))[0], ROW) for i in sorted(hours[hour])])
            for i in hours[hour]:
                self.buffer.removeKey((hour, i))
            stays = a["us"] // 1000 >= until
            if stays.any():
                rest, a = a[stays], a[~stays]
                self.buffer.updateValue((hour, min(hours[hour])), (rest.tobytes(),))
                after[0] = int(rest["us"].min())
            if len(a):
                ready.append(a[np.lexsort((a["value"], a["event_id"], a["us"]))])
                size += len(a)
            if size >= PIECE_ROWS:
                yield np.concatenate(ready)
                ready, size = [], 0
            if stays.any():
                break
        if ready:
            yield np.concatenate(ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, after, any_row = timerValues.getCurrentWatermarkInMs(), [None], False
        state = list(self.state.get()) if self.state.exists() else None
        for a in self._due(until, after):
            p = pd.DataFrame({n: a[n] for n in ROW.names})
            p["ts"] = pd.to_datetime(p["us"], unit="us")
            ms = p["us"] // 1000
            last = state[-1] if state else int(ms.iloc[0])
            life = (ms.diff().fillna(ms.iloc[0] - last) > self.idle_ms).cumsum()
            s = state[:-1] if state else self.initial()
            for n, part in p.groupby(life, sort=True):
                s = self.initial() if n else s
                yield self.step(key, part.reset_index(drop=True), s)
            state, any_row = [*s, int(ms.iloc[-1])], True
        if any_row:
            self.state.update(tuple(state))
            self.handle.registerTimer(state[-1] + self.idle_ms + 1)
        if after[0] is not None:
            self.handle.registerTimer(after[0] // 1000)
        elif state is not None and state[-1] + self.idle_ms < until:
            self.state.clear()

    def close(self) -> None:
        pass


class SurgeAlert(_Base):
    """Change against the previous value of the key, and the verdict of the surge limits."""

    fields = [("last", DoubleType())]

    def initial(self) -> list:
        return [None]

    def step(self, key, p, s) -> pd.DataFrame:
        prev = p["value"].shift(1)
        prev.iloc[0] = s[0] if s[0] is not None else float("nan")
        chg = p["value"] / prev.where(prev > 0) - 1  # a base of zero or less is no history
        verdict = pd.cut(chg, [-float("inf"), 0.05, 0.10, 0.20, float("inf")], right=False, labels=["normal", "minor", "half", "cancel"]).astype(object)
        s[0] = float(p["value"].iloc[-1])
        return pd.DataFrame({"key": key[0], "event_id": p["event_id"].to_numpy(), "change": chg.to_numpy(), "verdict": verdict.where(chg.notna(), "no history").to_numpy()})


class RiskLedger(_Base):
    """Balance, peak, day and week result, losing streak and halt after each trade."""

    fields = [("balance", DoubleType()), ("peak", DoubleType()), ("day", StringType()), ("day_pnl", DoubleType()), ("week", StringType()), ("week_pnl", DoubleType()), ("streak", IntegerType()), ("halted", IntegerType())]
    start, max_day, max_week, max_dd = 10000.0, 0.05, 0.10, 0.15

    def initial(self) -> list:
        return [self.start, self.start, "", 0.0, "", 0.0, 0, 0]

    def step(self, key, p, s) -> pd.DataFrame:
        out = []
        days, weeks = p["ts"].dt.strftime("%Y-%m-%d"), p["ts"].dt.strftime("%G-%V")
        for eid, pnl, d, w in zip(p["event_id"], p["value"], days, weeks):
            if d != s[2]:
                s[2], s[3] = d, 0.0
            if w != s[4]:
                s[4], s[5] = w, 0.0
            s[0] += pnl
            s[1] = max(s[1], s[0])
            s[3] += pnl
            s[5] += pnl
            s[6] = s[6] + 1 if pnl < 0 else (0 if pnl > 0 else s[6])
            dd = (s[1] - s[0]) / s[1] if s[1] > 0 else 0.0
            s[7] = int(s[7] or dd >= self.max_dd)
            why = "halted" if s[7] else "daily loss" if -min(0.0, s[3]) / self.start >= self.max_day else "weekly loss" if -min(0.0, s[5]) / self.start >= self.max_week else "streak" if s[6] >= 7 else "OK"
            out.append((key[0], int(eid), s[0], dd, s[6], why))
        return pd.DataFrame(out, columns=["key", "event_id", "balance", "drawdown", "streak", "verdict"])


class PairPosition(_Base):
    """Position by z-score: opens beyond entry, closes inside exit or beyond stop."""

    fields = [("pos", IntegerType())]

    def initial(self) -> list:
        return [0]

    def step(self, key, p, s) -> pd.DataFrame:
        out = []
        for eid, z in zip(p["event_id"], p["value"]):
            a = abs(z)
            if a >= 4.0 or (s[0] and a <= 0.5):
                s[0] = 0
            elif not s[0]:
                s[0] = 2 if z >= 2.0 else 1 if z <= -2.0 else 0
            out.append((key[0], int(eid), float(z), s[0]))
        return pd.DataFrame(out, columns=["key", "event_id", "z", "position"])


class HealthMonitor(_Base):
    """Accuracy of the last n outcomes and the current run of losses, with stop reasons."""

    fields = [("ring", StringType()), ("losses", IntegerType())]
    n, stop, max_losses = 100, 0.45, 8

    def initial(self) -> list:
        return ["", 0]

    def step(self, key, p, s) -> pd.DataFrame:
        out = []
        for eid, ok in zip(p["event_id"], p["value"] > 0):
            s[0] = (s[0] + ("1" if ok else "0"))[-self.n :]
            s[1] = 0 if ok else s[1] + 1
            acc = s[0].count("1") / self.n if len(s[0]) == self.n else None
            why = ";".join(x for x in ("accuracy" if acc is not None and acc < self.stop else "", "losses" if s[1] >= self.max_losses else "") if x)
            out.append((key[0], int(eid), acc, s[1], why))
        return pd.DataFrame(out, columns=["key", "event_id", "accuracy", "losses", "reasons"]).astype({"accuracy": "float64"})


OUT = {
    SurgeAlert: "key string, event_id bigint, change double, verdict string",
    RiskLedger: "key string, event_id bigint, balance double, drawdown double, streak int, verdict string",
    PairPosition: "key string, event_id bigint, z double, position int",
    HealthMonitor: "key string, event_id bigint, accuracy double, losses int, reasons string",
}


def process(ticks: DataFrame, key: str, processor: type[_Base], late: str = "10 minutes", idle_ms: int = IDLE_MS) -> DataFrame:
    """Run a processor per key; rows need ts, event_id and value. Rows come out once the watermark has passed them."""
    rows = ticks.select(key, "ts", "event_id", "value").withWatermark("ts", late)
    return rows.groupBy(key).transformWithStateInPandas(processor(idle_ms), OUT[processor], "Append", "EventTime")
