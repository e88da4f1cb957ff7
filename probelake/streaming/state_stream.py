"""The state fold as a stream, equal to the batch fold on the same order: the whole state, and one pair alone.

Lateness is a rule of each entity (an hour behind its own latest event moves nothing),
not a watermark. An entity expires at the first midnight more than ten days after its
latest event, as the daily chain has it: its next observation finds nothing of it, and an
event-time timer frees the state, for which the stream carries a loose watermark.

The whole state starts from a stored snapshot (initial state) and is read back as one from
the checkpoint at any time, so a stream and the daily chain can take over from each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from probelake.functions import schema as S
from probelake.operators import state as batch_state

OUTPUT = "key string, time long, updated long, logged long, secure int, bogus int, result int, emitted boolean"
_STATE = "updated long, logged long, secure int, bogus int, result int"


def step_pair(secure: int, bogus: int, result: int, kind: str | None, ok: bool) -> tuple[int, int, int]:
    """A pair's states after an answer of its 'secure' or 'bogus' probe."""
    if kind == "secure":
        secure = S.CAN if ok else S.CANNOT
        if ok:
            result = S.CAN if bogus == S.CANNOT else S.CANNOT if bogus == S.CAN else result
        elif bogus != S.UNKNOWN:
            result = S.BROKEN
    elif kind == "bogus":
        bogus = S.CAN if ok else S.CANNOT
        if secure == S.CAN:
            result = S.CANNOT if ok else S.CAN
    return secure, bogus, result


def step_clock(updated: int, logged: int, time: int) -> tuple[int, int, bool]:
    """The throttle: (updated, logged, emitted)."""
    if updated == 0:
        return time, time, False
    if updated - time > S.LATE:
        return updated, logged, False
    updated = max(updated, time)
    if updated - logged > S.QUIET:
        return updated, time, True
    return updated, logged, False


class PairProcessor(StatefulProcessor):
    """Rows key, time, seq, kind ('secure', 'bogus' or other), ok; in each batch taken by (time, seq)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["time", "seq"], kind="stable")
        updated, logged, secure, bogus, result = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0)
        out = []
        for t, kind, ok in zip(batch["time"], batch["kind"], batch["ok"], strict=True):
            secure, bogus, result = step_pair(secure, bogus, result, kind, bool(ok))
            updated, logged, emitted = step_clock(updated, logged, int(t))
            out.append((key[0], int(t), updated, logged, secure, bogus, result, emitted))
        self.state.update((updated, logged, secure, bogus, result))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((updated + S.KEEP_DAYS * 86_400) * 1000)
        yield pd.DataFrame(out, columns=["key", "time", "updated", "logged", "secure", "bogus", "result", "emitted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "time": pd.Series(dtype="int64"), "updated": pd.Series(dtype="int64"), "logged": pd.Series(dtype="int64"), "secure": pd.Series(dtype="int32"), "bogus": pd.Series(dtype="int32"), "result": pd.Series(dtype="int32"), "emitted": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def state_stream(events: DataFrame, event_time: str = "ts", watermark: str = "1 day") -> DataFrame:
    """``events``: a stream with key, ts, time (seconds), seq, kind, ok. Needs the RocksDB state store provider."""
    return (
        events.withWatermark(event_time, watermark).groupBy("key")
        .transformWithStateInPandas(PairProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    )


# --- the whole state ---------------------------------------------------------

_BINARY = ("whoami_g", "whoami_a", "whoami_6")
_KINDS = {c: "binary" if c in _BINARY else "array<binary>" if c == "hijacked" else "int" for c in batch_state.SNAPSHOT_STATES}
WHOLE_STATE = ", ".join([*[f"{c} {k}" for c, k in _KINDS.items()], "updated long", "logged long"])
TIMELINE = ", ".join(["prb_id long", "addr binary", "updated long", *[f"{c} {k}" for c, k in _KINDS.items()]])
_DAY = 86_400


def unknown() -> dict:
    """The state of an entity of which nothing is known."""
    return {c: None if c in _BINARY else [] if c == "hijacked" else S.UNKNOWN for c in _KINDS} | {"updated": 0, "logged": 0}


def expiry(updated: int) -> int:
    """The first midnight at which the daily chain carries an entity no more."""
    return ((updated + S.KEEP_DAYS * _DAY) // _DAY + 1) * _DAY


def anchor(said: int, holds: bool, if_can: int, if_cannot: int) -> int:
    """A trust anchor's state after a sentinel's answer: what it means if ``holds``, else unknown."""
    return S.UNKNOWN if not holds else if_can if said == S.CAN else if_cannot


def step(s: dict, row: dict) -> bool:
    """One observation, as ``state.observed`` has it (what it says, without nulls), and the clock; is the state emitted?"""
    for c, value in row.items():
        if c in _KINDS:
            s[c] = value
    for p in S.PAIRS:
        for kind, short in (("secure", "s"), ("bogus", "b")):
            if (said := row.get(f"{p}_{short}")) is not None:
                names = f"{p}_secure", f"{p}_bogus", f"{p}_result"
                s |= zip(names, step_pair(*(s[n] for n in names), kind, said == S.CAN), strict=True)
    if (said := row.get("not_ta_20326")) is not None:
        s["has_ta_20326"] = anchor(said, said == S.CANNOT and s[f"{S.RSASHA256}_result"] == S.CAN, S.UNKNOWN, S.CAN)
    if (said := row.get("not_ta_19036")) is not None:
        s["has_ta_19036"] = anchor(said, s["has_ta_20326"] == S.CAN, S.CANNOT, S.CAN)
    s["updated"], s["logged"], emitted = step_clock(s["updated"], s["logged"], row["time"])
    return emitted


class StateProcessor(StatefulProcessor):
    """Rows of ``state.observed``; in each batch taken by (time, stream, seq). Emits the throttled timeline."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", WHOLE_STATE)

    def _load(self) -> dict:
        return dict(zip([*_KINDS, "updated", "logged"], self.state.get(), strict=True)) if self.state.exists() else unknown()

    def _store(self, s: dict) -> None:
        self.state.update(tuple(s.values()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(expiry(s["updated"]) * 1000)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0].to_dict()
        s = unknown()
        for c in s:
            v = row[c]
            s[c] = [bytes(x) for x in v] if c == "hijacked" else (None if v is None else bytes(v)) if c in _BINARY else int(v)
        self._store(s)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["time", "stream_ord", "seq"], kind="stable")
        s, out = self._load(), []
        for row in batch.to_dict("records"):
            said = {}
            for c, v in row.items():
                if isinstance(v, (bytes, bytearray)):
                    said[c] = bytes(v)
                elif hasattr(v, "__len__") and not isinstance(v, str):
                    said[c] = [bytes(x) for x in v]
                elif v is not None and v == v:  # a missing number is not equal to itself
                    said[c] = int(v) if isinstance(v, (int, float)) else v
            if s["updated"] and said["time"] >= expiry(s["updated"]) and expiry(s["updated"]) <= said["time"] // _DAY * _DAY:
                s = unknown()
            if step(s, said):
                out.append((*key, s["updated"], *[s[c] for c in _KINDS]))
        self._store(s)
        columns = ["prb_id", "addr", "updated", *_KINDS]
        yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype="Int64" if _KINDS.get(c, "long") in ("int", "long") and c != "addr" else object) for k, c in enumerate(columns)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def whole_state_stream(observations: DataFrame, initial: DataFrame | None = None, watermark: str = "1 day") -> DataFrame:
    """The throttled timeline of a stream of observations, with the whole state of every entity kept.

    ``initial``: a snapshot (of the daily chain, or read back by ``read_state``) that the
    state starts from. Needs the RocksDB state store provider.
    """
    rows = batch_state.observed(observations)
    rows = rows.drop(*[c for c in rows.columns if c.startswith("carried_") or c.endswith("_r")])
    timed = rows.withColumn("ts", F.timestamp_seconds("time")).withWatermark("ts", watermark)
    start = None if initial is None else initial.select(*batch_state.KEY, *_KINDS, "updated", "logged").groupBy(*batch_state.KEY)
    return timed.groupBy(*batch_state.KEY).transformWithStateInPandas(StateProcessor(), outputStructType=TIMELINE, outputMode="Append", timeMode="EventTime", initialState=start)


def read_state(spark: SparkSession, checkpoint: str, start=None) -> DataFrame:
    """The snapshot that a stream's last whole batch left; with ``start`` (a day), without what has expired by then."""
    rows = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
    snapshot = rows.select("key.*", "value.*").select(*batch_state.KEY, *_KINDS, "updated", "logged")
    return snapshot if start is None else snapshot.filter(F.col("updated") >= start.cast("timestamp").cast("long") - S.KEEP_DAYS * _DAY)


def day_batches(events: DataFrame, handle, checkpoint: str):
    """Daily micro-batches: ``handle(batch, number)`` for each, with everything available taken in order."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
