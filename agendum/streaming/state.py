"""Per-meeting running state on a stream (State API v2, RocksDB store).

Rows are reduced before they reach the state: an aggregate over (meeting, time
slot) turns a slot's segments into its pieces of runs, split at final markers, so
a meeting with most of the rows is spread over its slots and the state sees one
row a slot, whatever the number of segments. The state of a meeting holds
metadata and counters only, never text. A run's row is emitted when its final
marker arrives, or when event time passes ``last event + timeout`` (silent
disconnect, an event-time timer); the state is then removed.
``streaming.operators.meeting_runs`` is the batch twin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT_SCHEMA = ("meeting_id long, audio_id long, group_id long, n_partials long, n_chars long, "
                 "first_ts timestamp, last_ts timestamp, ended boolean")
STATE_SCHEMA = "audio_id string, group_id string, n_partials long, n_chars long, first_us long, last_us long"
PIECE = "struct<n_partials:bigint,n_chars:bigint,first_us:bigint,last_us:bigint,ended:boolean,audio:bigint,grp:bigint>"


def _pieces(rows: Column, timeout_us: int) -> Column:
    """Fold a slot's ordered (us, s, final, chars, audio, grp) into its pieces of runs."""
    def piece(r: Column, old: Column | None = None) -> Column:
        n, chars, first, audio, grp = (~r["final"]).cast("long"), r["chars"], r["us"], r["audio"], r["grp"]
        if old is not None:
            n, chars, first = old["n_partials"] + n, old["n_chars"] + chars, old["first_us"]
            audio, grp = F.least(old["audio"], audio), F.least(old["grp"], grp)
        return F.array(F.struct(n, chars, first, r["us"], r["final"], audio, grp).cast(PIECE))

    def step(done: Column, r: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        opens = (F.size(done) == 0) | last["ended"] | (r["us"] - last["last_us"] > timeout_us)
        return F.when(opens, F.concat(done, piece(r))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), piece(r, last)))
    return F.aggregate(rows, F.array().cast(f"array<{PIECE}>"), step)


def slot_pieces(segments: DataFrame, slot: str = "1 minute", timeout: str = "1 hour", ts: str = "ts") -> DataFrame:
    """One row per meeting and time slot with the slot's pieces of runs in order, as
    JSON. Segments are reduced to times, ids and lengths first; a slot holds what one
    meeting says in ``slot``."""
    timeout_us = int(pd.Timedelta(timeout) / pd.Timedelta(microseconds=1))
    final = ~F.coalesce(F.col("is_partial"), F.lit(False))
    row = F.struct(F.unix_micros(F.col(ts)).alias("us"), F.col("seq").alias("s"), final.alias("final"),
                   F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
                   F.col("audio_id").cast("long").alias("audio"), F.col("group_id").cast("long").alias("grp"))
    g = segments.groupBy(F.window(ts, slot).alias("slot"), "meeting_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return g.select("meeting_id", F.window_time("slot").alias("ts"), F.to_json(_pieces(F.col("rows"), timeout_us)).alias("pieces"))


class MeetingRuns(StatefulProcessor):
    """Joins the pieces of a meeting's slots into runs."""

    def __init__(self, timeout: str):
        self.timeout_us = int(pd.Timedelta(timeout) / pd.Timedelta(microseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slots = [json.loads(text) for chunk in rows for text in chunk["pieces"]]
        pieces = sorted((p for slot in slots for p in slot), key=lambda p: (p["first_us"], p["last_us"]))
        run = list(self.run.get()) if self.run.exists() else None
        done = []
        for p in pieces:
            if run is not None and p["first_us"] - run[5] > self.timeout_us:
                done.append(self._row(key, run, False))
                run = None
            ids = [str(p[n]) if p.get(n) is not None else None for n in ("audio", "grp")]
            if run is None:
                run = [*ids, p["n_partials"], p["n_chars"], p["first_us"], p["last_us"]]
            else:
                run = [*(min((x for x in (a, b) if x is not None), key=int, default=None) for a, b in zip(run[:2], ids, strict=True)),
                       run[2] + p["n_partials"], run[3] + p["n_chars"], min(run[4], p["first_us"]), max(run[5], p["last_us"])]
            if p["ended"]:
                done.append(self._row(key, run, True))
                run = None
        if run is None:
            self.run.clear()
        else:
            self.run.update(tuple(run))
            self.handle.registerTimer((run[5] + self.timeout_us) // 1000 + 1)
        yield self._frame(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = list(self.run.get()) if self.run.exists() else None
        # A timer of an earlier last event does not end a run that went on.
        if run is not None and (run[5] + self.timeout_us) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.run.clear()
            yield self._frame([self._row(key, run, False)])

    @staticmethod
    def _row(key, run, ended: bool) -> tuple:
        when = [pd.Timestamp(us, unit="us") for us in run[4:6]]
        return (key[0], *(None if i is None else int(i) for i in run[:2]), run[2], run[3], *when, ended)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [c.strip().split(" ")[0] for c in OUTPUT_SCHEMA.split(",")]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"meeting_id": "Int64", "audio_id": "Int64", "group_id": "Int64", "n_partials": "int64", "n_chars": "int64",
                           "first_ts": "datetime64[us]", "last_ts": "datetime64[us]", "ended": "bool"})

    def close(self) -> None:
        pass


def meeting_state(segments: DataFrame, timeout: str = "1 hour", watermark: str | None = "2 minutes",
                  ts: str = "ts", slot: str = "1 minute") -> DataFrame:
    """Runs of each meeting, append output. ``segments`` needs meeting_id,
    audio_id, group_id, seq, text, is_partial and a TIMESTAMP ``ts``."""
    from agendum.streaming.operators import watermarked
    slots = slot_pieces(watermarked(segments, ts, watermark), slot, timeout, ts)
    return slots.groupBy("meeting_id").transformWithStateInPandas(MeetingRuns(timeout), OUTPUT_SCHEMA, "append", "EventTime")
