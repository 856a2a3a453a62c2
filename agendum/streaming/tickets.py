"""S8 on a stream: the meeting of ticket updates, kept as state.

Flat updates name a ticket but no meeting. The created topic fills a keyed state
ticket -> meeting (State API v2), updates read it; the ticket table, if there is
one, is the initial state. An update that comes before its ticket waits until the
watermark reaches its event time, the tolerance late rows have anyway; if the
ticket is still unknown then, the update goes out without a meeting. A ticket's
state expires ``retention`` after its last event; tickets of the table stay until
they have one.

A ticket with most of the updates is split by ``salts``: updates are dealt by a
hash of the row, and what fills the state is copied to every salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT_SCHEMA = "ticket_id string, ts timestamp, meeting string, payload string"
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_JSON = {"timestampFormat": _TIME, "ignoreNullFields": "false"}


class MeetingOfTicket(StatefulProcessor):
    """Gives each update of a ticket its meeting."""

    def __init__(self, retention: str):
        self.retention_ms = int(pd.Timedelta(retention) / pd.Timedelta(milliseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meeting = handle.getValueState("meeting", "meeting string, expires_ms long")
        self.waiting = handle.getListState("waiting", "us long, payload string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = initialState["meeting"].dropna()
        if len(known):
            self.meeting.update((known.iloc[0], 0))     # expires once it has events

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known, expires = self.meeting.get() if self.meeting.exists() else (None, 0)
        if known is not None and 0 < expires <= now:     # its timer fires after this batch's rows
            self.meeting.clear()
            known, expires = None, 0
        early: list[pd.DataFrame] = []
        latest = now
        for chunk in rows:
            latest = max(latest, int(chunk["us"].max()) // 1000)
            fills = chunk.loc[chunk["meeting"].notna(), "meeting"]
            if known is None and len(fills):
                known = fills.iloc[0]
            chunk = chunk[chunk["emit"]]
            # An event that names its meeting itself keeps that one.
            named = chunk["meeting"].notna()
            if known is not None:
                yield self._frame(key, chunk["us"], chunk["meeting"].fillna(known), chunk["payload"])
            else:
                yield self._frame(key, chunk.loc[named, "us"], chunk.loc[named, "meeting"], chunk.loc[named, "payload"])
                early.append(chunk.loc[~named, ["us", "payload"]])
        if known is None:
            waiting = [(int(us), p) for part in early for us, p in part.itertuples(index=False)]
            if waiting:
                self.waiting.appendList(waiting)
                for us in {us // 1000 for us, _ in waiting}:
                    self.handle.registerTimer(max(us, now + 1))
            return
        held = [w for part in early for w in part.itertuples(index=False)]
        held += list(self.waiting.get()) if self.waiting.exists() else []
        self.waiting.clear()
        if held:
            us = pd.Series([int(w[0]) for w in held]).clip(lower=now * 1000)
            yield self._frame(key, us, pd.Series([known] * len(held)), pd.Series([w[1] for w in held]))
        self._keep(known, latest, expires)

    def _keep(self, meeting: str, now: int, before: int = 0) -> None:
        expires = max(now + self.retention_ms, before)
        self.meeting.update((meeting, expires))
        if expires != before:
            self.handle.registerTimer(expires)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.meeting.exists() and 0 < self.meeting.get()[1] <= at:
            self.meeting.clear()
        if self.waiting.exists():
            held = list(self.waiting.get())
            due = [w for w in held if int(w[0]) // 1000 <= at]
            rest = [(int(w[0]), w[1]) for w in held if int(w[0]) // 1000 > at]
            if due:
                self.waiting.put(rest) if rest else self.waiting.clear()
                now = timerValues.getCurrentWatermarkInMs()
                us = pd.Series([int(w[0]) for w in due]).clip(lower=now * 1000)
                yield self._frame(key, us, pd.Series([None] * len(due), dtype=object), pd.Series([w[1] for w in due]))

    @staticmethod
    def _frame(key, us: pd.Series, meeting: pd.Series, payload: pd.Series) -> pd.DataFrame:
        plain = lambda values: pd.Series(list(values), dtype=object)
        return pd.DataFrame({"ticket_id": plain([key[0]] * len(us)), "ts": pd.to_datetime(us.to_numpy(), unit="us").astype("datetime64[us]"),
                             "meeting": plain(None if pd.isna(m) else m for m in meeting), "payload": plain(payload)})

    def close(self) -> None:
        pass


def resolve_meetings(events: DataFrame, tickets: DataFrame | None = None, retention: str = "30 days", salts: int = 8) -> DataFrame:
    """``events`` (a stream with a watermark on ``ts``, ticket_id, meeting_id, and
    event_type ``created`` or ``updated``) with the meeting of updates filled in.
    Rows keep their columns; ``ts`` of a row that had to wait is not below the
    watermark when it goes out. ``tickets``: ticket_id, meeting_id of older tickets."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in events.columns]), F.lit(salts)).cast("int")
    payload = F.to_json(F.struct(*[F.col(c) for c in events.columns if c != "ts"]), _JSON)
    copies = F.when(F.col("meeting_id").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.struct(s.alias("salt"), (s == F.col("own")).alias("emit"))))
    rows = (events.filter(F.col("ticket_id").isNotNull()).withColumn("own", salt).withColumn("payload", payload)
            .withColumn("__c", F.explode(F.coalesce(copies, F.array(F.struct(F.col("own").alias("salt"), F.lit(True).alias("emit"))))))
            .select("ticket_id", F.col("__c.salt").alias("salt"), "ts", F.unix_micros("ts").alias("us"), F.col("__c.emit").alias("emit"),
                    F.col("meeting_id").cast("string").alias("meeting"), "payload"))
    initial = None
    if tickets is not None:
        known = tickets.filter(F.col("meeting_id").isNotNull()).groupBy("ticket_id").agg(F.min("meeting_id").cast("string").alias("meeting"))
        initial = known.select("ticket_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "meeting").groupBy("ticket_id", "salt")
    out = rows.groupBy("ticket_id", "salt").transformWithStateInPandas(
        MeetingOfTicket(retention), OUTPUT_SCHEMA, "append", "EventTime", initialState=initial, eventTimeColumnName="ts")
    fields = events.drop("ts").schema
    body = out.select("ts", F.col("meeting").cast("long").alias("__m"), F.from_json("payload", fields, {"timestampFormat": _TIME}).alias("p"))
    return body.select(*[F.col("__m").alias(c) if c == "meeting_id" else F.col("ts") if c == "ts" else F.col(f"p.{c}") for c in events.columns])
