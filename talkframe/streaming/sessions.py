"""Sessions over a stream of messages: state per conversation is the last time seen and where its session began.

State that is kept for good is a number for every conversation ever met. `expiring_sessions` lets it go: a session that
the watermark has passed by more than the gap can't be gone on with, so a timer drops it, and the next message of its
conversation opens a new one, as it would have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from talkframe.functions import lexicon as L

OUTPUT = "conv_id string, seq long, session_id long"
STATE = "last_us long, session_id long"


def number(rows: list[tuple[int, int | None]], last: int | None, session: int, gap_us: int) -> tuple[list[tuple[int, int]], int | None, int]:
    """Sessions of (seq, time in microseconds) rows in order, going on from a last time and session; times may be null."""
    out = []
    for seq, us in rows:
        if us is not None:
            if last is not None and not 0 <= us - last <= gap_us:
                session += 1
            last = us
        out.append((seq, session))
    return out, last, session


def stream_sessions(m: DataFrame, gap_minutes: int = L.SESSION_GAP_MINUTES) -> DataFrame:
    """conv_id, seq, session_id of a streaming messages frame, as messages arrive.

    Within a micro-batch rows go by seq; a message that comes late gets the session of its arrival and none is
    reordered, as in a batch a time that goes back opens a session.
    """
    gap_us = gap_minutes * 60_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, session = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        us = [None if pd.isna(t) else int(pd.Timestamp(t).value // 1000) for t in rows["ts"]]
        out, last, session = number(list(zip(rows["seq"].tolist(), us, strict=True)), None if last is None or pd.isna(last) else int(last), int(session), gap_us)
        state.update((last, session))
        yield pd.DataFrame([(key[0], s, n) for s, n in out], columns=["conv_id", "seq", "session_id"])

    return m.select("conv_id", "seq", "ts").groupBy("conv_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def gap_windows(m: DataFrame, late: str = "1 day", gap_minutes: int = L.SESSION_GAP_MINUTES) -> DataFrame:
    """Session windows of messages that come in order, with a watermark that lets old state go."""
    timed = m.where("ts IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("conv_id", F.session_window("at", f"{gap_minutes} minutes")).agg(F.count("*").alias("messages")).select("conv_id", F.col("session_window.start").alias("started"), "messages")


class _Openings(StatefulProcessor):
    """Of each message the number of the one that opened its session; a timer drops what can't go on."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "last_us long, opened long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        last, opened = self.state.get() if self.state.exists() else (None, None)
        last = None if last is None or pd.isna(last) else int(last)
        batch = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, us in zip(batch["seq"].tolist(), batch["us"].tolist(), strict=True):
            us = None if us is None or pd.isna(us) else int(us)
            if opened is None or (us is not None and last is not None and not 0 <= us - last <= self.gap_us):
                opened = seq
            last = last if us is None else us
            out.append((key[0], seq, int(opened)))
        self.state.update((last, int(opened)))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if last is not None:
            self.handle.registerTimer((last + self.gap_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["conv_id", "seq", "opened"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        self.state.clear()
        yield pd.DataFrame({"conv_id": pd.Series([], dtype="str"), "seq": pd.Series([], dtype="int64"), "opened": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def expiring_sessions(m: DataFrame, late: str = "1 hour", gap_minutes: int = L.SESSION_GAP_MINUTES) -> DataFrame:
    """conv_id, seq and opened, the seq of the message that opened its session, of a streaming messages frame.

    Messages of a micro-batch go by seq. A conversation's state goes once the watermark, `late` behind the latest time
    seen, is beyond its last time by the gap; until then it is what the batch rule has. A timed message behind the
    watermark is dropped; one without a time goes on with the session that is known, and opens one where none is.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = m.select("conv_id", "seq", F.col("ts").cast("timestamp").alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withWatermark("at", late)
    return rows.groupBy("conv_id").transformWithStateInPandas(_Openings(gap_minutes * 60_000_000), "conv_id string, seq long, opened long", "Append", "EventTime")
