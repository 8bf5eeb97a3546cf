"""Agent episodes as a stream of turns: a state machine a conversation, kept in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PENDING, GENERATING, TOOLS, INTERACTING, TERMINATED = "pending", "generating", "processing_tools", "interacting", "terminated"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "state string, turns int, assistant_turns int, user_turns int, size long, last_ms long"


class Episode(StatefulProcessor):
    """One row a conversation and batch: its state after the batch's turns.

    A system turn leaves an episode pending; a user's or a tool's has the model generate; an assistant's with a tool call has tools run, and without one waits for
    the user (interacting). An episode ends (terminated) with the assistant's turn that reaches max_turns or max_size characters, or when the watermark is
    `idle_ms` past its last turn; turns after that count nothing. Turns of one batch go by (turn, role, text)."""

    def __init__(self, max_turns: int, max_size: int, idle_ms: int | None):
        self.max_turns, self.max_size, self.idle_ms = max_turns, max_size, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("episode", STATE)

    def _told(self, key, state: tuple) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [key[0]], "state": [state[0]], "turns": [state[1]], "assistant_turns": [state[2]], "user_turns": [state[3]], "size": [state[4]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, turns, said, asked, size, last = self.kept.get() if self.kept.exists() else (PENDING, 0, 0, 0, 0, 0)
        # plain tuples: most conversations have few turns in a batch, for which a frame's own sort costs far more
        batch = [x for f in rows for x in zip(f["turn"].isna().tolist(), f["turn"].tolist(), f["role"].tolist(), f["text"].tolist(), f["ms"].tolist(), strict=True)]
        for _, _, role, text, ms in sorted(batch):
            if state == TERMINATED:
                break
            turns, last = turns + 1, max(last, int(ms))
            if role == "assistant":
                said, size = said + 1, size + len(text)
                ended = said >= self.max_turns or size >= self.max_size
                state = TERMINATED if ended else TOOLS if "<tool_call>" in text else INTERACTING
            elif role in ("user", "tool"):
                asked += role == "user"
                state = GENERATING
        self.kept.update((state, turns, said, asked, size, last))
        if self.idle_ms is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            if state != TERMINATED:
                self.handle.registerTimer(last + self.idle_ms)
        yield self._told(key, (state, turns, said, asked, size))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            state = (TERMINATED, *self.kept.get()[1:])
            self.kept.update(state)
            yield self._told(key, state)

    def close(self) -> None:
        pass


ROLES = ["system", "user", "assistant", "tool"]


def episodes(turns: DataFrame, max_turns: int = 8, max_size: int = 100_000, ts: str | None = None, idle: str = "1 hour") -> DataFrame:
    """The stream of (conv_id, state, turns, assistant_turns, user_turns, size) of a stream of turns (conv_id, turn, role, text): a row whenever a batch touches an episode;
    the one of most turns is the latest. ts: the turns' time; an episode idle for longer by the watermark ends. Other roles and null ids go; a null text is empty.

    The session needs a state store that holds states of this kind: spark.sql.streaming.stateStore.providerClass = STORE."""
    x = turns.where(F.col("role").isin(ROLES) & F.col("conv_id").isNotNull())
    row = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")]
    x = x.select(*row, (F.unix_millis(F.col(ts).cast("timestamp")) if ts else F.lit(0).cast("long")).alias("ms"), *([F.col(ts).cast("timestamp").alias("ts")] if ts else []))
    idle_ms = pd.Timedelta(idle).value // 1_000_000 if ts else None
    x = x.withWatermark("ts", "0 seconds") if ts else x
    out = "conv_id long, state string, turns int, assistant_turns int, user_turns int, size long"
    return x.groupBy("conv_id").transformWithStateInPandas(Episode(max_turns, max_size, idle_ms), out, "update", "EventTime" if ts else "none")


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each episode: of most turns, and of these the one that has ended."""
    key = F.struct("turns", (F.col("state") == TERMINATED).cast("int").alias("ended"))
    names = [c for c in rows.columns if c != "conv_id"]
    return rows.groupBy("conv_id").agg(F.max_by(F.struct(*names), key).alias("r")).select("conv_id", "r.*")
