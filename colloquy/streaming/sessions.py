"""A register of live sessions: what each may do next, what it holds, and what it has said, whatever order its messages come in.

A message is (session, seq, kind, level, seconds); kind is start, chunk or stop, and seq counts a session's messages from 0.
One state machine serves streams and batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .folds import Buffer

SAID = "session string, seq long, event string, start double, end double, chunks array<bigint>, message string"
_NAMES = ["session", "seq", "event", "start", "end", "chunks", "message"]
STATE = "next long, active boolean, total double, held double, silence double, speaking boolean, offset double, chunks string"
NO_SESSION = "请先开始转写会话"


@dataclass
class Session:
    """What is known of one session.

    Messages are taken in order of seq: one that comes early waits, one that has been taken or waits already is a repeat and is
    passed over. A chunk or stop without a start is an error, as is a message of another kind. A second start begins anew.
    """

    settings: dict[str, float] = field(default_factory=dict)
    next: int = 0
    active: bool = False
    total: float = 0.0
    buffer: Buffer = field(default_factory=Buffer)
    waiting: dict[int, tuple[str, float, float]] = field(default_factory=dict)
    said: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self.buffer = Buffer(**self.settings)

    def take(self, seq: int, kind: str, level: float, seconds: float) -> None:
        if seq >= self.next and seq not in self.waiting:
            self.waiting[seq] = (kind, level, seconds)
        while self.next in self.waiting:
            self._act(self.next, *self.waiting.pop(self.next))
            self.next += 1

    def end(self) -> None:
        """No more comes: what waits is taken, whatever is missing before it, and an open session is over."""
        for seq in sorted(self.waiting):
            self._act(seq, *self.waiting.pop(seq))
            self.next = seq + 1
        if self.active:
            self._close(self.next - 1, "expired")

    def _act(self, seq: int, kind: str, level: float, seconds: float) -> None:
        if kind == "start":
            self.active, self.total, self.buffer = True, 0.0, Buffer(**self.settings)
            self.said.append((seq, "started", 0.0, 0.0, [], None))
        elif not self.active or kind not in ("chunk", "stop"):
            self.said.append((seq, "error", None, None, [], NO_SESSION if not self.active else f"unknown: {kind}"))
        elif kind == "stop":
            self._close(seq, "stopped")
        else:
            self.total += seconds
            if piece := self.buffer.add(seq, level, seconds):
                self.said.append((seq, "piece", *piece, None))

    def _close(self, seq: int, event: str) -> None:
        if piece := self.buffer.end():
            self.said.append((seq, "piece", *piece, None))
        self.said.append((seq, event, 0.0, round(self.total, 2), [], None))
        self.active = False

    def state(self) -> tuple:
        b = self.buffer
        return self.next, self.active, self.total, b.held, b.silence, b.speaking, b.offset, ",".join(map(str, b.chunks))

    def restore(self, next: int, active: bool, total: float, held: float, silence: float, speaking: bool, offset: float, chunks: str) -> Session:
        self.next, self.active, self.total = next, active, total
        b = self.buffer
        b.held, b.silence, b.speaking, b.offset, b.chunks = held, silence, speaking, offset, [int(x) for x in chunks.split(",") if x]
        return self

    def table(self, name: str) -> pd.DataFrame:
        out = pd.DataFrame([(name, *x) for x in self.said], columns=_NAMES)
        self.said = []
        return out


def _messages(t: pd.DataFrame) -> Iterator[tuple[int, str, float, float]]:
    for seq, kind, level, seconds in t[["seq", "kind", "level", "seconds"]].itertuples(index=False):
        yield int(seq), kind, float(level) if pd.notna(level) else 0.0, float(seconds) if pd.notna(seconds) else 0.0


def sessions_in(messages: DataFrame, **settings: float) -> DataFrame:
    """(session, seq, event, start, end, chunks, message): all that a batch of whole sessions says; see `Session`.

    Events are started, piece (of audio, from start to end), stopped, expired (a session that nothing ended) and error. Repeated
    rows change nothing; messages without a session or a seq are left out. A session's messages are one task's.
    """

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        s = Session(settings)
        for m in _messages(t.sort_values("seq")):
            s.take(*m)
        s.end()
        return s.table(key[0])

    return messages.where("session is not null and seq is not null").groupBy("session").applyInPandas(run, SAID)


class Register(StatefulProcessor):
    """The same for a stream: a value for what a session is at, a map for messages that came early, a timer for its end."""

    def __init__(self, settings: dict[str, float], idle: int):
        self._settings, self._idle = settings, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._value = handle.getValueState("session", STATE)
        self._early = handle.getMapState("early", "seq long", "kind string, level double, seconds double")

    def _load(self) -> Session:
        s = Session(self._settings)
        if self._value.exists():
            s.restore(*self._value.get())
        s.waiting = {int(k[0]): (v[0], v[1], v[2]) for k, v in self._early.iterator()}
        return s

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        before = set(s.waiting)
        for t in rows:
            for m in _messages(t.sort_values("seq")):
                s.take(*m)
        self._value.update(s.state())
        for seq in before - set(s.waiting):
            self._early.removeKey((seq,))
        for seq in set(s.waiting) - before:
            self._early.updateValue((seq,), s.waiting[seq])
        for at in list(self._handle.listTimers()):
            self._handle.deleteTimer(at)
        self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle)
        yield s.table(key[0])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        s.end()
        self._value.clear()
        self._early.clear()
        yield s.table(key[0])

    def close(self) -> None:
        pass


def sessions_stream(messages: DataFrame, idle_seconds: float = 600.0, **settings: float) -> DataFrame:
    """The same rows from a stream of messages, each as soon as its turn has come. A session that is silent for idle_seconds
    is over: what waits for a missing message is then taken, and its state is let go. Needs the RocksDB state store."""
    known = messages.where("session is not null and seq is not null")
    return known.groupBy("session").transformWithStateInPandas(Register(settings, int(idle_seconds * 1000)), SAID, "Append", "ProcessingTime")


def keep(path: str, analyse: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: a batch's rows, after analyse if given, become the folder of its number, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        (analyse(batch) if analyse else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def kept(spark: SparkSession, path: str) -> DataFrame:
    """What `keep` has written, each session's event once."""
    return spark.read.parquet(path).drop("batch").dropDuplicates(["session", "seq", "event", "start"])
