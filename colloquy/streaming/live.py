"""Live sessions as keyed state of streams, and the same over batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.compliance import Item, live_check
from .folds import Buffer, Detector

EVENTS = "key string, event string, at double, value double"
PIECES = "key string, start double, end double, chunks array<bigint>"
IDLE = "10 minutes"


def _events(key: str, chunks: pd.DataFrame, d: Detector) -> pd.DataFrame:
    rows = [(key, *e) for at, level, s in chunks.sort_values(["at", "seq"])[["at", "level", "seconds"]].itertuples(index=False) if (e := d.add(at, level, s))]
    return pd.DataFrame(rows, columns=["key", "event", "at", "value"])


def _pieces(key: str, chunks: pd.DataFrame, b: Buffer, end: bool) -> pd.DataFrame:
    rows = [(key, *p) for seq, level, s in chunks.sort_values(["at", "seq"])[["seq", "level", "seconds"]].itertuples(index=False) if (p := b.add(int(seq), level, s))]
    if end and (p := b.end()):
        rows.append((key, *p))
    return pd.DataFrame(rows, columns=["key", "start", "end", "chunks"])


def meetings_in(chunks: DataFrame) -> DataFrame:
    """(key, event, at, value): starts and ends of meetings among a batch of chunks (key, seq, at, level, seconds)."""
    return chunks.groupBy("key").applyInPandas(lambda k, t: _events(k[0], t, Detector()), EVENTS)


def pieces_in(chunks: DataFrame, **settings: float) -> DataFrame:
    """(key, start, end, chunks): the pieces of audio that a batch of whole sessions falls into."""
    return chunks.groupBy("key").applyInPandas(lambda k, t: _pieces(k[0], t, Buffer(**settings), True), PIECES)


def meetings_stream(chunks: DataFrame) -> DataFrame:
    """The same events from a stream of chunks; a device that is silent for IDLE loses its state, which ends its meeting."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d, last = Detector(), 0.0
        if state.exists:
            *kept, last = state.get
            d.restore(*kept)
        if state.hasTimedOut:
            over = [(key[0], "end", last, last - d.started)] if d.active else []
            state.remove()
            yield pd.DataFrame(over, columns=["key", "event", "at", "value"])
            return
        t = pd.concat(list(batches))
        yield _events(key[0], t, d)
        state.update((*d.state(), float(max(last, t["at"].max()))))
        state.setTimeoutDuration(600_000)

    return chunks.groupBy("key").applyInPandasWithState(run, EVENTS, "active boolean, speech double, silence double, started double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def pieces_stream(chunks: DataFrame, **settings: float) -> DataFrame:
    """The same pieces from a stream; a chunk whose `last` is true ends its session, as does silence of IDLE."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Buffer(**settings)
        if state.exists:
            b.held, b.silence, b.speaking, b.offset, chunks = state.get
            b.chunks = [int(x) for x in chunks.split(",") if x]
        if state.hasTimedOut:
            p = b.end()
            state.remove()
            yield pd.DataFrame([(key[0], *p)] if p else [], columns=["key", "start", "end", "chunks"])
            return
        t = pd.concat(list(batches))
        over = bool(t["last"].any())
        yield _pieces(key[0], t, b, over)
        if over:
            state.remove()
        else:
            state.update((b.held, b.silence, b.speaking, b.offset, ",".join(map(str, b.chunks))))
            state.setTimeoutDuration(600_000)

    return chunks.groupBy("key").applyInPandasWithState(run, PIECES, "held double, silence double, speaking boolean, offset double, chunks string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def checked_stream(segments: DataFrame, items: list[Item]) -> DataFrame:
    """Segments of a stream (or batch) with their risks, points and alerts: no state, so no shuffle."""
    return live_check(segments, items)


def tumbling(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, end, event_type, n, total): counts and sums per window; with `late`, of a stream whose state is let go after that."""
    at = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return at.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, end, n): stretches of a key's events with no gap as long as that; end is the last event plus the gap."""
    at = events.withWatermark("ts", late) if late else events
    return at.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


STEPS = [(3, "saved"), (5, "preprocessing"), (10, "loading"), (40, "transcribed"), (55, "speakers"), (65, "stored"), (75, "text"), (80, "summary"), (85, "compliance"), (100, "finished"), (-1, "failed")]


def progress(log: DataFrame) -> DataFrame:
    """(meeting_id, progress, message): the last step of each meeting in an append-only log (meeting_id, at, progress, message)."""
    return log.groupBy("meeting_id").agg(F.max_by(F.struct("progress", "message"), "at").alias("p")).select("meeting_id", "p.progress", "p.message")


def analysed(stream: DataFrame, analyse, sink) -> object:
    """Runs a batch analysis on each micro-batch of ended sessions and hands its result to sink; returns the query's writer."""
    return stream.writeStream.foreachBatch(lambda batch, number: sink(analyse(batch), number))
