"""What a live session remembers from chunk to chunk, as plain state machines that batches and streams share."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Detector:
    """Whether a meeting is on, by the levels of chunks: speech for 3 s starts one, silence for 60 s ends one of 60 s."""

    speech_level: float = 0.03
    speech_seconds: float = 3.0
    silence_seconds: float = 60.0
    meeting_seconds: float = 60.0
    active: bool = False
    speech: float = 0.0
    silence: float = 0.0
    started: float = 0.0

    def add(self, at: float, level: float, seconds: float) -> tuple[str, float, float] | None:
        """(start, its time, confidence) or (end, its time, duration), if the chunk brings that about."""
        if level > self.speech_level:
            self.silence = 0.0
            self.speech += seconds
            if not self.active and self.speech >= self.speech_seconds:
                self.active, self.started = True, at - self.speech
                return "start", self.started, min(1.0, self.speech / 10)
        else:
            self.speech = 0.0
            self.silence += seconds
            if self.active and self.silence >= self.silence_seconds and at - self.started >= self.meeting_seconds:
                self.active = False
                return "end", at - seconds, at - self.started
        return None

    def state(self) -> tuple:
        return self.active, self.speech, self.silence, self.started

    def restore(self, active: bool, speech: float, silence: float, started: float) -> Detector:
        self.active, self.speech, self.silence, self.started = active, speech, silence, started
        return self


@dataclass
class Buffer:
    """Chunks held until there is a pause after speech, or enough: then they are given out as one piece of audio.

    pause 0 means that only length counts. A piece shorter than `shortest` is dropped; its time then counts for
    the pieces after it only if advance_dropped.
    """

    level: float = 0.015
    pause: float = 0.3
    longest: float = 8.0
    shortest: float = 0.5
    least_at_end: float = 0.3
    advance_dropped: bool = False
    held: float = 0.0
    silence: float = 0.0
    speaking: bool = False
    offset: float = 0.0
    chunks: list[int] = field(default_factory=list)

    def add(self, seq: int, level: float, seconds: float) -> tuple[float, float, list[int]] | None:
        """(start, end, chunk numbers) of the piece that the chunk completes."""
        self.chunks.append(seq)
        self.held += seconds
        if level > self.level:
            self.speaking, self.silence = True, 0.0
        else:
            self.silence += seconds
        if (self.pause and self.speaking and self.silence >= self.pause - 1e-9) or self.held >= self.longest - 1e-9:
            out = self._give()
            self.speaking, self.silence = False, 0.0
            return out
        return None

    def end(self) -> tuple[float, float, list[int]] | None:
        """What is left when the session ends, unless it is too short."""
        return self._give() if self.held >= self.least_at_end else None

    def _give(self) -> tuple[float, float, list[int]] | None:
        seconds, chunks = self.held, self.chunks
        self.held, self.chunks = 0.0, []
        start = self.offset
        if seconds < self.shortest - 1e-9:
            self.offset += seconds if self.advance_dropped else 0.0
            return None
        self.offset += seconds
        return round(start, 2), round(start + seconds, 2), chunks


def fixed_buffer(seconds: float = 5.0) -> Buffer:
    """Pieces of a fixed length."""
    return Buffer(pause=0.0, longest=seconds)
