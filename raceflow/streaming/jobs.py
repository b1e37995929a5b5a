"""Structured Streaming forms of the ordered operators; each uses the batch operator's own state machine."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from raceflow.config import Line
from raceflow.operators import dedup as D
from raceflow.operators.voting import SCORE


def side(x: float, y: float, line: Line) -> int:
    cross = (line.x2 - line.x1) * (y - line.y1) - (line.y2 - line.y1) * (x - line.x1)
    return (cross > 0) - (cross < 0)


class Detector:
    """Side, held side and last firing of one track."""

    def __init__(self, confirmed: int = 0, waiting: int = 0, held: int = 0, last: int | None = None):
        self.confirmed, self.waiting, self.held, self.last = confirmed, waiting, held, last

    def check(self, x: float, y: float, frame: int, line: Line, hold: int, debounce: int, direction: str) -> bool:
        s = side(x, y, line)
        if not s:
            s = self.waiting or self.confirmed  # on the line: as before
            if not s:
                return False
        if not self.confirmed:
            self.confirmed = s
            return False
        if s == self.confirmed:
            self.waiting = self.held = 0
            return False
        self.held = self.held + 1 if s == self.waiting else 1
        self.waiting = s
        if self.held < hold:
            return False
        before, self.confirmed, self.waiting, self.held = self.confirmed, s, 0, 0
        if self.last is not None and frame - self.last < debounce:
            return False
        if direction != "any" and before != (1 if direction == "left_to_right" else -1):
            return False
        self.last = frame
        return True


def crossings(obs: DataFrame, line: Line, hold: int = 3, debounce: int = 60, direction: str = "any", idle_ms: int | None = None) -> DataFrame:
    """track_id, frame_idx of every firing; obs: track_id, frame_idx, x, y. Frames not after a track's last are dropped; tracks idle for idle_ms are forgotten, if it is given (not with availableNow)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        c, w, h, last, seen = state.get if state.exists else (0, 0, 0, -1, -1)
        d = Detector(c, w, h, None if last < 0 else last)
        out = []
        for row in pd.concat(list(batches)).sort_values("frame_idx").itertuples():
            if row.frame_idx > seen:
                seen = int(row.frame_idx)
                if d.check(row.x, row.y, seen, line, hold, debounce, direction):
                    out.append((key[0], seen))
        state.update((d.confirmed, d.waiting, d.held, -1 if d.last is None else d.last, seen))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["track_id", "frame_idx"])

    return obs.groupBy("track_id").applyInPandasWithState(step, "track_id bigint, frame_idx bigint", "c int, w int, h int, last bigint, seen bigint", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def deduplicated(emissions: DataFrame, debounce: int = 300, radius: float = 200.0) -> DataFrame:
    """bib, frame_idx, conf, track_id of the emissions that are new; the fold of the batch operator with its state between batches."""
    keyed = emissions.withColumn("dedup_key", F.when(F.col("bib") == D.UNKNOWN, F.concat_ws("#", "bib", F.col("track_id").cast("string"))).otherwise(F.col("bib")))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = D.State()
        if state.exists:
            last, s.count, tracks, places = json.loads(state.get[0])
            s.last, s.tracks, s.places = last, set(tracks), [tuple(p) for p in places]
        out = []
        for r in pd.concat(list(batches)).sort_values("frame_idx").itertuples():
            if D.emits(s, r.bib, int(r.frame_idx), float(r.conf), int(r.track_id), float(r.x), float(r.y), debounce, radius):
                out.append((r.bib, int(r.frame_idx), float(r.conf), int(r.track_id)))
        state.update((json.dumps([s.last, s.count, sorted(s.tracks), s.places]),))
        if out:
            yield pd.DataFrame(out, columns=["bib", "frame_idx", "conf", "track_id"])

    return keyed.groupBy("dedup_key").applyInPandasWithState(step, "bib string, frame_idx bigint, conf double, track_id bigint", "state string", "append", GroupStateTimeout.NoTimeout)


def votes(reads: DataFrame, window: int = 15, decay: float = 0.9, stable: int = 5) -> DataFrame:
    """track_id, frame_idx, winner, confidence, is_stable after each read, with at most `window` votes of state for each track."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, run = json.loads(state.get[0]) if state.exists else ([], [None, 0])
        out = []
        for r in pd.concat(list(batches)).sort_values("frame_idx").itertuples():
            held = [*held, [r.number, float(r.conf)]][-window:]
            run = [r.number, run[1] + 1 if r.number == run[0] else 1]
            score: dict[str, float] = {}
            for i, (number, conf) in enumerate(held):
                score[number] = score.get(number, 0.0) + decay ** (len(held) - 1 - i) * conf
            best = max(score, key=lambda n: round(score[n], SCORE))  # of equals the first in the window
            own = [c for n, c in held if n == best]
            out.append((key[0], int(r.frame_idx), best, 0.5 * len(own) / len(held) + 0.5 * sum(own) / len(own), run[0] == best and run[1] >= stable))
        state.update((json.dumps([held, run]),))
        yield pd.DataFrame(out, columns=["track_id", "frame_idx", "winner", "confidence", "is_stable"])

    return reads.groupBy("track_id").applyInPandasWithState(step, "track_id bigint, frame_idx bigint, winner string, confidence double, is_stable boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "10 seconds", width: str = "5 minutes") -> DataFrame:
    """Rows of each key in tumbling windows, late rows within the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


class Manager:
    """Starts, stops and reports on one streaming query; states idle, configured, running, stopping, error."""

    def __init__(self):
        self.state, self.query, self.error = "idle", None, None
        self._listeners: list[Callable[[DataFrame, int], None]] = []
        self._start: Callable[[], StreamingQuery] | None = None

    def add(self, listener: Callable[[DataFrame, int], None]) -> None:
        self._listeners.append(listener)

    def remove(self, listener: Callable[[DataFrame, int], None]) -> None:
        if listener in self._listeners:
            self._listeners.remove(listener)

    def configure(self, rows: DataFrame, checkpoint: str, trigger: dict) -> None:
        if self.state in ("running", "stopping"):
            raise RuntimeError(f"can't configure while {self.state}")
        from raceflow.sources.sinks import fan_out

        self._start = lambda: rows.writeStream.foreachBatch(fan_out(*self._listeners)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
        self.state = "configured"

    def start(self) -> None:
        if self.state != "configured" or self._start is None:
            raise RuntimeError(f"can't start while {self.state}")
        self.query, self.state = self._start(), "running"

    def stop(self, seconds: int = 10) -> None:
        if self.query is not None and self.state == "running":
            self.state = "stopping"
            self.query.stop()
            self.query.awaitTermination(seconds)
        self.state = "idle"

    def status(self) -> dict:
        if self.query is not None and (e := self.query.exception()) is not None:
            self.state, self.error = "error", str(e)
        return {"state": self.state, "error": self.error, "progress": self.query.lastProgress if self.query is not None else None}


def upsert(path: str, key: str = "sequence") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends versions; readers take the latest of each key (recovery.latest)."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("version", F.lit(epoch)).write.mode("append").parquet(path)

    return write
