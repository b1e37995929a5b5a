"""Ordered operators as streams with state of their own: rows wait for the watermark and are then taken in order of time.

Rows come in any order within the watermark's delay. A row is held until the watermark passes its frame; an event-time timer
then hands all of its key's rows up to there, in order, to the same state machine that the batch operator folds with, so
both give the same rows. Rows that come after their time are counted and dropped. What the watermark hasn't passed when a
stream ends stays held for the next run; nothing is flushed early.

State is kept by key in the state store (RocksDB): held rows, the machine, and how many rows were late. Where keys are many
and have little state, a group of keys is one key of the state store (Dealt), as a call for each key costs more than its rows.
Rows go to the state and come out of it in portions, so a worker never holds all rows of a key.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from raceflow import shared
from raceflow.operators.association import Ledger
from raceflow.operators.tracking import TRACKED, Tracker

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(rows: DataFrame, late: str, fps: float = 30.0) -> DataFrame:
    """rows (frame_idx from 0, ..) with their time ts and its watermark; rows may be `late` behind the latest one. Frame 0 is one frame after the epoch, as a watermark there means none."""
    return rows.withColumn("ts", F.timestamp_millis(((F.col("frame_idx") + 1) * F.lit(1000.0) / fps).cast("long"))).withWatermark("ts", late)


def _plain(x):
    return None if x is None or x != x else x.item() if hasattr(x, "item") else x


#: Frames whose held rows are one entry of the state.
BLOCK = 64
#: Rows that are taken in before they go to the state, and that are given out at a time.
PORTION = 8192
#: Groups to which keys are dealt, where a group of keys has one state.
GROUPS = 128


class Held(StatefulProcessor):
    """Holds a key's rows and takes them in order of frame; `take` is given all rows of a frame, `value` is the machine's state."""

    block = BLOCK

    def __init__(self, columns: list[str], names: list[str], fps: float):
        self.columns, self.names, self.fps = columns, names, fps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "block long", "rows string")
        self.late = handle.getValueState("late", "n long")
        if not isinstance(self, Dealt):
            self.machine = handle.getValueState("machine", "json string")

    def at(self, frame: int) -> int:
        """A frame's time in milliseconds, as timed() has it."""
        return int((frame + 1) * 1000.0 / self.fps)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed, late, first, n = timerValues.getCurrentWatermarkInMs(), 0, None, 0
        new: dict[int, dict[str, list]] = {}
        for part in rows:
            for frame, *row in part[["frame_idx", *self.columns]].itertuples(index=False):
                frame = int(frame)
                if self.at(frame) <= passed:
                    late += 1
                    continue
                new.setdefault(frame // self.block, {}).setdefault(str(frame), []).append([_plain(x) for x in row])
                first, n = frame if first is None else min(first, frame), n + 1
                if n >= PORTION:
                    self.hold(new)
                    n = 0
        self.hold(new)
        if first is not None:
            self.handle.registerTimer(self.at(first))
        if late:
            self.late.update(((self.late.get()[0] if self.late.exists() else 0) + late,))
        yield from ()

    def hold(self, new: dict[int, dict[str, list]]) -> None:
        """Puts rows (block -> frame -> rows) to those in the state; new is emptied, so that only one block's held rows are here at a time."""
        while new:
            block, own = new.popitem()
            before = self.held.getValue((block,))
            if before is not None:
                for frame, rows in json.loads(before[0]).items():
                    own[frame] = rows + own.get(frame, [])
            self.held.updateValue((block,), (json.dumps(own),))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, out, left = timerValues.getCurrentWatermarkInMs(), [], None  # all that is due now; other timers that are due find nothing
        self.load()
        for block in sorted(b for (b,) in self.held.keys()):
            if self.at(block * self.block) > upto:
                left = block * self.block if left is None else left
                break
            own = {int(f): rows for f, rows in json.loads(self.held.getValue((block,))[0]).items()}
            rest = {f: rows for f, rows in own.items() if self.at(f) > upto}
            for row in self.walked(key, [(f, own[f]) for f in sorted(own.keys() - rest.keys())]):
                out.append(row)
                if len(out) >= PORTION:
                    yield pd.DataFrame(out, columns=self.names)
                    out = []
            if not rest:
                self.held.removeKey((block,))
            elif len(rest) < len(own):
                self.held.updateValue((block,), (json.dumps(rest),))
            if rest:
                left = min(rest)
        out.extend(self.over(key, upto))
        self.save()
        for frame in (left, self.asked()):
            if frame is not None and self.at(frame) > upto:
                self.handle.registerTimer(self.at(frame))
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def walked(self, key: tuple, due: list[tuple[int, list[list]]]) -> Iterator[tuple]:
        """What the rows (frame and its rows, in order) give."""
        for frame, rows in due:
            yield from self.passed(key, self.at(frame))
            yield from self.take(key, frame, rows)

    def over(self, key: tuple, upto: int) -> list[tuple]:
        """What is due after all rows up to this time."""
        return self.passed(key, upto)

    def asked(self) -> int | None:
        """The frame by which the state store should ask again."""
        return self.due()

    def load(self) -> None:
        self.value = json.loads(self.machine.get()[0]) if self.machine.exists() else None

    def save(self) -> None:
        if self.value is not None:
            self.machine.update((json.dumps(self.value),))
        elif self.machine.exists():
            self.machine.clear()

    def take(self, key: tuple, frame: int, rows: list[list]) -> list[tuple]:
        raise NotImplementedError

    def passed(self, key: tuple, upto: int) -> list[tuple]:
        """What is due by this time, as no row has come."""
        return []

    def due(self) -> int | None:
        """The frame by which passed() wants to be asked."""
        return None


class Dealt(Held):
    """A group of keys: each key's rows are taken on their own, with a value of its own that goes when it is None. A row begins with its key as JSON."""

    block = BLOCK * GROUPS

    def init(self, handle):
        super().init(handle)
        self.machine = handle.getMapState("machine", "name string", "json string")

    def load(self):
        self.before = {name: text for (name,), (text,) in self.machine.iterator()}
        self.values = {name: json.loads(text) for name, text in self.before.items()}
        self.most = 2 * len(self.values) + PORTION

    def save(self):
        """Only values that have changed are written."""
        for name in self.before.keys() - self.values.keys():
            self.machine.removeKey((name,))
        for name, value in self.values.items():
            if self.before.get(name) != (text := json.dumps(value)):
                self.machine.updateValue((name,), (text,))

    def _with(self, name: str, make: Callable[[tuple], Iterator[tuple]]) -> Iterator[tuple]:
        self.value = self.values.get(name)
        yield from make(tuple(json.loads(name).values()))
        if self.value is not None:
            self.values[name] = self.value
        else:
            self.values.pop(name, None)

    def walked(self, key, due):
        own: dict[str, dict[int, list]] = {}
        for frame, rows in due:
            for name, *row in rows:
                own.setdefault(name, {}).setdefault(frame, []).append(row)
        for name, frames in own.items():
            yield from self._with(name, lambda k: Held.walked(self, k, list(frames.items())))  # noqa: B023
        if len(self.values) > self.most:  # keys that are over go, so that only living ones are held
            yield from self.over(key, self.at(due[-1][0]))
            self.most = 2 * len(self.values) + PORTION

    def over(self, key, upto):
        return [row for name in list(self.values) for row in self._with(name, lambda k: self.passed(k, upto))]

    def asked(self):
        frames = []
        for self.value in self.values.values():
            frames.append(self.due())
        return min(frames, default=None)


def _dealt(rows: DataFrame, keys: list[str], make, columns: list[str], schema: str, fps: float) -> DataFrame:
    """_run() for many keys with little state each (numbers and texts), with `make` of a Dealt."""
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = rows.withColumns({"key_json": name, "key_group": F.pmod(F.xxhash64(*keys), F.lit(GROUPS))})
    return _run(rows, ["key_group"], make, ["key_json", *columns], schema, fps)


def _run(rows: DataFrame, keys: list[str], make, columns: list[str], schema: str, fps: float) -> DataFrame:
    names = [x.strip().split()[0] for x in schema.split(",")]
    package = sys.modules[__name__.partition(".")[0]]
    cloudpickle.register_pickle_by_value(package)  # the driver's own worker for streams doesn't get the files that executors get
    try:
        return rows.groupBy(*keys).transformWithStateInPandas(make(columns, names, fps), schema, "append", "EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(package)


class _Tracks(Held):
    """The centroid tracker of a run."""

    gone, far, given = 30, 100.0, False

    def load(self):
        super().load()
        tracks, number = self.value or ([], 0)
        self.tracker = Tracker(self.gone, self.far)
        self.tracker.next, self.tracker.tracks = number, {i: [tuple(p), tuple(b), n] for i, p, b, n in tracks}

    def save(self):
        self.value = [(i, *t) for i, t in self.tracker.tracks.items()], self.tracker.next
        super().save()

    def take(self, key, frame, rows):
        seen = sorted(tuple(r) for r in rows if r[0] is not None)
        found = self.tracker.update([r[:4] for r in seen], [r[4:] for r in seen] if self.given else None)
        return [(key[0], frame, i, p[0], p[1], *b, m) for i, (p, b, m) in sorted(found.items())]


def tracked(detections: DataFrame, gone: int = 30, far: float = 100.0, fps: float = 30.0) -> DataFrame:
    """The batch tracker's rows from a stream of timed() detections (run_id, frame_idx, x1, y1, x2, y2, and cx, cy if there are); null boxes are frames without any."""

    def make(*a):
        p = _Tracks(*a)
        p.gone, p.far, p.given = gone, far, {"cx", "cy"} <= set(detections.columns)
        return p

    columns = ["x1", "y1", "x2", "y2", *(["cx", "cy"] if {"cx", "cy"} <= set(detections.columns) else [])]
    rows = detections.select("run_id", "frame_idx", "ts", *[F.col(c).cast("double").alias(c) for c in columns])
    return _run(rows, ["run_id"], make, columns, TRACKED, fps)


class _Zone(Dealt):
    """A track in zone mode: how often it was seen, whether it was emitted, and its last row."""

    ready, gone = 5, 20

    def take(self, key, frame, rows):
        n, done, out = *(self.value or (0, False))[:2], []
        for bib, x, y in rows:
            n += 1
            if not done and n >= self.ready and bib is not None:
                out, done = [(*key, frame, bib, x, y)], True
        self.value = n, done, frame, x, y
        return out

    def due(self):
        return self.value and self.value[2] + self.gone + 1

    def passed(self, key, upto):
        if not self.value or self.at(self.due()) > upto:
            return []
        n, done, _, x, y = self.value  # the track is over
        out = [] if done or n < self.ready else [(*key, self.due(), "UNKNOWN", x, y)]
        self.value = None
        return out


def zone(seen: DataFrame, ready: int = 5, gone: int = 20, fps: float = 30.0, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """The batch zone's rows from a stream of timed() person rows (keys, frame_idx, bib or null, x, y).

    A timer `gone` frames after a track's last row emits it without a bib, if it hasn't been emitted, and forgets it; so a
    track of the input must not come back after that long, which a tracker's never does.
    """

    def make(*a):
        p = _Zone(*a)
        p.ready, p.gone = ready, gone
        return p

    kinds = dict(seen.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "frame_idx bigint, bib string, x double, y double"])
    return _dealt(seen.select(*keys, "frame_idx", "ts", "bib", "x", "y"), list(keys), make, ["bib", "x", "y"], schema, fps)


class _Votes(Held):
    """A run's ledger: for each person its votes, when and where it was last seen; an entry moves from a lost person to a new one."""

    options: tuple = ()

    def init(self, handle):
        super().init(handle)
        self.people = handle.getMapState("people", "person long", "json string")

    def load(self):
        self.value, self.ledger = None, Ledger(*self.options)
        self.before = {person: text for (person,), (text,) in self.people.iterator()}
        for person in sorted(self.before):
            votes, seen, place = json.loads(self.before[person])
            self.ledger.seen[person], self.ledger.places[person] = seen, tuple(place)
            if votes is not None:
                self.ledger.votes[person] = votes

    def save(self):
        """Only entries that have changed are written."""
        own = self.ledger
        now = {p: json.dumps((own.votes.get(p), own.seen[p], own.places[p])) for p in own.seen}
        for person in self.before.keys() - now.keys():
            self.people.removeKey((person,))
        for person, text in now.items():
            if self.before.get(person) != text:
                self.people.updateValue((person,), (text,))

    def take(self, key, frame, rows):
        side = lambda kind: {int(r[1]): ((r[2], r[3]), tuple(r[4:8])) for r in sorted((r for r in rows if r[0] == kind), key=lambda r: r[1])}
        people = side("person")
        if not people:
            return []
        self.ledger.update(people, side("bib"), {int(r[1]): (r[8], r[9]) for r in rows if r[0] == "bib" and r[8] is not None}, frame)
        self.ledger.cleanup(frame)
        return [(key[0], frame, p, *self.ledger.number(p)) for p in people]


def associated(seen: DataFrame, far: float = 350.0, memory: int = 900, typical: int | None = None, min_votes: float = 2.0, fraction: float = 0.4, fps: float = 30.0) -> DataFrame:
    """The batch association's rows from one stream of timed() persons and bibs.

    seen: run_id, frame_idx, kind (person or bib), id, cx, cy, x1, y1, x2, y2, number, level (of a bib that has been read).
    A frame without persons changes nothing, as in the batch form.
    """

    def make(*a):
        p = _Votes(*a)
        p.options = (far, memory, typical, min_votes, fraction)
        return p

    columns = ["kind", "id", "cx", "cy", "x1", "y1", "x2", "y2", "number", "level"]
    return _run(seen.select("run_id", "frame_idx", "ts", *columns), ["run_id"], make, columns, "run_id string, frame_idx bigint, person bigint, number string, confidence double", fps)


class _Last(Dealt):
    """A track's last number, until it has been silent for `memory` frames."""

    memory = 300

    def take(self, key, frame, rows):
        self.value = sorted((r[0] for r in rows), key=lambda x: (x is not None, x))[-1], frame
        return [(*key, *self.value, True)]

    def due(self):
        return self.value and self.value[1] + self.memory + 1

    def passed(self, key, upto):
        if not self.value or self.at(self.due()) > upto:
            return []
        out, self.value = [(*key, *self.value, False)], None
        return out


def remembered(reads: DataFrame, memory: int, fps: float = 30.0) -> DataFrame:
    """run_id, track_id, number, last_frame, live: a row for each read of a stream of timed() reads, and one more when a track is forgotten.

    The state has only tracks that were read within `memory` frames; the rows, kept by all_time(), are the lasting copy.
    """

    def make(*a):
        p = _Last(*a)
        p.memory = memory
        return p

    kind = dict(reads.dtypes)["track_id"]
    rows = reads.select("run_id", "track_id", "frame_idx", "ts", "number")
    return _dealt(rows, ["run_id", "track_id"], make, ["number"], f"run_id string, track_id {kind}, number string, last_frame bigint, live boolean", fps)


def all_time(log: DataFrame) -> DataFrame:
    """The last row of each track in the log that remembered() writes; of one frame's rows the one that forgets it."""
    top = F.max(F.struct("last_frame", (~F.col("live")).alias("gone"), "number"))
    return log.groupBy("run_id", "track_id").agg(top.alias("x")).select("run_id", "track_id", F.col("x.number").alias("number"), F.col("x.last_frame").alias("last_frame"), (~F.col("x.gone")).alias("live"))


def slices(rows: DataFrame, parts: int) -> list[DataFrame]:
    """rows in `parts` slices of time; they are made once, by as many tasks as make them, and written."""
    rows = shared.written(rows, "slices")
    low, high = rows.agg(F.min("frame_idx"), F.max("frame_idx")).first()
    if low is None:
        return [rows]
    step = (high - low) // parts + 1
    return [rows.where((F.col("frame_idx") >= low + k * step) & (F.col("frame_idx") < low + (k + 1) * step)) for k in range(parts)]


def replayed(batches: list[DataFrame], stream: Callable[[DataFrame], DataFrame], schema: str) -> tuple[DataFrame, str]:
    """What stream makes of these tables, written to the shared folder one after the other and read as one stream, a table at a time; and its checkpoint."""
    spark = batches[0].sparkSession
    source, sink, check = (shared.path(spark, x) for x in ("replay", "replayed", "replay-state"))
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    with rocks(spark):
        stream(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(sink), check


class rocks:
    """The state store that these operators need, for the streams that are started within."""

    _key = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self._key)
        self.spark.conf.set(self._key, ROCKS)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self._key, self.before)


def late_rows(spark: SparkSession, checkpoint: str) -> int:
    """How many rows a stream with this checkpoint has dropped as late."""
    rows = spark.read.format("statestore").option("stateVarName", "late").load(checkpoint)
    return int(rows.agg(F.coalesce(F.sum("value.n"), F.lit(0))).first()[0])
