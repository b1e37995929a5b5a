"""Writers and their row formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fixed(c: str, digits: int) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.bround(F.col(c).cast("double"), digits))).otherwise("").alias(c)


def detections_rows(rows: DataFrame) -> DataFrame:
    """The 16 text columns of a detections log."""
    threes = {"time_sec", "det_conf", "ocr_conf", "consensus_conf"}
    names = "frame time_sec track_id x1 y1 x2 y2 det_conf ocr_raw ocr_conf validated is_valid consensus consensus_conf is_stable final_level".split()
    return rows.select(*[_fixed(c, 3) if c in threes else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])


def crossings_rows(events: DataFrame) -> DataFrame:
    """The 14 text columns of a crossings log; a missing chest point is empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    names = "sequence frame time_sec person_track_id bib_number confidence estimated_count person_x1 person_y1 person_x2 person_y2 chest_x chest_y source".split()
    return events.select(*[_fixed(c, 3) if c in ("time_sec", "confidence") else _fixed(c, 1) if c.startswith("chest") else text(c) for c in names])


def track_rows(tracks: DataFrame) -> DataFrame:
    """The 10 text columns of person-track diagnostics, by id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    names = "track_id first_frame last_frame frames_seen first_chest_x first_chest_y last_chest_x last_chest_y crossed bib".split()
    return tracks.orderBy("track_id").select(*[_fixed(c, 1) if "chest" in c else text(c) for c in names])


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).csv(path, header=True)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def json_array(rows: DataFrame, order: str) -> DataFrame:
    """One row: all rows as a JSON array in order. For bounded tables such as the review queue."""
    cols = rows.columns
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*cols).alias("x"))))
    return rows.agg(F.to_json(F.transform(each, lambda e: e["x"])).alias("json"))


def yolo_lines(boxes: DataFrame) -> DataFrame:
    """image, content: the label file of each image, one line for each box (cls, xc, yc, w, h)."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("cls").cast("int"), *[F.col(c).cast("double") for c in ("xc", "yc", "w", "h")])
    return boxes.groupBy("image").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))


def sample_keys(samples: DataFrame, order: str) -> DataFrame:
    """samples with the keys that a keyed image store uses: image-000000001, label-000000001, ... in each split."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("split").orderBy(order))
    return samples.withColumn("image_key", F.format_string("image-%09d", n)).withColumn("label_key", F.format_string("label-%09d", n)).withColumn("file", F.format_string("%06d.jpg", n - 1))


def write_splits(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").partitionBy("split").parquet(path)


def timing_lines(events: DataFrame, location: str = "finish", time_format: str = "normal", day: str = "1970-01-01", offset: float = 0.0, reader: str = "RACEFLOW", lap: int = 0) -> DataFrame:
    """sequence, line: a crossing as a tilde-separated tag record.

    time_format: normal (HH:MM:SS.hh), iso, unix (with hundredths) or msecs (since midnight); time_sec + offset are seconds of the day.
    """
    from raceflow.functions.text import clock

    at = F.col("time_sec") + F.lit(float(offset))
    normal = clock(at, hundredths=True)
    time = {
        "normal": normal,
        "iso": F.concat(F.lit(f"{day}T"), normal),
        "unix": F.format_string("%.2f", F.unix_timestamp(F.lit(f"{day} 00:00:00").cast("timestamp")) + at),
        "msecs": F.floor(at * 1000 + 1e-6).cast("long").cast("string"),
    }[time_format]
    line = F.concat_ws("~", F.lit("CT01_33"), F.col("sequence").cast("string"), F.lit(location), F.col("bib"), time, F.lit("0"), F.lit(reader), F.lit(str(lap)))
    return events.select("sequence", F.concat(line, F.lit("\r\n")).alias("line"))


def unsent(queue: DataFrame, after: int = 0) -> DataFrame:
    """The records still to be sent, from a sequence on."""
    return queue.where(~F.col("sent") & (F.col("sequence") >= after)).orderBy("sequence")


def evidence(events: DataFrame, mode: str = "low_confidence", below: float = 0.7) -> DataFrame:
    """The events whose pictures are kept: all, low_confidence, or none."""
    if mode == "all":
        return events
    return events.where((F.col("confidence") < below) | (F.col("bib") == "UNKNOWN")) if mode == "low_confidence" else events.limit(0)


def feed(events: DataFrame, keep: int = 50) -> DataFrame:
    """The newest events, newest first."""
    return events.orderBy(F.desc("sequence")).limit(keep)


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key: a slot that later rows overwrite."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def review_rows(items: DataFrame) -> DataFrame:
    """The text columns of a review file: sequence, bib, status (pending if none)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return items.select(text("sequence"), text("bib"), F.coalesce("status", F.lit("pending")).alias("status"))


def error_rows(truth: DataFrame) -> DataFrame:
    """event, gt, pred, kind of the wrong predictions."""
    from raceflow.operators.dataset import error_class

    return truth.select("event", "gt", "pred", error_class(F.col("gt"), F.col("pred")).alias("kind")).where("kind <> 'correct'")


def manifest_rows(frames: DataFrame, fps: float) -> DataFrame:
    """The text columns of an extraction manifest: video, frame, time_sec, file."""
    name = F.format_string("%s_%06d.jpg", F.col("video"), F.col("frame_idx"))
    return frames.select("video", F.col("frame_idx").cast("string").alias("frame"), F.format_string("%.3f", F.bround(F.col("frame_idx") / fps, 3)).alias("time_sec"), name.alias("file"))


def summary_lines(reads: DataFrame, sure: float = 0.5) -> DataFrame:
    """run_id, line: a line of text for each run with its reads, tracks, and reads below `sure`."""
    per = reads.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("track_id").alias("tracks"), F.count_if(F.col("conf") < sure).alias("unsure"))
    return per.select("run_id", F.format_string("%s: %d reads, %d tracks, %d unsure", "run_id", "n", "tracks", "unsure").alias("line"))


def fan_out(*callbacks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that calls each callback; one that fails doesn't stop the others, but the batch fails after them and comes again."""

    def each(batch: DataFrame, epoch: int) -> None:
        failed: list[Exception] = []
        batch.persist()
        try:
            for f in callbacks:
                try:
                    f(batch, epoch)
                except Exception as e:  # noqa: BLE001
                    failed.append(e)
        finally:
            batch.unpersist()
        if failed:
            raise ExceptionGroup(f"{len(failed)} of {len(callbacks)} callbacks failed in batch {epoch}", failed)

    return each
