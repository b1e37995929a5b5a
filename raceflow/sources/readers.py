"""Readers of the file formats: registries, labels, logs, COCO and YOLO annotations, run folders, manifests, frames."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from raceflow.operators.registry import from_range  # noqa: F401  (the range form of a registry)

DETECTIONS = (
    "frame bigint, time_sec double, track_id bigint, x1 int, y1 int, x2 int, y2 int, det_conf double, ocr_raw string, ocr_conf double, "
    "validated string, is_valid boolean, consensus string, consensus_conf double, is_stable boolean, final_level string"
)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """One bib a line; blanks and repeats go."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("bib")).where("bib <> ''").distinct()


def provider_photos(spark: SparkSession, path: str) -> DataFrame:
    """camera_tag, image_url, image_id, bibs: the last from a quoted cell with a number on each line."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    bibs = F.filter(F.transform(F.split(F.coalesce("associated_bibs", F.lit("")), "\n"), lambda b: F.trim(b)), lambda b: b != "")
    return rows.select("camera_tag", "image_url", F.col("event_image_id").alias("image_id"), bibs.alias("bibs"))


def labels_tsv(spark: SparkSession, path: str, event: str) -> DataFrame:
    """filename, label, event, digit_count of the rows with a label of one to four digits."""
    rows = spark.read.csv(path, sep="\t", schema="filename string, label string")
    return valid_labels(rows, "label").select("filename", "label", F.lit(event).alias("event"), F.length("label").alias("digit_count"))


def valid_labels(rows: DataFrame, label: str) -> DataFrame:
    return rows.where(F.col(label).rlike("^[0-9]{1,4}$"))


def detections_log(spark: SparkSession, path: str) -> DataFrame:
    """The 16 columns of a detections log; rows without a readable frame, track or box are dropped."""
    rows = spark.read.csv(path, header=True)
    kinds = [x.strip().split() for x in DETECTIONS.split(",")]
    out = rows.select(*[F.col(c).try_cast(k).alias(c) for c, k in kinds])
    return out.dropna(subset=["frame", "track_id", "x1", "y1", "x2", "y2"])


def coco(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories of COCO files (with `lines`, one document a line); a missing part is an error."""
    doc = spark.read.json(path, multiLine=not lines)
    missing = {"images", "annotations", "categories"} - set(doc.columns)
    if missing:
        raise ValueError(f"not a COCO file, without {', '.join(sorted(missing))}")
    return tuple(doc.select(F.explode(part).alias("x")).select("x.*") for part in ("images", "annotations", "categories"))


def yolo_line(line: Column) -> Column:
    """Struct (cls, xc, yc, w, h) of a label line, or null unless it has five numbers and class 0."""
    p = F.split(F.trim(line), r"\s+")
    nums = [F.get(p, F.lit(i)).try_cast("double") for i in range(5)]
    ok = (F.size(p) == 5) & (nums[0] == 0)
    for n in nums[1:]:
        ok = ok & n.isNotNull()
    return F.when(ok, F.struct(*[n.alias(c) for n, c in zip(nums, ("cls", "xc", "yc", "w", "h"))]))


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """file and the box of every valid line."""
    rows = spark.read.text(path, pathGlobFilter="*.txt", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), yolo_line(F.col("value")).alias("b"))
    return rows.where("b is not null").select("file", "b.*")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, id of a vocabulary file (one JSON object of token: id); an empty one is an error."""
    out = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("token", "id"))
    if out.isEmpty():
        raise ValueError("no vocabulary")
    return out


def memory(spark: SparkSession, frames: Iterable[np.ndarray], run: str = "run0") -> DataFrame:
    """run_id, frame_idx (from 1), payload, width, height of frames held in memory; all have the size of the first."""
    rows, size = [], None
    for i, f in enumerate(frames, 1):
        size = size or f.shape[:2]
        if f.shape[:2] != size:
            raise ValueError(f"frame {i} has another size")
        rows.append((run, i, f.tobytes(), size[1], size[0]))
    return spark.createDataFrame(rows, FrameSource(None).schema())


def results_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The rows of a JSON array (with `lines`, of one object a line)."""
    return spark.read.json(path, multiLine=not lines)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).drop("content")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """run, has_crossings, has_review, has_video, files of every run folder, newest name first."""
    return runs_of(files(spark, path))


def runs_of(inventory: DataFrame) -> DataFrame:
    """The run folders of an inventory of files (path)."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = inventory.select(F.element_at(F.split("path", "/"), -2).alias("run"), name.alias("name"))
    has = lambda p: F.bool_or(F.col("name").rlike(p))
    return rows.groupBy("run").agg(has("^crossings.*csv$").alias("has_crossings"), has("^review.*json$").alias("has_review"), has("mp4$").alias("has_video"), F.count(F.lit(1)).alias("files")).orderBy(F.desc("run"))


def manifest_state(manifest: DataFrame, content: DataFrame) -> DataFrame:
    """name, state (ok, missing, sha_mismatch, size_mismatch). manifest: name, sha256, size; content: name, content (binary)."""
    c = content.select(F.col("name").alias("n"), F.sha2("content", 256).alias("own"), F.length("content").alias("length"))
    out = manifest.join(c, F.col("name") == F.col("n"), "left")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("own") != F.lower("sha256"), "sha_mismatch").when(F.col("length") != F.col("size"), "size_mismatch").otherwise("ok")
    return out.select("name", state.alias("state"))


def strided(frames: DataFrame, stride: int = 1, start: int = 0) -> DataFrame:
    """Every stride-th frame from `start` on; both reach the scan as filters."""
    return frames.where((F.col("frame_idx") >= start) & (F.col("frame_idx") % stride == 0))


class _Frames(DataSourceReader):
    def __init__(self, options: dict):
        self.count, self.width, self.height, self.parts = (int(options.get(k, d)) for k, d in (("frames", 100), ("width", 64), ("height", 64), ("partitions", 4)))
        self.run = options.get("run", "run0")

    def partitions(self) -> list[InputPartition]:
        step = -(-self.count // self.parts)
        return [InputPartition((s, min(s + step, self.count))) for s in range(0, self.count, step)]

    def read(self, partition: InputPartition):
        for i in range(*partition.value):
            yield (self.run, i + 1, bytes(self.width * self.height), self.width, self.height)


class _Camera(SimpleDataSourceStreamReader):
    """A live source that keeps the newest `buffer` frames of each poll and drops the older ones."""

    def __init__(self, options: dict):
        self.rate, self.buffer, self.end = (int(options.get(k, d)) for k, d in (("framesPerPoll", 5), ("buffer", 2), ("frames", 1 << 40)))
        self.width, self.height, self.run = int(options.get("width", 64)), int(options.get("height", 64)), options.get("run", "run0")

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def _rows(self, start: int, end: int):
        return iter([(self.run, i + 1, bytes(self.width * self.height), self.width, self.height) for i in range(max(start, end - self.buffer), end)])

    def read(self, start: dict):
        end = min(start["frame"] + self.rate, self.end)
        return self._rows(start["frame"], end), {"frame": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._rows(start["frame"], end["frame"])

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """format("frames"): black frames as a stand-in for a decoder (batch) or a camera (stream)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "run_id string, frame_idx bigint, payload binary, width int, height int"

    def reader(self, schema) -> DataSourceReader:
        return _Frames(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Camera(self.options)
