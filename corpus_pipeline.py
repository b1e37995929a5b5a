"""A corpus pipeline of five of the training-data operators, each stage written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from raceflow.llm import byte_bpe, curriculum, exact_dedup, jaccard_join, line_quality
from raceflow.llm import common as C

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their host's boilerplate lines.

    Null and wordless texts go (they fail the base rules). Each row is judged by itself, so null or repeated doc_ids and
    repeated rows lose nothing; a null source is a host of its own; other columns come along; no rows give none.
    """
    return line_quality.cleaned(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, one with the largest doc_id; null counts as the empty text.

    Rows of one doc_id, or of none, with different texts all stay; of fully equal rows one stays; no rows give none.
    """
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, the one with the least doc_id.

    Rows without words have no near duplicates and stay. Where doc_ids are null or repeat, rows are told apart by keys of
    their own, and the one with the least key stays. No rows give none.
    """
    return jaccard_join.representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, in training order, with their training position.

    Rows without words are never taken. Rows of one doc_id, or of none, have places of their own. No rows give none.
    """
    return curriculum.training_order(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, training position, number of tokens, and the digests of ids and decoded bytes of every row; null encodes as empty."""
    return byte_bpe.digests(docs, *[c for c in (curriculum.POSITION,) if c in docs.columns])


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixing),
    ("bpe", encoding),
]

#: The mix orders by a training position and encoding has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; what a stage has written for itself goes once its result is written."""
    docs, before = C.read(spark, sf_dir, "documents"), {*C.cuts()}
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = C.new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        C.discard(spark, [p for p in C.cuts() if p != path and p not in before])
        docs = spark.read.parquet(path)
    return docs
