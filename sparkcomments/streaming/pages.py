"""Scoring landed comment pages as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import attach_creator
from ..plans.scoring import analyze_comments
from ..sources.pages import READ_AT, REMEMBERED, stream_comment_pages
from . import cap

_COLUMNS = ("is_spam", "spam_score", "reason", "primary_category", "had_obfuscation")


def score_pages(
    spark: SparkSession, pages: str, videos: DataFrame | None = None, threshold: float = 0.5, first: int | None = None, **reading,
) -> DataFrame:
    """Comments of newly landed pages with their verdict; ``reading`` goes to :func:`stream_comment_pages`.

    Scoring is row-wise, so the batch function serves the stream unchanged.
    For :func:`write_capped` with a limit, the same as ``first`` leaves out what cannot be
    before the cut, where that shows before all is scored; see :func:`sparkcomments.streaming.cap.scored_to_cut`.
    """
    comments = stream_comment_pages(spark, pages, **reading)
    if videos is not None:
        comments = attach_creator(comments, videos)
    if first and first > 0:
        return cap.scored_to_cut(
            comments, first, lambda rows, text, prefix: analyze_comments(rows, text, threshold=threshold, columns=_COLUMNS, prefix=prefix), _COLUMNS)
    return analyze_comments(comments, threshold=threshold, columns=_COLUMNS)


def write_rows(rows: DataFrame, out: str, checkpoint: str, *partition_by: str) -> StreamingQuery:
    """All that has landed so far, as parquet in ``out``."""
    return (
        rows.drop(READ_AT).writeStream.format("parquet").partitionBy(*partition_by)
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_scored(scored: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """All pages landed so far, kept and spam side by side in ``out/is_spam=…``."""
    return write_rows(scored, out, checkpoint, "is_spam")


def write_capped(scored: DataFrame, out: str, checkpoint: str, limit: int, remembered: int | None = REMEMBERED) -> StreamingQuery:
    """Like :func:`write_scored`, at most ``limit`` kept comments per video, spam only up to the last of them.

    The totals live in the state of the query, in its checkpoint; see
    :func:`sparkcomments.streaming.cap.capped` for late pages and expiry.
    """
    return write_scored(cap.capped(scored, limit, remembered), out, checkpoint)


def read_scored(spark: SparkSession, out: str) -> DataFrame:
    """What :func:`write_scored` wrote; folder names carry the verdict as text."""
    return spark.read.parquet(out).withColumn("is_spam", F.col("is_spam").cast("boolean"))
