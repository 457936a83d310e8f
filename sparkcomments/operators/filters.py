"""The filters before scoring, and the creator flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.words import contains_word


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def attach_creator(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """Comments of known videos, with ``is_creator``.

    A plain equi-join: Catalyst broadcasts ``videos`` while it is under the
    broadcast threshold; beyond it, adaptive execution splits the partitions of
    videos that hold a large share of the comments.
    """
    creators = videos.select("video_id", F.col("channel_id").alias("_creator"))
    return comments.join(creators, "video_id").withColumn("is_creator", is_creator("author_channel_id", "_creator")).drop("_creator")


def is_creator(author: str, creator: str) -> Column:
    return F.when(F.col(creator) != "", F.col(author) == F.col(creator)).otherwise(False)


def not_by_creator(exclude=True) -> Column:
    return ~(_column(exclude) & F.col("is_creator"))


def min_likes(least) -> Column:
    return F.col("like_count") >= _column(least)


def in_date_range(date_from=None, date_to=None) -> Column:
    """Both ends inclusive, compared as text.  A bound that is empty is none.

    A comment without a date passes an upper bound but no lower one.
    """
    day = F.substring(F.col("published_at"), 1, 10)
    passes = F.lit(True)
    for bound, check in ((date_from, day.__ge__), (date_to, day.__le__)):
        if isinstance(bound, Column):
            passes = passes & (bound.isNull() | (bound == "") | check(bound))
        elif bound:
            passes = passes & check(F.lit(bound))
    return passes


def has_word(words: Column | Sequence[str] | None) -> Column:
    return F.lit(True) if words is None else contains_word(F.col("text"), words)
