"""Output order of comments and spam."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import staged

# Sort keys and their display names.
SORT_NAMES = {"Likes": "likes", "Date (Newest)": "date_desc", "Date (Oldest)": "date_asc"}


def sort_key(display_name: str) -> str:
    return SORT_NAMES.get(display_name, "likes")


def comment_order(sort_by: Column | str = "likes") -> list[Column]:
    """Sort columns within a video; an unknown key keeps arrival order.

    Ties always keep arrival order.  A constant key leaves one sort column, the
    others fold to constants.
    """
    key = sort_by if isinstance(sort_by, Column) else F.lit(sort_by)
    likes, date = F.col("like_count"), F.col("published_at")
    by_key = {"likes": likes.desc(), "date_desc": date.desc(), "date_asc": date.asc()}
    if isinstance(sort_by, str):
        return [*([by_key[sort_by]] if sort_by in by_key else []), F.col("arrival_pos").asc()]
    return [
        F.when(key == "likes", likes).desc(),
        F.when(key == "date_desc", date).desc(),
        F.when(key == "date_asc", date).asc(),
        F.col("arrival_pos").asc(),
    ]


def spam_order() -> list[Column]:
    """By the rounded score."""
    return [F.col("spam_score").desc(), F.col("arrival_pos").asc()]


def ranked(rows: DataFrame, group: str, order: list[Column], out: str = "rank") -> DataFrame:
    """``rows`` with their place within ``group``, from 1.

    Rows are spread by ranges of the order, ranked within each range, and moved
    on by the counts of the ranges before it, so a large group is ranked by many
    tasks.  The ranges are stored, as their limits come from a sample.
    """
    spread = staged(
        rows.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy(group, "_range").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    return (
        spread.join(counts, [group, "_range"])
        .withColumn(out, F.col("_before") + place).drop("_range", "_before")
    )
