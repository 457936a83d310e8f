"""Counts over scored comments; all with partial aggregation before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def video_summary(rows: DataFrame, by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Kept and flagged comments per video."""
    return rows.groupBy(*by).agg(
        F.count_if(~F.col("is_spam")).alias("comments_kept"),
        F.count_if("is_spam").alias("spam_filtered"),
    )


def with_spam_filtered(videos: DataFrame, spam: DataFrame, key: str = "video_id") -> DataFrame:
    """``videos`` with the number of flagged comments."""
    counts = spam.groupBy(key).agg(F.count("*").alias("spam_filtered"))
    return videos.join(counts, key, "left").withColumn("spam_filtered", F.coalesce("spam_filtered", F.lit(0)))


def totals(metadata: DataFrame, comments: DataFrame, spam: DataFrame) -> DataFrame:
    """One row: videos, comments, spam."""
    counted = [
        df.select(F.lit(name).alias("part")) for name, df in
        (("videos", metadata), ("comments", comments), ("spam", spam))
    ]
    parts = counted[0].unionByName(counted[1]).unionByName(counted[2])
    return parts.agg(*(F.count_if(F.col("part") == n).alias(f"{n}_total") for n in ("videos", "comments", "spam")))
