"""Landed API pages and URL lists as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import schemas
from ..functions.inputs import whole_number
from ..functions.normalize import strip
from ..functions.urls import canonical_url
from ..staging import staged

PAGE_SIZE = 100


def _text(path: str):
    return F.coalesce(F.col(path), F.lit(""))


def _count(path: str):
    return F.coalesce(whole_number(F.col(path)), F.lit(0).cast("long"))


def flatten_comment_pages(pages: DataFrame, *more: str) -> DataFrame:
    """One row per top-level comment of landed pages; batch or stream.

    Replies are counted, not read.  ``arrival_pos`` is the order of arrival
    within a video.  A field that is missing or of another shape gets its default.
    Columns named in ``more`` come along.
    """
    items = pages.select("video_id", "page_no", *more, F.posexplode("items").alias("pos", "item")).where(
        F.col("item").isNotNull())
    comment = "item.snippet.topLevelComment.snippet"
    return items.select(
        "video_id",
        (F.col("page_no") * PAGE_SIZE + F.col("pos")).alias("arrival_pos"),
        _text(f"{comment}.authorDisplayName").alias("author_name"),
        _text(f"{comment}.authorChannelId.value").alias("author_channel_id"),
        _text(f"{comment}.textDisplay").alias("text"),
        _text(f"{comment}.publishedAt").alias("published_at"),
        F.coalesce(F.col(f"{comment}.likeCount"), F.lit(0)).cast("long").alias("like_count"),
        F.coalesce(F.col("item.snippet.totalReplyCount"), F.lit(0)).cast("long").alias("reply_count"),
        *more,
    )


def kept_answers(answers: DataFrame, *keys: Column, keep: str = "latest") -> DataFrame:
    """Of files read, one answer for each of ``keys``: the one that landed last, or first.

    Landing order is the time of the file, then its path, then the place in it.  A
    first pass reads keys and places only and notes the keys that landed more than
    once with the place to keep; these few rows are stored, and the answers are
    held against them where they are read.  So no text is shuffled, unless more
    keys landed again than a broadcast may hold.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    place = F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    placed = answers.select("*", *(key.alias(name) for key, name in zip(keys, names)), place.alias("_landed"))
    again = staged(
        placed.groupBy(*names).agg((F.max if keep == "latest" else F.min)("_landed").alias("_kept"), F.count("*").alias("_n"))
        .where("_n > 1").select(*(F.col(name).alias(f"_again{name}") for name in names), "_kept"), "landed_again")
    same = [F.col(name).eqNullSafe(F.col(f"_again{name}")) for name in names]
    return placed.join(again, same, "left").where(F.col("_kept").isNull() | (F.col("_landed") == F.col("_kept"))).select(
        *(F.col(f"`{name}`") for name in answers.columns))


def read_comment_answers(spark: SparkSession, path: str, keep: str = "latest") -> DataFrame:
    """The pages in a folder, each once: of a page landed again, the latest or the first."""
    pages = spark.read.schema(schemas.COMMENT_PAGE).json(path)
    return kept_answers(pages, F.col("video_id"), F.col("page_no"), keep=keep)


def read_comment_pages(spark: SparkSession, path: str, keep: str = "latest") -> DataFrame:
    """Comments of the pages in a folder; of a page landed again, the latest or the first counts."""
    return flatten_comment_pages(read_comment_answers(spark, path, keep))


#: Time at which a stream read a page; its watermark is what the state of streams is kept by.
READ_AT = "_read_at"
REMEMBERED = 30 * 86_400
#: A stream leaves out files older than this beside the newest; it remembers the names of all others.
OLDEST_FILE = "3650d"


def stream_comment_pages(
    spark: SparkSession, path: str, files_per_batch: int = 1000, remembered: int | None = REMEMBERED,
) -> DataFrame:
    """Comments of newly landed pages; a page counts the first time that it is read.

    State keeps which ``(video_id, page_no)`` were read, each for ``remembered``
    seconds at least; a page landed again long after is read anew.  The clock is
    that of the micro-batches, not that of the files, so a file copied with an old
    date is read like any other.  None reads every answer.
    """
    reader = spark.readStream.schema(schemas.COMMENT_PAGE).option("maxFilesPerTrigger", files_per_batch)
    pages = reader.option("maxFileAge", OLDEST_FILE).json(path)
    if remembered is None:
        return flatten_comment_pages(pages)
    timed = pages.withColumn(READ_AT, F.current_timestamp()).withWatermark(READ_AT, f"{remembered} seconds")
    return flatten_comment_pages(timed.dropDuplicatesWithinWatermark(["video_id", "page_no"]), READ_AT)


def flatten_video_pages(pages: DataFrame) -> DataFrame:
    """One row per landed answer that holds a video; others are left out."""
    item = "item"
    first = pages.select("video_id", F.get("items", F.lit(0)).alias(item)).where(F.col(item).isNotNull())
    video = F.coalesce(F.col("video_id"), F.col(f"{item}.id"))
    return first.select(
        video.alias("video_id"),
        _text(f"{item}.snippet.title").alias("title"),
        _text(f"{item}.snippet.publishedAt").alias("published_at"),
        _count(f"{item}.statistics.viewCount").alias("view_count"),
        _count(f"{item}.statistics.likeCount").alias("like_count"),
        _count(f"{item}.statistics.commentCount").alias("comment_count"),
        _text(f"{item}.snippet.channelId").alias("channel_id"),
        canonical_url(video).alias("url"),
    )


def read_video_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per video of the answers in a folder: that of the latest answer which holds it."""
    filled = spark.read.schema(schemas.VIDEO_PAGE).json(path).where(F.get("items", F.lit(0)).isNotNull())
    return flatten_video_pages(kept_answers(filled, F.coalesce(F.col("video_id"), F.get("items", F.lit(0))["id"])))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """``request_pos, url``: the filled lines of a file or folder, in order of file names and lines, repeats kept.

    ``request_pos`` counts all lines.  Rows are numbered within their stretch of
    a file and moved on by the line counts of the stretches before it; only these
    counts, one for each input split, are put in one order.
    """
    stretch = ["_file", "_start"]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"), strip(F.col("value")).alias("url"))
    before = Window.orderBy(*stretch).rowsBetween(Window.unboundedPreceding, -1)
    moved = lines.groupBy(*stretch).agg(F.min("_line").alias("_first"), F.count("*").alias("_n")).select(
        *stretch, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_by"))
    return lines.join(moved, stretch).where(F.col("url") != "").select(
        (F.col("_line") + F.col("_by")).alias("request_pos"), "url")


def read_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FETCH_LOG).json(path)
