"""The whole run: requests, videos and comments to three tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scoring
from ..functions.inputs import fetch_failure, shown_failure
from ..functions.urls import video_id
from ..functions.words import matches_words, words_pattern
from ..operators import aggregates, cap, filters, ordering
from ..staging import staged

COMMENT_COLUMNS = (
    "video_id", "arrival_pos", "author_name", "author_channel_id", "text", "published_at",
    "like_count", "reply_count", "is_creator",
)
SPAM_COLUMNS = ("spam_score", "spam_reason", "spam_category", "had_obfuscation")


@dataclass(frozen=True)
class Options:
    """Settings of a run; a request table may carry its own instead."""

    min_likes: int = 0
    max_comments: int | None = None
    words: Sequence[str] = field(default_factory=tuple)
    date_from: str | None = None
    date_to: str | None = None
    filter_spam: bool = False
    exclude_creator: bool = False
    sort_by: str = "likes"
    threshold: float = scoring.DEFAULT_THRESHOLD

    def columns(self):
        words = F.array(*map(F.lit, self.words)) if self.words else F.array().cast("array<string>")
        return {
            "min_likes": F.lit(self.min_likes).cast("long"),
            "max_comments": F.lit(self.max_comments).cast("long"),
            "words": words,
            "date_from": F.lit(self.date_from).cast("string"),
            "date_to": F.lit(self.date_to).cast("string"),
            "filter_spam": F.lit(self.filter_spam),
            "exclude_creator": F.lit(self.exclude_creator),
            "sort_by": F.lit(self.sort_by),
            "threshold": F.lit(self.threshold).cast("double"),
        }


@dataclass(frozen=True)
class Result:
    """Tables of a run, in output order, and the requests that gave none."""

    metadata: DataFrame
    comments: DataFrame
    spam: DataFrame
    rejects: DataFrame


def requests_for(urls: DataFrame, options: Options = Options()) -> DataFrame:
    """``request_pos, url`` with video ids and the same options for every request."""
    return urls.select("request_pos", "url", video_id(F.col("url")).alias("video_id")).withColumns(options.columns())


def requested_videos(requests: DataFrame, videos: DataFrame, failures: DataFrame | None):
    """(requests with their video, rejected requests).

    A request is rejected for the first reason found: its URL, a failed fetch of
    its video, no such video.  Of repeated rows of a video the latest by ``landed``
    counts, where there is such a column (``read_video_pages`` keeps one row anyway);
    of equally late ones the greatest in column order.
    """
    c = F.col
    late = [name for name in videos.columns if name == "landed"]
    others = [name for name in videos.columns if name not in ("video_id", "landed")]
    videos = videos.groupBy("video_id").agg(F.max(F.struct(*late, *others)).alias("v")).select(
        "video_id", *(f"v.{name}" for name in others))
    found = requests.join(videos.withColumnRenamed("url", "video_url").withColumn("_found", F.lit(True)), "video_id", "left")
    if failures is not None:
        failed_id, (kind, message) = video_id(c("url")), fetch_failure(c("status"), c("body"))
        failed = (
            failures.select(failed_id.alias("video_id"), F.struct(kind.alias("kind"), message.alias("message")).alias("f"))
            .groupBy("video_id").agg(F.min("f").alias("_failure"))
        )
        found = found.join(failed, "video_id", "left")
    else:
        found = found.withColumn("_failure", F.lit(None).cast("struct<kind:string,message:string>"))
    message = (
        F.when(c("video_id").isNull(), F.concat(F.lit("Invalid YouTube URL: "), c("url")))
        .when(c("_failure").isNotNull(), c("_failure.message"))
        .when(c("_found").isNull(), F.concat(F.lit("Video not found: "), c("video_id")))
    )
    kind = (
        F.when(c("video_id").isNull(), "invalid_url").when(c("_failure").isNotNull(), c("_failure.kind"))
        .when(c("_found").isNull(), "not_found")
    )
    found = found.withColumns({"reason": kind, "message": message})
    rejects = found.where(c("reason").isNotNull()).select(
        "request_pos", "url", "reason", "message", shown_failure(c("message")).alias("shown"))
    return found.where(c("reason").isNull()).drop("_found", "_failure", "reason", "message"), rejects


def asked_for(requested: DataFrame) -> DataFrame:
    """What each request asks of its video's comments."""
    return requested.select(
        "request_pos", F.col("video_id").alias("_video"), F.col("channel_id").alias("_creator"), "min_likes", "max_comments",
        words_pattern(F.col("words")).alias("_pattern"),
        "date_from", "date_to", "filter_spam", "exclude_creator", "sort_by", "threshold",
    )


def _passes() -> Column:
    """Whether a comment beside a request is of its video and passes its filters before scoring."""
    c = F.col
    return (
        (c("video_id") == c("_video"))
        & ~(c("exclude_creator") & filters.is_creator("author_channel_id", "_creator"))
        & filters.min_likes(c("min_likes"))
        & filters.in_date_range(c("date_from"), c("date_to"))
        & matches_words(c("text"), c("_pattern"))
    )


def score_requested(asked: DataFrame, comments: DataFrame, blacklist=None, whitelist=None) -> DataFrame:
    """Comments that some request selects, each scored once, whatever number of requests does."""
    selected = comments.select(*COMMENT_COLUMNS[:-1]).join(asked, _passes(), "left_semi")
    return scoring.analyze(
        selected, F.col("text"), F.col("author_name"), F.col("like_count"), blacklist=blacklist, whitelist=whitelist,
        columns=("spam_score", "reason", "primary_category", "had_obfuscation"), working=("final", "gate"),
    )


def deal_to_requests(scored: DataFrame, asked: DataFrame) -> DataFrame:
    """Scored comments of each request, with the verdict at its threshold; without spam filter all are kept."""
    c = F.col
    return scored.join(asked, _passes()).select(
        "request_pos", "sort_by", "max_comments", *COMMENT_COLUMNS[:-1],
        filters.is_creator("author_channel_id", "_creator").alias("is_creator"),
        (c("filter_spam") & scoring.verdict(c("threshold"))).alias("is_spam"),
        "spam_score", c("reason").alias("spam_reason"),
        F.coalesce("primary_category", F.lit("")).alias("spam_category"), "had_obfuscation",
    )


def run(
    requests: DataFrame,
    videos: DataFrame,
    comments: DataFrame,
    failures: DataFrame | None = None,
    blacklist: Sequence[str] | None = None,
    whitelist: Sequence[str] | None = None,
) -> Result:
    """Metadata, kept comments and flagged spam for every request.

    A comment is scored once, however many requests select it, and then dealt to
    them: into a table partitioned by verdict; the cap, the counts and both outputs
    read only the columns they need from it.  The table is one of the workspace in
    use (``sparkcomments.staging``): read the results before that is closed.
    """
    requested, rejects = requested_videos(requests, videos, failures)
    asked = asked_for(requested)
    scored = staged(deal_to_requests(score_requested(asked, comments, blacklist, whitelist), asked), "scored", "is_spam")
    read = cap.capped(scored, "request_pos", "max_comments", ~F.col("is_spam"))
    spam = read.where("is_spam")
    metadata = aggregates.with_spam_filtered(
        requested.select(
            "request_pos", "video_id", "title", "published_at", "view_count", "like_count", "comment_count",
            "channel_id", F.col("video_url").alias("url"),
        ),
        spam, "request_pos",
    )
    return Result(
        metadata.orderBy("request_pos"),
        read.where("NOT is_spam").select("request_pos", "sort_by", *COMMENT_COLUMNS)
        .orderBy("request_pos", *ordering.comment_order(F.col("sort_by"))).drop("sort_by"),
        spam.select("request_pos", *COMMENT_COLUMNS[:-1], *SPAM_COLUMNS).orderBy("request_pos", *ordering.spam_order()),
        rejects,
    )


def run_urls(urls: DataFrame, videos: DataFrame, comments: DataFrame, options: Options = Options(), **more) -> Result:
    """:func:`run` for a list of URLs that share their options."""
    return run(requests_for(urls, options), videos, comments, **more)
