"""Video ids and URL checks as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .normalize import strip

# URL forms that carry a video id, tried in this order.
_ID = "([a-zA-Z0-9_-]{11})"
URL_FORMS = (
    rf"youtube\.com/watch\?v={_ID}",
    rf"youtube\.com/v/{_ID}",
    rf"youtube\.com/embed/{_ID}",
    rf"youtube\.com/shorts/{_ID}",
    rf"youtu\.be/{_ID}",
)
CANONICAL_URL = "https://www.youtube.com/watch?v="
SHOWN_URL_LENGTH = 50


def video_id(url: Column) -> Column:
    """The 11 character id of the first URL form found in ``url``; null if none."""
    text = strip(url)
    return F.coalesce(*(F.nullif(F.regexp_extract(text, form, 1), F.lit("")) for form in URL_FORMS))


def canonical_url(id_column: Column) -> Column:
    return F.concat(F.lit(CANONICAL_URL), id_column)


def url_error(url: Column) -> Column:
    """Why ``url`` is not accepted; null if it is."""
    shown = F.when(
        F.char_length(url) > SHOWN_URL_LENGTH, F.concat(F.substring(url, 1, SHOWN_URL_LENGTH), F.lit("..."))
    ).otherwise(url)
    return (
        F.when(url.isNull() | (strip(url) == ""), "URL cannot be empty")
        .when(video_id(url).isNull(), F.concat(F.lit("Invalid YouTube URL format: "), shown))
    )


def url_summary(lines: DataFrame, url: str, by: list[str] | None = None) -> DataFrame:
    """Counts of accepted and rejected lines and the message for them.

    Blank lines count as neither.  One aggregation with partial sums, per ``by``
    group if given.
    """
    filled = F.col(url).isNotNull() & (strip(F.col(url)) != "")
    accepted = video_id(F.col(url)).isNotNull()
    counts = lines.groupBy(*(by or [])).agg(
        F.count_if(filled & accepted).alias("valid_count"),
        F.count_if(filled & ~accepted).alias("invalid_count"),
    )
    valid, invalid = F.col("valid_count"), F.col("invalid_count")
    message = (
        F.when((valid == 0) & (invalid == 0), "")
        .when(valid == 0, "⚠ No valid URLs detected")
        .when(invalid == 0, F.format_string("✓ %d valid URL%s", valid, F.when(valid == 1, "").otherwise("s")))
        .otherwise(F.format_string("✓ %d valid, %d invalid", valid, invalid))
    )
    return counts.withColumn("message", message)
