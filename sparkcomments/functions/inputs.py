"""Checks and parsers for request fields that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .normalize import strip
from .urls import url_error, video_id

_WHOLE_NUMBER = r"^[+-]?[0-9]+(_[0-9]+)*$"


def _filled(text: Column) -> Column:
    return text.isNotNull() & (strip(text) != "")


def whole_number(text: Column) -> Column:
    """``text`` as long; null where it is not a whole number."""
    bare = strip(text)
    return F.when(bare.rlike(_WHOLE_NUMBER), F.replace(bare, F.lit("_"), F.lit("")).try_cast("long"))


def lenient_likes(likes: Column) -> Column:
    """A like count that may be text; 0 where it cannot be read. Fractions of number columns are cut off."""
    fraction = F.typeof(likes).rlike("^(double|float|decimal)")
    number = F.floor(likes.try_cast("double")).try_cast("long")
    return F.coalesce(F.when(fraction, number).otherwise(whole_number(likes.cast("string"))), F.lit(0).cast("long"))


def date_error(date: Column) -> Column:
    """Why a date text is not accepted; null if it is, or if it is empty."""
    bare = strip(date)
    real = F.try_to_date(bare, "yyyy-MM-dd").isNotNull() & ~bare.startswith("0000")
    return F.when(
        _filled(date),
        F.when(
            ~bare.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
            F.concat(F.lit("Invalid date format: '"), bare, F.lit("'. Use YYYY-MM-DD")),
        ).when(~real, F.concat(F.lit("Invalid date: '"), bare, F.lit("'"))),
    )


def parse_date(date: Column) -> Column:
    """The trimmed date text; null where empty or not a date."""
    return F.when(_filled(date) & date_error(date).isNull(), strip(date))


def date_range_error(date_from: Column, date_to: Column) -> Column:
    """First problem of a range; null if there is none.  Compares as text."""
    both = (date_from != "") & (date_to != "")
    return F.coalesce(
        date_error(date_from),
        date_error(date_to),
        F.when(both & (date_from > date_to), "From date cannot be after To date"),
    )


def parse_min_likes(text: Column) -> tuple[Column, Column]:
    """(value, warning); 0 where empty or not usable."""
    number = whole_number(text)
    warning = F.when(
        _filled(text),
        F.when(number.isNull(), "Invalid min likes value, using 0")
        .when(number < 0, "Min likes cannot be negative, using 0"),
    )
    return F.when(number >= 0, number).otherwise(F.lit(0).cast("long")), warning


def parse_max_comments(text: Column) -> tuple[Column, Column]:
    """(value, warning); null, meaning unlimited, where empty or not usable."""
    number = whole_number(text)
    warning = F.when(
        _filled(text),
        F.when(number.isNull(), "Invalid max comments value, using unlimited")
        .when(number <= 0, "Max comments must be positive, using unlimited"),
    )
    return F.when(number > 0, number), warning


def parse_words(text: Column) -> Column:
    """Comma separated words, trimmed, without blank ones."""
    words = F.filter(F.transform(F.split(text, ","), strip), lambda w: w != "")
    return F.coalesce(words, F.array().cast("array<string>"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Text fields of requests, parsed, with ``error`` and ``warnings``.

    Adds ``video_id`` and replaces ``min_likes``, ``max_comments``, ``words``,
    ``date_from`` and ``date_to`` by their parsed values.  A malformed date means
    "no bound": dates are parsed before the range is checked.
    """
    c = F.col
    parsed = requests.withColumns({"_from": parse_date(c("date_from")), "_to": parse_date(c("date_to"))})
    min_likes, likes_warning = parse_min_likes(c("min_likes"))
    max_comments, max_warning = parse_max_comments(c("max_comments"))
    replaced = {
        "video_id": video_id(c("url")),
        "error": F.coalesce(url_error(c("url")), date_range_error(c("_from"), c("_to"))),
        "warnings": F.array_compact(F.array(likes_warning, max_warning)),
        "min_likes": min_likes,
        "max_comments": max_comments,
        "words": parse_words(c("words")),
        "date_from": c("_from"),
        "date_to": c("_to"),
    }
    kept = [c(x) for x in requests.columns if x not in replaced]
    return parsed.select(*kept, *(v.alias(k) for k, v in replaced.items()))


# Failure classes and their texts.
DISABLED, FORBIDDEN, NOT_FOUND, API_ERROR = "comments_disabled", "forbidden", "not_found", "api_error"
DISABLED_TEXT = "Comments are disabled for this video"
FORBIDDEN_TEXT = "Access forbidden (403): Check API key permissions"
NOT_FOUND_TEXT = "Video not found"
SHOWN_BODY_LENGTH = 200


def fetch_failure(status: Column, body: Column) -> tuple[Column, Column]:
    """(class, message) of a failed fetch.

    There is no class of its own for an exceeded quota: it reads as forbidden.
    """
    body = F.coalesce(body, F.lit(""))
    disabled = body.contains("commentsDisabled") | F.lower(body).contains("disabled comments")
    kind = (
        F.when((status == 403) & disabled, DISABLED).when(status == 403, FORBIDDEN)
        .when(status == 404, NOT_FOUND).otherwise(API_ERROR)
    )
    other = F.concat(
        F.lit("YouTube API error ("), status.cast("string"), F.lit("): "), F.substring(body, 1, SHOWN_BODY_LENGTH)
    )
    message = (
        F.when((status == 403) & disabled, DISABLED_TEXT).when(status == 403, FORBIDDEN_TEXT)
        .when(status == 404, NOT_FOUND_TEXT).otherwise(other)
    )
    return kind, message


def shown_failure(message: Column) -> Column:
    """The text a run reports for a failure message."""
    return (
        F.when(message.contains("403"), DISABLED_TEXT).when(message.contains("404"), NOT_FOUND_TEXT)
        .otherwise(message)
    )
