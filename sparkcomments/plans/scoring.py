"""Scoring whole tables: the batch API."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scoring
from ..functions.inputs import lenient_likes
from ..operators import listed


def analyze_comments(
    df: DataFrame,
    text_col: str = "text",
    author_col: str | None = "author_name",
    likes_col: str | None = "like_count",
    threshold: float | Column = scoring.DEFAULT_THRESHOLD,
    blacklist: Sequence[str] | Column | None = None,
    whitelist: Sequence[str] | Column | None = None,
    columns: Sequence[str] = scoring.RESULT_COLUMNS,
    prefix: str = "",
) -> DataFrame:
    """Every row with its verdict, score, signals and reasons."""
    return scoring.analyze(
        df, F.col(f"`{text_col}`"),
        F.col(f"`{author_col}`") if author_col else None,
        lenient_likes(F.col(f"`{likes_col}`")) if likes_col else None,
        threshold, blacklist, whitelist, columns=columns, prefix=prefix,
    )


def analyze_listed(
    df: DataFrame, key: str, text_col: str = "text", author_col: str | None = "author_name", likes_col: str | None = "like_count",
    threshold: float | Column = scoring.DEFAULT_THRESHOLD, blacklist: DataFrame | None = None, whitelist: DataFrame | None = None,
    columns: Sequence[str] = scoring.RESULT_COLUMNS,
) -> DataFrame:
    """:func:`analyze_comments` with lists of any size, as tables ``position, pattern``; ``key`` is unique."""
    given = {"blacklist": blacklist, "whitelist": whitelist}
    found = {name: f"_{name}" for name, patterns in given.items() if patterns is not None}
    kept = df.columns
    for name, out in found.items():
        df = listed.with_first_listed(df, key, text_col, given[name], out)
    scored = analyze_comments(df, text_col, author_col, likes_col, threshold, columns=columns,
                              **{name: F.col(out) for name, out in found.items()})
    return scored.select(*(F.col(f"`{name}`") for name in dict.fromkeys([*kept, *columns])))


def analyze_batch(df: DataFrame, text_col: str = "text", threshold: float = scoring.DEFAULT_THRESHOLD) -> DataFrame:
    """Every row with its verdict, from the text alone."""
    return analyze_comments(df, text_col, None, None, threshold)


def filter_spam(
    df: DataFrame,
    text_col: str = "Comment Text",
    author_col: str | None = "Author Name",
    likes_col: str | None = "Comment Likes",
    threshold: float | Column = scoring.DEFAULT_THRESHOLD,
    include_scores: bool = False,
) -> DataFrame:
    """Rows that are not spam; with ``spam_score`` and ``spam_signals`` on request.

    Like counts may be text.  A caller's own columns stay, but for those two.
    Row-wise: no shuffle, works on streams.
    """
    wanted = ["is_spam", *(["spam_score", "reason", "primary_category"] if include_scores else [])]
    scored = analyze_comments(df, text_col, author_col, likes_col, threshold, columns=wanted, prefix="_verdict_")
    kept = scored.where("NOT _verdict_is_spam")
    added = ("spam_score", "spam_signals") if include_scores else ()
    columns = [F.col(f"`{c}`") for c in df.columns if c not in added]
    if include_scores:
        columns += [
            F.col("_verdict_spam_score").alias("spam_score"),
            F.when(F.col("_verdict_primary_category").isNull(), "").otherwise(F.col("_verdict_reason")).alias("spam_signals"),
        ]
    return kept.select(*columns)


def spam_flag(df: DataFrame, text_col: str, threshold: float = scoring.DEFAULT_THRESHOLD) -> DataFrame:
    """``df`` with the verdict on one text column as ``is_spam``."""
    return analyze_comments(df, text_col, None, None, threshold, columns=("is_spam",))


def spam_score(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with the score of one text column as ``spam_score``."""
    return analyze_comments(df, text_col, None, None, columns=("spam_score",))


def preset_sweep(df: DataFrame, text_col: str = "text", author_col: str = "author_name", likes_col: str = "like_count") -> DataFrame:
    """Spam per preset, scoring every row once."""
    scored = scoring.analyze(
        df, F.col(text_col), F.col(author_col), lenient_likes(F.col(likes_col)), columns=(), working=("final",))
    counts = scored.agg(*(
        F.count_if(F.col("final") >= limit).alias(name) for name, limit in scoring.PRESETS.items()
    ))
    pairs = ", ".join(f"'{name}', {limit}D, {name}" for name, limit in scoring.PRESETS.items())
    swept = counts.select(F.expr(f"stack({len(scoring.PRESETS)}, {pairs}) AS (preset, threshold, spam_count)"))
    return swept.withColumn("strength", scoring.strength_label(F.col("threshold")))
