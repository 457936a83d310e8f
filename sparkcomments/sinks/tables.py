"""Export projections and the three result tables as files or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..staging import delete_folder


def _export(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(column).alias(name) for column, name in names.items()))


def export_metadata(videos: DataFrame) -> DataFrame:
    return _export(videos, schemas.METADATA_EXPORT)


def export_comments(comments: DataFrame, include_is_creator: bool = True) -> DataFrame:
    names = dict(schemas.COMMENTS_EXPORT)
    if not include_is_creator:
        del names["is_creator"]
    return _export(comments, names)


def export_spam(spam: DataFrame) -> DataFrame:
    return _export(spam, schemas.SPAM_EXPORT)


def _flags_as_words(df: DataFrame) -> DataFrame:
    """Booleans as ``True`` and ``False``, the way spreadsheet users see them."""
    return df.select(*(
        F.initcap(F.col(f"`{name}`").cast("string")).alias(name) if kind == "boolean" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ))


# Blanks stay, quotes are doubled, empty texts are written as nothing.
CSV_OPTIONS = dict(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _write_filled(df: DataFrame, path: str, kind: str, **options) -> None:
    """One run of the plan; a folder that got no row is taken away again."""
    spark = df.sparkSession
    df.write.mode("overwrite").format(kind).options(**options).save(path)
    if spark.read.schema(df.schema).format(kind).options(**options).load(path).isEmpty():
        delete_folder(spark, path)


def save_csv(base: str, metadata: DataFrame, comments: DataFrame, spam: DataFrame | None = None) -> str:
    """``<base>_metadata``, ``<base>_comments``, ``<base>_spam``; only filled tables.

    Each is a folder of UTF-8 part files with a header; quotes are doubled and
    blanks kept.  What stood in a folder before is replaced.
    """
    for suffix, df in (("metadata", metadata), ("comments", comments), ("spam", spam)):
        if df is not None:
            _write_filled(_flags_as_words(df), f"{base}_{suffix}", "csv", **CSV_OPTIONS)
    return base


def read_csv(spark: SparkSession, base: str, suffix: str) -> DataFrame:
    """A table of :func:`save_csv`, all columns as text; nothing written reads as an empty text."""
    df = spark.read.options(**CSV_OPTIONS, multiLine=True).csv(f"{base}_{suffix}")
    return df.select(*(F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name) for name in df.columns))


# Names of the tables of a workbook.
WORKBOOK_TABLES = ("Metadata", "Comments", "Flagged Spam")


def save_workbook(folder: str, metadata: DataFrame, comments: DataFrame, spam: DataFrame | None = None) -> str:
    """The three tables as parquet folders under their display names; only filled ones."""
    for name, df in zip(WORKBOOK_TABLES, (metadata, comments, spam)):
        if df is not None:
            _write_filled(df, f"{folder}/{name}", "parquet")
    return folder
