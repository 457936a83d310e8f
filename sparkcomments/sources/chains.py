"""Which videos were read to their end: gaps in the chain of landed pages.

The pages of a video are numbered from 0; each names the next by a token, the
last has none.  A chain is complete if every number up to the greatest landed one
is there and that page has no token.

Gaps are found between neighbours.  Pages are dealt by video and stretch of
numbers, so a video with a third of all pages is spread over as many tasks as it
has stretches; the gaps between stretches come from one row for each stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STRETCH = 65_536  # page numbers looked at in one place


def _numbers(pages: DataFrame, stretch: int) -> DataFrame:
    """Landed numbers, each once; a page with and without token counts as the last of a chain."""
    return pages.where(F.col("page_no") >= 0).groupBy(
        "video_id", F.floor(F.col("page_no") / stretch).alias("_stretch"), "page_no").agg(
        F.max(F.coalesce(F.col("nextPageToken"), F.lit("")) == "").alias("_last"))


def missing_pages(pages: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``video_id, from_page, to_page, gap``: one row for each stretch of missing pages.

    ``gap`` is ``start`` (before the first landed page), ``inside``, or ``end``: the
    last landed page names a next one, how many follow is not known and ``to_page``
    is null.  Videos of complete chains have no row.
    """
    numbers = _numbers(pages, stretch)
    c, after = F.col, Window.partitionBy("video_id", "_stretch").orderBy("page_no")
    inside = numbers.withColumn("_next", F.lead("page_no").over(after)).where("_next > page_no + 1").select(
        "video_id", (c("page_no") + 1).alias("from_page"), (c("_next") - 1).alias("to_page"), F.lit("inside").alias("gap"))
    edges = numbers.groupBy("video_id", "_stretch").agg(
        F.min("page_no").alias("_first"), F.max("page_no").alias("_end"), F.max_by("_last", "page_no").alias("_last"))
    order = Window.partitionBy("video_id").orderBy("_stretch")
    edges = edges.withColumns({"_before": F.lag("_end").over(order), "_following": F.lead("_first").over(order)})
    bounds = edges.select("video_id", F.expr("""inline(array(
        IF(_first > coalesce(_before, -1) + 1,
           struct(coalesce(_before, -1) + 1 AS from_page, _first - 1 AS to_page, IF(_before IS NULL, 'start', 'inside') AS gap), NULL),
        IF(_following IS NULL AND NOT _last, struct(_end + 1 AS from_page, CAST(NULL AS LONG) AS to_page, 'end' AS gap), NULL)))""")).where(
        "gap IS NOT NULL")
    return inside.unionByName(bounds)


def chain_summary(pages: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``video_id, pages, last_page, missing, ended, complete`` of each video with a landed page.

    ``missing`` counts the numbers that lack up to ``last_page``; ``ended`` tells that
    ``last_page`` names no next one.
    """
    stretches = _numbers(pages, stretch).groupBy("video_id", "_stretch").agg(
        F.count("*").alias("_n"), F.max(F.struct("page_no", "_last")).alias("_end"))
    videos = stretches.groupBy("video_id").agg(F.sum("_n").alias("pages"), F.max("_end").alias("_end"))
    missing = F.col("_end.page_no") + 1 - F.col("pages")
    return videos.select(
        "video_id", "pages", F.col("_end.page_no").alias("last_page"), missing.alias("missing"), F.col("_end._last").alias("ended"),
        (F.col("_end._last") & (missing == 0)).alias("complete"))
