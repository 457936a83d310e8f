"""First N kept comments per group, without a window over whole groups.

The cap of a group is a position: that of its N-th kept comment.  It is found
from counts per stretch of positions, so a group that holds a third of all rows
is spread over as many tasks as it has stretches; only its one boundary stretch
is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STRETCH = 65_536  # positions per stretch, hence most rows ordered in one place


def cutoffs(rows: DataFrame, group: str, limit: str, kept: Column, stretch: int = STRETCH) -> DataFrame:
    """``group, cutoff``: position of the N-th kept row; no row for groups with fewer.

    ``limit`` is a column, constant within a group; null or 0 means unlimited.
    ``arrival_pos`` must be unique within a group.
    """
    candidates = rows.where(kept & (F.col(limit) > 0)).select(
        group, F.col(limit).alias("_limit"), "arrival_pos",
        F.floor(F.col("arrival_pos") / stretch).alias("_stretch"),
    )
    totals = candidates.groupBy(group, "_limit", "_stretch").agg(F.count("*").alias("_n"))
    running = F.sum("_n").over(
        Window.partitionBy(group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0)
    )
    totals = totals.withColumn("_until", running).withColumn("_before", F.col("_until") - F.col("_n"))
    boundary = totals.where((F.col("_before") < F.col("_limit")) & (F.col("_until") >= F.col("_limit"))).select(
        group, "_stretch", (F.col("_limit") - F.col("_before")).alias("_nth")
    )
    rank = F.row_number().over(Window.partitionBy(group, "_stretch").orderBy("arrival_pos"))
    return (
        candidates.join(boundary, [group, "_stretch"])
        .withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_nth"))
        .select(group, F.col("arrival_pos").alias("cutoff"))
    )


def up_to_cutoff(rows: DataFrame, cutoff: DataFrame, group: str) -> DataFrame:
    """Rows up to the cutoff of their group: reading stops at the N-th kept one."""
    return (
        rows.join(cutoff, group, "left")
        .where(F.col("cutoff").isNull() | (F.col("arrival_pos") <= F.col("cutoff")))
        .drop("cutoff")
    )


def capped(rows: DataFrame, group: str, limit: str, kept: Column, stretch: int = STRETCH) -> DataFrame:
    """Rows that are read before the cap of their group is reached.

    ``rows`` is read more than once, so it should be a stored table.
    """
    return up_to_cutoff(rows, cutoffs(rows, group, limit, kept, stretch), group)
