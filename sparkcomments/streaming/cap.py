"""First N kept comments per video over a stream: one total per video in the state store."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.pages import READ_AT, REMEMBERED

# Columns reach the processor under plain names.
POSITION, SPAM, READ_MS, OTHERS = "arrival_pos", "is_spam", "read_ms", "others"
# Types that JSON gives back as they were.
_PACKED = (T.StringType, T.BooleanType, T.IntegerType, T.LongType, T.DoubleType)


def until_cut(positions: Sequence, spam: Sequence, left: int) -> list[int]:
    """Which rows have fewer than ``left`` kept ones before them, in order of position; rows without one come last."""
    out, kept = [], 0
    for i in sorted(range(len(positions)), key=lambda i: ((at := positions[i]) is None or at != at, at)):
        if kept >= left:
            break
        out.append(i)
        kept += not spam[i]
    return out


class FirstKept(StatefulProcessor):
    """Lets the rows of a video through until ``limit`` of them were kept ones.

    Reading order is that of the micro-batches, and by ``arrival_pos`` within one.
    State is the number kept so far and when the video was last read.  Of a
    micro-batch, only rows that can still be before the cut are held: at most as
    many kept ones as the limit leaves, the spam between them, and as many more
    or ``HELD``.
    """

    HELD = 1024

    def __init__(self, columns: list[str], limit: int, remembered_ms: int | None) -> None:
        self.columns, self.limit, self.remembered_ms = columns, limit, remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "kept long, expires long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before, expires = self.total.get() or (0, 0)
        left, held, most, read_ms = self.limit - before, [], self.HELD, 0
        for row in rows:
            if self.remembered_ms is not None:
                read_ms = max(read_ms, row[READ_MS])
            if left > 0:
                held.append(row)
                if len(held) >= most:
                    held = self._first(held, left)
                    most = 2 * max(len(held), self.HELD)
        held, was = self._first(held, left), (before, expires)
        if self.remembered_ms is not None:
            # Rounded up to a thirtieth of the span, so that a video read often does not move its timer each time.
            step = max(1, self.remembered_ms // 30)
            expires = -(-(read_ms + self.remembered_ms) // step) * step
            if expires != was[1]:
                if was[1]:
                    self.handle.deleteTimer(was[1])
                self.handle.registerTimer(expires)
        now = before + sum(not row[SPAM] for row in held)
        if (now, expires) != was:
            self.total.update((now, expires))
        if held:
            out, places = Row(*self.columns), [held[0].__fields__.index(name) for name in self.columns]
            for row in held:
                yield out(*(row[i] for i in places))

    @staticmethod
    def _first(rows: list[Row], left: int) -> list[Row]:
        return [rows[i] for i in until_cut([row[POSITION] for row in rows], [row[SPAM] for row in rows], left)]

    @staticmethod
    def _until_cut(rows: pd.DataFrame, left: int) -> pd.DataFrame:
        """:func:`until_cut` of a frame."""
        return rows.iloc[until_cut(rows[POSITION].tolist(), rows[SPAM].tolist(), left)]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.total.clear()
        return iter(())

    def close(self) -> None:
        pass


def before_cut(videos: pd.Series, positions: pd.Series, spam: pd.Series, limit: int) -> pd.Series:
    """Which rows have fewer than ``limit`` kept ones before them in their video, among these rows."""
    rows = pd.DataFrame({"video": videos, "at": positions, "kept": (~spam.astype(bool)).astype("int64")}).sort_values("at", kind="stable")
    rows["before"] = rows.groupby("video", dropna=False)["kept"].cumsum() - rows["kept"]
    least = rows.groupby(["video", "at"], dropna=False)["before"].transform("min")  # of rows at one place, none is before another
    return (least < limit).reindex(videos.index)


def _may_pass(limit: int):
    @F.pandas_udf("boolean")
    def may_pass(videos: pd.Series, positions: pd.Series, spam: pd.Series) -> pd.Series:
        return before_cut(videos, positions, spam, limit)

    return may_pass.asNondeterministic()  # the answer depends on the rows read together: it is asked for once, where it stands


#: Of a video, so many times the limit are scored before it is known whether the rest must be.
LIKELY = 3
#: Positions that a task remembers at most.
NOTED = 2_000_000
_LAST = np.iinfo(np.int64).max


class Bounds:
    """Of each video, the ``n``-th smallest position among the rows that a task has read up to now.

    What is remembered is bounded: beyond that, videos of fewer rows are forgotten.
    A video without a bound only means that nothing is known to come after it.
    """

    def __init__(self, n: int) -> None:
        self.n, self.room = n, max(2, NOTED // n)
        self.places: dict[Any, int] = {}
        self.smallest = np.full((1, n), _LAST)  # the first line is that of videos not remembered: it stays empty

    def beyond(self, videos: pd.Series, positions: pd.Series, counted: np.ndarray | None = None) -> np.ndarray:
        """Which of these rows come after the ``n``-th of the ``counted`` rows of their video; rows at one place do not come after each other."""
        codes, names = pd.factorize(videos, use_na_sentinel=False)
        at, lines = positions.to_numpy(), self._lines(names, np.bincount(codes, minlength=len(names)))
        counted = lines[codes] > 0 if counted is None else counted & (lines[codes] > 0)
        self._note(lines[codes][counted], at[counted])
        return at > self.smallest[lines, -1][codes]

    def _lines(self, names: np.ndarray, rows: np.ndarray) -> np.ndarray:
        lines = np.array([self.places.get(name, 0) for name in names], dtype=np.int64)
        new = np.flatnonzero(lines == 0)
        if len(self.places) + len(new) > self.room:
            full = {name: line for name, line in self.places.items() if self.smallest[line, -1] < _LAST}
            full = full if len(full) <= self.room // 2 else {}
            self.smallest = self.smallest[[0, *full.values()]]
            self.places = {name: line for line, name in enumerate(full, 1)}
            lines = np.array([self.places.get(name, 0) for name in names], dtype=np.int64)
            new = np.flatnonzero(lines == 0)
            new = new[np.argsort(-rows[new], kind="stable")][:self.room - len(self.places)]
        first = len(self.places) + 1
        lines[new] = np.arange(first, first + len(new))
        self.places.update(zip(names[new], lines[new].tolist()))
        short = first + len(new) - len(self.smallest)
        if short > 0:
            self.smallest = np.concatenate([self.smallest, np.full((max(short, len(self.smallest)), self.n), _LAST)])
        return lines

    def _note(self, lines: np.ndarray, at: np.ndarray) -> None:
        near = at < self.smallest[lines, -1]
        lines, at = lines[near], at[near]
        order = np.lexsort((at, lines))
        own, first, which = np.unique(lines[order], return_index=True, return_inverse=True)
        rank = np.arange(len(order)) - first[which]
        near = rank < self.n
        more = np.full((len(own), self.n), _LAST)
        more[which[near], rank[near]] = at[order][near]
        self.smallest[own] = np.sort(np.concatenate([self.smallest[own], more], axis=1), axis=1)[:, :self.n]


def _early(limit: int):
    @F.pandas_udf("boolean")
    def early(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        likely = Bounds(LIKELY * limit)
        for videos, positions in rows:
            yield pd.Series(~likely.beyond(videos, positions))

    return early.asNondeterministic()


def _open(limit: int):
    @F.pandas_udf("boolean")
    def still_open(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cut = Bounds(limit)
        for videos, positions, scored, spam in rows:
            kept = scored.to_numpy(dtype=bool) & ~spam.to_numpy(dtype=bool)
            yield pd.Series(~cut.beyond(videos, positions, kept))

    return still_open.asNondeterministic()


def scored_to_cut(comments: DataFrame, limit: int, score: Callable[[DataFrame, str, str], DataFrame], verdict: Sequence[str]) -> DataFrame:
    """``comments`` with the columns ``verdict``, but for those that come after ``limit`` kept ones of their video.

    A comment is left out unscored only where so many kept ones stand before it
    among those read in the same task, so the cap, which reads all of them in order,
    comes to the same rows.  Of a video, the first of the rows read together are
    scored; the rest is where these did not hold enough kept ones.
    ``score(df, text_col, prefix)`` adds the columns ``verdict``, each with the prefix
    before its name; rows whose text is null cost it next to nothing.
    """
    kept = [F.col(f"`{name}`") for name in comments.columns if name not in verdict]
    at = "video_id", F.coalesce(POSITION, F.lit(2**63 - 1))  # what has no place comes last, as in the cap
    rows = comments.select(*kept, _early(limit)(*at).alias("_early"))
    rows = score(rows.withColumn("_read", F.when(F.col("_early"), F.col("text"))), "_read", "_first_")
    rows = rows.withColumn("_open", _open(limit)(*at, "_early", "_first_" + SPAM)).where("_open")
    rows = score(rows.withColumn("_read", F.when(~F.col("_early"), F.col("text"))), "_read", "_then_")
    return rows.select(*kept, *(F.when(F.col("_early"), F.col(f"_first_{x}")).otherwise(F.col(f"_then_{x}")).alias(x) for x in verdict))


def capped(scored: DataFrame, limit: int, remembered: int | None = REMEMBERED) -> DataFrame:
    """The rows of a stream of scored comments that are read before the cap of their video is reached.

    A page that lands late, after later pages of its video, is read when it lands:
    it takes what the pages before it in time have left.  ``limit`` 0 means
    unlimited.  Totals are kept as the reader keeps its pages: ``remembered`` seconds
    at least after the last reading of a comment of the video; a video read again
    long after starts anew.  None keeps totals for good.
    """
    timed = remembered is not None and READ_AT in scored.columns
    out = scored.drop(READ_AT)
    if not limit or limit < 0:
        return out
    # Rows of a micro-batch that are beyond the cut among those read together need not go to their video's one task:
    # what is before the cut of all rows is before it among any of them.
    rows = scored.withColumn("_may_pass", _may_pass(limit)("video_id", POSITION, SPAM)).where("_may_pass")
    # Python reads a row column by column: what it does not look at travels as one text.
    plain = {f.name: f.name if f.name in (POSITION, SPAM) else f"c{i}" for i, f in enumerate(out.schema)}
    others = [f for f in out.schema if f.name not in ("video_id", POSITION, SPAM) and isinstance(f.dataType, _PACKED)]
    own = [f for f in out.schema if f not in others]
    columns = [F.col(f"`{f.name}`").alias(plain[f.name]) for f in own]
    schema = T.StructType([T.StructField(plain[f.name], f.dataType) for f in own])
    if others:
        columns.append(F.to_json(F.struct(*(F.col(f"`{f.name}`").alias(plain[f.name]) for f in others))).alias(OTHERS))
        schema = schema.add(OTHERS, T.StringType())
    more = [F.unix_millis(READ_AT).alias(READ_MS)] if timed else []
    first = rows.select(*columns, *more).groupBy(plain["video_id"]).transformWithState(
        statefulProcessor=FirstKept(schema.names, limit, remembered * 1000 if timed else None), outputStructType=schema,
        outputMode="Append", timeMode="EventTime" if timed else "None")
    if others:
        types = T.StructType([T.StructField(plain[f.name], f.dataType) for f in others])
        first = first.withColumn(OTHERS, F.from_json(OTHERS, types, {"mode": "FAILFAST"}))
    return first.select(*(F.col(plain[f.name] if f in own else f"{OTHERS}.{plain[f.name]}").alias(f.name) for f in out.schema))
