"""Resampling documents towards a target: hashed n-gram importance weights and a Gumbel top-k draw.

Features are the runs of one to ``longest`` consecutive words, joined by one space, repeats counted; words are runs of
digits, letters and characters beyond ASCII, A-Z in lower case. A feature's bucket is the CRC-32 of its UTF-8 bytes
modulo ``buckets``. The documents and the target each give a count for every bucket; a bucket's gain is the floored
thousandfold logarithm of the ratio of the two smoothed shares, and a document's weight the sum of gains over its features.

CRCs come from length-bucketed matrices. The distinct features of a stretch of texts are grouped by their length in bytes;
a group is one two-dimensional uint8 array, a row for each feature. All its CRCs advance together, one column at a time,
by one table lookup; the results are scattered back to the features' places, and from there to the words of the texts.

Tasks send at most one number for each bucket, which Spark adds up; the gains, ``buckets`` whole numbers, go to the tasks.
The draw adds to each weight a Gumbel number made of the id's SHA-256, so it is the same on every run, and takes the
greatest: ranks come from ranges of the order and their counts (``operators.ordering``), in as many tasks as there are ranges.

Texts are taken whole, in stretches of about STRETCH bytes; memory is bounded by that and the longest text. A matrix holds
at most MATRIX bytes; features of more than COLUMNS bytes, of which a group has few, take zlib's loop to the same value.
A null text has no words, a null id counts as the empty text and comes last among equals; repeated rows are documents of
their own, told apart by their columns, and have neighbouring ranks in any order if these are equal too. Documents under
``least_words`` words get weight and score but no rank. Without documents or target the formula holds with zero counts.
The result has the columns ``doc_id, n_features, weight, score, rank`` only; ids are whole numbers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordering import ranked
from .common import staged, table, terms

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
STRETCH = 1 << 22
MATRIX = 1 << 22
COLUMNS = 4096


def _crc_steps() -> np.ndarray:
    """What one byte does to a CRC: the 256 remainders of the reflected polynomial."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


STEPS = _crc_steps()


def matrix_crcs(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a uint8 matrix."""
    crcs = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crcs = STEPS[(crcs ^ column) & 0xFF] ^ (crcs >> 8)
    return ~crcs


def feature_crcs(features: np.ndarray) -> np.ndarray:
    """CRC-32 of each of an object array of bytes."""
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    out = np.zeros(len(features), np.uint32)
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for start, end in zip(cuts, [*cuts[1:], len(order)]):
        length = int(lengths[order[start]])
        if length > COLUMNS:
            out[order[start:end]] = [zlib.crc32(x) for x in features[order[start:end]]]
            continue
        step = max(1, MATRIX // max(1, length))
        for a in range(start, end, step):
            places = order[a:min(a + step, end)]
            out[places] = matrix_crcs(np.frombuffer(b"".join(features[places]), np.uint8).reshape(len(places), length))
    return out


def runs(words: list[bytes], longest: int) -> list[bytes]:
    found = list(words)
    for n in range(2, longest + 1):
        found += [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return found


def stretches(texts: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first place, texts) of about STRETCH bytes."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1] or b"")
        if size >= STRETCH:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def bucketed(texts: list[bytes | None], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, features of each text, words of each text)."""
    features, counts, words = [], [], []
    for text in texts:
        found = terms(text)
        words.append(len(found))
        found = runs(found, longest)
        counts.append(len(found))
        features += found
    places, distinct = pd.factorize(np.array(features, dtype=object)) if features else (np.zeros(0, np.int64), np.zeros(0, object))
    crcs = (feature_crcs(distinct) % np.uint32(buckets)).astype(np.int64)
    return crcs[places], np.array(counts, np.int64), np.array(words, np.int64)


def bucket_counts(texts: DataFrame, text: str, buckets: int, longest: int) -> DataFrame:
    """``bucket, n``: features of all texts by bucket."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, held in stretches(batch.column(0)):
                total += np.bincount(bucketed(held, buckets, longest)[0], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["bucket", "n"])

    parts = texts.select(F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Gain of each bucket; ``buckets`` counts of either side come to the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for side, df in ((s, docs), (t, target)):
        for row in bucket_counts(df, text, buckets, longest).collect():
            side[row.bucket] = row.n
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([
        math.floor(1000 * math.log(float(int(b) + 1) * (all_s + buckets) / (float(int(a) + 1) * (all_t + buckets))))
        for a, b in zip(s, t)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_features, n_words, weight`` of every row."""
    given = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in stretches(batch.column(1)):
                places, counts, words = bucketed(held, len(given.value), longest)
                sums = np.concatenate([[0], np.cumsum(given.value[places])])
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(held)), pa.array(counts), pa.array(words), pa.array(sums[ends] - sums[ends - counts])],
                    ["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("t"))
    return rows.mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, longest: int = LONGEST,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; rank is null where it is not drawn."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8)
    gumbel = F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0)))
    scored = weighed(docs, gains(docs, target, buckets=buckets, longest=longest), longest=longest)
    stored = staged(scored.withColumns({
        "score": F.col("weight") + gumbel, "eligible": F.col("n_words") >= least_words}), "resample")
    drawn = stored.where("eligible").count() * percent // 100
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = ranked(stored.withColumn("all", F.lit(0)), "all", order, "place")
    rank = F.when(F.col("eligible") & (F.col("place") <= drawn), F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
