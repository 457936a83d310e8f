"""Substring dedup: difference-cover anchors.

A window is 13 consecutive words. The positions that are 0, 1 or 3 modulo 7 are a difference cover: whatever the two
offsets of a shared window are, one of its first seven places is a cover position in both documents, so that both hash
the seven words there (an anchor). Anchors, at three of seven positions, are all that every word is shuffled for. Those
that occur in two documents are kept in a filter; then only windows around them are extended to 13 words, grouped by
their hash, and resolved exactly: a word goes if a window over it also starts in a document with a smaller id.

Sizes. The filter is a bit table of fixed size (filter_bits), two bits for an anchor, broadcast. It only saves work: a false positive means that
a window is extended and found alone, and a full filter that all windows are extended. A frequent passage is counted
before each shuffle, and joined as the small side of a join that Spark splits. Nothing is grouped but the window places
of one document.

Window hashes have 64 bits. Null and empty texts have no words; texts of fewer than 13 words lose none. A text within
one document never counts against itself, nor do repeated rows of one id. Rows without a doc_id are kept whole and
count against nobody.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import release, staged, table, window_hashes, word_hashes

WINDOW, ANCHOR, PERIOD = 13, 7, 7
COVER = np.array([True, True, False, True, False, False, False])
ANCHOR_BITS = 48


def _anchors(words: np.ndarray) -> np.ndarray:
    """The anchor hash at each position; the top bits decide the place in the filter."""
    return window_hashes(words, ANCHOR) >> np.uint64(64 - ANCHOR_BITS)


def _covered(n: int) -> np.ndarray:
    return np.resize(COVER, n)


def anchors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each anchor of a document once: a and d."""
    def run(batches):
        for batch in batches:
            keys, hashes, counts = batch.column("d").to_numpy(), [], []
            for t in batch.column("t").to_pylist():
                words = word_hashes(t)
                x = _anchors(words) if len(words) >= WINDOW else np.zeros(0, np.uint64)
                x = np.unique(x[_covered(len(x))])
                hashes.append(x)
                counts.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.repeat(keys, counts))], ["a", "d"])

    return _slim(docs, key, text).mapInArrow(run, "a long, d long")


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("d"), F.xxhash64(text).alias("k"), F.col(text).cast("string").cast("binary").alias("t"))


#: Bits of the filter that one row of its table holds.
SEGMENT = 20


def _places(anchors_: np.ndarray, filter_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of an anchor: its top bits and its low ones."""
    return anchors_ >> np.uint64(ANCHOR_BITS - filter_bits), anchors_ & np.uint64((1 << filter_bits) - 1)


def shared_filter(docs: DataFrame, key: str, text: str, filter_bits: int) -> np.ndarray:
    """Two bits for every anchor that two documents have. Built by segments, which the driver only puts in a row."""
    shared = (anchors(docs, key, text).groupBy("a").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x < y"))
    places = shared.select(F.explode(F.array(F.shiftright("a", ANCHOR_BITS - filter_bits), F.expr(f"a & {(1 << filter_bits) - 1}"))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("bits"))

    def build(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            word, bits = batch.column("word").to_numpy(), batch.column("bits").to_numpy().view(np.uint64)
            for k in np.unique(word >> (SEGMENT - 6)):
                at = word >> (SEGMENT - 6) == k
                parts.setdefault(int(k), np.zeros(1 << (SEGMENT - 6), np.uint64))[word[at] & ((1 << (SEGMENT - 6)) - 1)] = bits[at]
        for k, x in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["segment", "bits"])

    segments = 1 << (filter_bits - SEGMENT)
    out = np.zeros(1 << (filter_bits - 6), np.uint64)
    rows = words.repartition(min(segments, 16), F.shiftright("word", SEGMENT - 6)).mapInArrow(build, "segment long, bits binary")
    for r in rows.toLocalIterator():
        out[r.segment << (SEGMENT - 6):(r.segment + 1) << (SEGMENT - 6)] = np.frombuffer(r.bits, np.uint64)
    return out


def windows(docs: DataFrame, key: str, text: str, found: np.ndarray, filter_bits: int) -> DataFrame:
    """The windows over anchors of the filter: w, their hash, d, and at: 32 bits of the text's hash and the place."""
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def holds(places: np.ndarray) -> np.ndarray:
        return (shared.value[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1)).astype(bool)

    def run(batches):
        for batch in batches:
            keys, hashes, places, counts = batch.column("d").to_numpy(), [], [], []
            for t, k in zip(batch.column("t").to_pylist(), batch.column("k").to_pylist()):
                words = word_hashes(t)
                n = len(words) - WINDOW + 1
                if n <= 0:
                    counts.append(0)
                    continue
                x = _anchors(words)
                high, low = _places(x, filter_bits)
                hit = np.flatnonzero(holds(high) & holds(low) & _covered(len(x)))
                step = np.zeros(n + PERIOD + 1, np.int32)  # windows that begin up to six words before an anchor
                np.add.at(step, np.clip(hit - PERIOD + 1, 0, n), 1)
                np.add.at(step, np.clip(hit + 1, 0, n), -1)
                at = np.flatnonzero(np.cumsum(step[:n]) > 0)
                hashes.append(window_hashes(words, WINDOW)[at].view(np.int64))
                places.append((at.astype(np.uint64) | np.uint64((k & 0xFFFFFFFF) << 32)).view(np.int64))
                counts.append(len(at))
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat(hashes)), pa.array(np.repeat(keys, counts)), pa.array(flat(places))], ["w", "d", "at"])

    return _slim(docs, key, text).mapInArrow(run, "w long, d long, at long")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bits: int = 27) -> DataFrame:
    """For each document with words to remove: d, k, 32 bits of its text's hash, and starts, where its windows begin that
    also start in a document with a smaller id."""
    found = shared_filter(docs, key, text, filter_bits)
    release(docs.sparkSession)
    rows = windows(docs, key, text, found, filter_bits)
    first = rows.groupBy("w").agg(F.min("d").alias("first"))
    return (rows.join(first, "w").where("d > first")
            .groupBy("d", F.expr("(at >> 32) & 4294967295L").alias("k")).agg(F.collect_set(F.expr("int(at & 4294967295L)")).alias("starts")))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "kept", filter_bits: int = 27) -> DataFrame:
    """Each row's key with n_words, n_removed and the kept words joined by a space (a hash of them if out is
    'kept_sha256')."""
    found = staged(repeated(docs, key, text, filter_bits), "repeated").withColumnsRenamed({"d": "__d", "k": "__k"})
    release(docs.sparkSession)
    t = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("key"), t.cast("binary").alias("t"), F.expr(f"xxhash64({text}) & 4294967295L").alias("k"))
    rows = rows.join(found, (F.col("key") == F.col("__d")) & (F.col("k") == F.col("__k")), "left").select("key", "t", "starts")

    def run(batches):
        for batch in batches:
            n, removed, kept = [], [], []
            for t, starts in zip(batch.column("t").to_pylist(), batch.column("starts")):
                words = t.split() if t else []
                gone = 0
                if starts.is_valid:
                    at = starts.values.to_numpy()
                    step = np.zeros(len(words) + 1, np.int32)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + WINDOW, -1)
                    keep = np.cumsum(step[:-1]) == 0
                    gone = int(len(words) - keep.sum())
                    words = [w for w, x in zip(words, keep) if x]
                n.append(len(words) + gone)
                removed.append(gone)
                body = b" ".join(words)
                kept.append(hashlib.sha256(body).hexdigest() if out == "kept_sha256" else body.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             [key, "n_words", "n_removed", out])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, n_words long, n_removed long, {out} string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), out="kept_sha256")
