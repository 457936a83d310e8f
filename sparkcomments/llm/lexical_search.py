"""Ranked lexical search over bit-sliced Bloom signatures; the ranking is exact.

**Index.** Every document with a term gets a Bloom signature. Its keys are (term, level): level 0 for each of its terms,
and a further level for each of LEVELS that the term's count reaches. Documents of about equal numbers of keys share a
width, so that a signature holds at least ``bits`` bits for a key. A row of the index is a block of such documents with
their ids, their numbers of terms, and one bitmap for each bit of the signature: bit b's slice has a bit for each document.

**Bounds.** A term's documents are the AND of its slices. This overestimates presence and, with the levels, the count: a
document whose highest level is i has the term at most LEVELS[i+1] - 1 times. The score grows with that count, so the sum
over levels of (weights of the terms that reach the level) times (what the level adds for a document of its length) is an
upper bound of the document's score. All is whole numbers: no bound is rounded below its score.

**Search.** Of each item, the ``probe`` documents of the highest bounds are scored exactly; the tenth best of these scores
is a threshold. An item is finished if the lowest bound among them is below it, since all others are lower still. For the
rest, every document whose bound reaches the threshold is scored exactly. No other document can be among the ten best, so
the result is that of scoring all, at whatever number of documents that takes. Scores come from the terms in the texts, not
from hashes.

Indexing, counts and scores read texts where they lie; only ids, bounds and scores move, and the texts of the documents to
be scored where their join is not a broadcast one. Per task and item at most ``probe`` rows leave the first pass. Items are
searched in blocks of about ``block_terms`` different terms (an item's terms stay together); a block's terms, hashes and
weights are what the tasks are given and what the driver holds, and its document counts are all that it collects.

Terms are runs of digits, letters and characters beyond ASCII, A-Z in lower case. A null or empty text has none and is found
by no item; items without terms have no rows. Ids are whole numbers or null; null is an id of its own, last among equals.
Rows of one item id are one item, their terms together. Rows of one document id are documents of their own; where their
scores are equal too, their places are any. Extra columns are not looked at. Widths end at ``most_width``: a text of more keys
than it suits has a fuller signature, hence higher bounds, and the same result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import ODD, mixed, staged, table, terms

#: Counts from which a term has a further key: 1, 2, 3, 4, 6, 8, 12, 16 and so on.
LEVELS = np.array(sorted({1, *(2 << i for i in range(40)), *(3 << i for i in range(40))}), np.int64)
BITS = 10
HASHES = 4
MOST_WIDTH = 1 << 22
#: Bits of a block's slices; and the most documents in one.
BLOCK_BITS, BLOCK_ROWS = 1 << 22, 2048
PROBE = 64
BLOCK_TERMS = 1 << 16
TOP = 10
INDEX = "width int, docs array<long>, terms array<long>, slices binary"


def term_hashes(found: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(found, dtype=object), categorize=False) if found else np.zeros(0, np.uint64)


def places(hashes: np.ndarray, level: int, widths, n_hashes: int = HASHES) -> np.ndarray:
    """The bits of keys, a row for each of the hash functions."""
    keys = mixed(hashes + np.uint64(level * int(ODD) % 2**64))
    first, step = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32) | np.uint64(1)
    width = np.asarray(widths, np.uint64)
    return np.stack([(first + np.uint64(j) * step) % width for j in range(n_hashes)]).astype(np.int64)


def _widths(most_width: int) -> np.ndarray:
    """Widths of signatures: each about 1.4 times the one before."""
    steps = 2 * int(math.log2(most_width / 64))
    return np.unique([*(min(most_width, round(64 * 2 ** (i / 2))) for i in range(steps + 1)), most_width])


class _Blocks:
    """Signatures by width, until there are enough for a row."""

    def __init__(self) -> None:
        self.held: dict[int, list[tuple]] = {}

    def add(self, width: int, doc, n: int, bits: np.ndarray) -> bool:
        self.held.setdefault(width, []).append((doc, n, bits))
        return len(self.held[width]) >= max(8, min(BLOCK_ROWS, BLOCK_BITS // width))

    def row(self, width: int) -> pa.RecordBatch:
        held = self.held.pop(width)
        signatures = np.zeros((len(held), width), bool)
        at = np.repeat(np.arange(len(held)), [len(bits) for _, _, bits in held])
        signatures[at, np.concatenate([bits for _, _, bits in held])] = True
        slices = np.packbits(np.ascontiguousarray(signatures.T), axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())),
             pa.array([[n for _, n, _ in held]], pa.list_(pa.int64())), pa.array([slices.tobytes()], pa.binary())],
            ["width", "docs", "terms", "slices"])


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, most_width: int = MOST_WIDTH) -> DataFrame:
    """The index of all documents, written to the shared folder. Each task fills its own blocks: nothing is shuffled."""
    all_widths = _widths(most_width)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks()
        for batch in batches:
            ids = batch.column(0)
            for start in range(0, len(ids), 256):
                counted = [(ids[i].as_py(), Counter(terms(batch.column(1)[i].as_py()))) for i in range(start, min(start + 256, len(ids)))]
                counted = [(d, c) for d, c in counted if c]
                if not counted:
                    continue
                sizes = np.array([len(c) for _, c in counted])
                hashes = term_hashes([t for _, c in counted for t in c])
                counts = np.fromiter((n for _, c in counted for n in c.values()), np.int64, len(hashes))
                owner = np.repeat(np.arange(len(counted)), sizes)
                levels = [(level, np.flatnonzero(counts >= least)) for level, least in enumerate(LEVELS) if least <= counts.max()]
                keys = np.bincount(np.concatenate([owner[at] for _, at in levels]), minlength=len(counted))
                widths = all_widths[np.minimum(np.searchsorted(all_widths, keys * bits), len(all_widths) - 1)]
                found = np.concatenate([places(hashes[at], level, widths[owner[at]]).ravel() for level, at in levels])
                whose = np.concatenate([np.tile(owner[at], HASHES) for _, at in levels])
                order = np.argsort(whose, kind="stable")
                for (doc, c), width, own in zip(counted, widths, np.split(found[order].astype(np.int32), np.cumsum(keys * HASHES)[:-1])):
                    if blocks.add(int(width), doc, c.total(), own):
                        yield blocks.row(int(width))
        for width in list(blocks.held):
            yield blocks.row(width)

    return staged(_texts(docs, key, text).mapInArrow(build, INDEX), "signatures")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("t"))


@dataclass
class Items:
    """A block of items. Of each (item, term): places of both, and the repeats; then the terms' weights."""

    ids: list
    terms: list[bytes]
    item: np.ndarray
    term: np.ndarray
    repeats: np.ndarray
    weight: np.ndarray | None = None

    def of_items(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places of terms, weights with repeats) of each item; terms of weight 0 add nothing."""
        cuts = np.searchsorted(self.item, np.arange(1, len(self.ids)))
        total = self.weight[self.term] * self.repeats
        return [(t[w > 0], w[w > 0]) for t, w in zip(np.split(self.term, cuts), np.split(total, cuts))]


def item_blocks(items: DataFrame, key: str, text: str, block_terms: int) -> Iterator[Items]:
    """The items' terms, ordered by item, in blocks as they pass through the driver."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1)):
                c = Counter(terms(t.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d.as_py()] * len(c), pa.int64()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())],
                    ["item", "term", "n"])

    found = _texts(items, key, text).mapInArrow(split, "item long, term binary, n long")
    rows = found.groupBy("item", "term").agg(F.sum("n").alias("n")).orderBy("item", "term").toLocalIterator()
    ids, known, item, term, repeats = [], {}, [], [], []

    def block() -> Items:
        return Items(list(ids), list(known), np.array(item), np.array(term), np.array(repeats, np.int64))

    for row in rows:
        if not ids or ids[-1] != row.item:
            if len(known) >= block_terms:
                yield block()
                ids, known, item, term, repeats = [], {}, [], [], []
            ids.append(row.item)
        item.append(len(ids) - 1)
        term.append(known.setdefault(bytes(row.term), len(known)))
        repeats.append(row.n)
    if ids:
        yield block()


def weights(docs: DataFrame, items: Items, n_docs: int, key: str, text: str) -> np.ndarray:
    """The weight of each of the block's terms, from the number of documents that have it."""
    wanted = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(items.terms)})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        asked = set(wanted.value)
        for batch in batches:
            for t in batch.column(1):
                total[[wanted.value[x] for x in asked.intersection(terms(t.as_py()))]] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["term", "n"])

    df = np.zeros(len(items.terms), np.int64)
    for row in _texts(docs, key, text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[row.term] = row.n
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)


def length_part(n, n_docs: int, all_terms: int):
    """m of a document of n terms."""
    return 25 + 75 * n * n_docs // all_terms


def term_part(count, m):
    """What a term of that count adds for each unit of weight."""
    return 1_000_000_000 * count // (1000 * count + 8 * m)


def bounds(row: dict, hashes: np.ndarray, of_items: list, n_docs: int, all_terms: int) -> Iterator[tuple[int, np.ndarray]]:
    """(item, upper bounds of the scores of a block's documents) for each item that any of them may have a term of."""
    width, n = row["width"], np.array(row["terms"], np.int64)
    slices = np.frombuffer(row["slices"], np.uint8).reshape(width, -1)
    m, alive, present = length_part(n, n_docs, all_terms), np.arange(len(hashes)), None
    reached, added, before = [], [], np.zeros(len(n), np.int64)
    for level, least in enumerate(LEVELS):
        if least > n.max():
            break
        bits = places(hashes[alive], level, width)
        now = slices[bits[0]]
        for more in bits[1:]:
            now = now & slices[more]
        if present is not None:
            now = now & present
        some = now.any(axis=1)
        alive, present = alive[some], now[some]
        if not len(alive):
            break
        at = np.full(len(hashes), -1)
        at[alive] = np.arange(len(alive))
        reached.append((at, np.unpackbits(present, axis=1, count=len(n))))
        part = term_part(np.minimum(LEVELS[level + 1] - 1, n), m)
        added.append(part - before)
        before = part
    for item, (terms_, weights_) in enumerate(of_items):
        total = np.zeros(len(n), np.int64)
        for (at, bits), part in zip(reached, added):
            rows = at[terms_]
            if not (rows >= 0).any():
                break
            total += (weights_[rows >= 0] @ bits[rows[rows >= 0]].astype(np.int64)) * part
        if total.any():
            yield item, total


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One block at a time: a batch may hold hundreds."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _by_bound(found: DataFrame, given, n_docs: int, all_terms: int, probe: int) -> DataFrame:
    """``item, doc_id, bound``: each task's documents of the highest bounds, ``probe`` for each item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, of_items = given.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in _rows(batch):
                docs = np.array([np.iinfo(np.int64).max if d is None else d for d in row["docs"]], np.int64)
                null = np.array([d is None for d in row["docs"]])
                for item, bound in bounds(row, hashes, of_items, n_docs, all_terms):
                    own = np.flatnonzero(bound > 0)
                    entry = (bound[own], docs[own], null[own])
                    if item in best:
                        entry = tuple(np.concatenate(x) for x in zip(best[item], entry))
                    if len(entry[0]) > probe:
                        keep = np.argpartition(-entry[0], probe - 1)[:probe]
                        entry = tuple(x[keep] for x in entry)
                    best[item] = entry
        for item, (bound, docs, null) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(bound), item)), pa.array(docs, mask=null), pa.array(bound)], ["item", "doc_id", "bound"])

    every = found.mapInArrow(run, "item long, doc_id long, bound long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc()))
    return every.withColumn("place", place).where(F.col("place") <= probe).drop("place")


def _reaching(found: DataFrame, given, n_docs: int, all_terms: int) -> DataFrame:
    """``item, doc_id``: every document whose bound reaches its item's threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, of_items, thresholds = given.value
        for batch in batches:
            for row in _rows(batch):
                docs = pa.array(row["docs"], pa.int64())
                for item, bound in bounds(row, hashes, of_items, n_docs, all_terms):
                    own = np.flatnonzero(bound >= max(1, thresholds[item]))
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), item)), docs.take(pa.array(own))], ["item", "doc_id"])

    return found.mapInArrow(run, "item long, doc_id long")


def _scored(docs: DataFrame, candidates: DataFrame, given, n_docs: int, all_terms: int, key: str, text: str) -> DataFrame:
    """``item, doc_id, score`` of the candidates, from the documents' texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_items = given.value
        of_terms = [(dict(zip((known[k] for k in places_), weights_.tolist()))) for places_, weights_ in of_items]
        for batch in batches:
            found, ids, scores = [], [], []
            for doc, t, items in zip(batch.column(0), batch.column(1), batch.column(2)):
                counts, asked = Counter(terms(t.as_py())), sorted(set(items.as_py()))
                m = length_part(counts.total(), n_docs, all_terms)
                found += asked
                ids += [doc.as_py()] * len(asked)
                for own in map(of_terms.__getitem__, asked):
                    scores.append(sum(own[x] * term_part(counts[x], m) for x in own.keys() & counts.keys()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    wanted = staged(candidates.groupBy("doc_id").agg(F.collect_list("item").alias("items")).withColumnRenamed("doc_id", "_d"), "candidates")
    joined = _texts(docs, key, text).join(wanted, F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d")
    return joined.mapInArrow(run, "item long, doc_id long, score long").where("score > 0")


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, probe: int = PROBE, block_terms: int = BLOCK_TERMS,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    found: DataFrame | None = None,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item; ``found`` is the index, made if it isn't given."""
    spark = docs.sparkSession
    found = index(docs, key, text) if found is None else found
    n_docs, all_terms = found.agg(
        F.coalesce(F.sum(F.size("docs")), F.lit(0)), F.coalesce(F.sum(F.expr("aggregate(terms, 0L, (a, x) -> a + x)")), F.lit(0))).first()
    schema = "item_id long, rank int, doc_id long, score long"
    result = spark.createDataFrame([], schema)
    if not n_docs:
        return result
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for block in item_blocks(items, item_key, item_text, block_terms):
        block.weight = weights(docs, block, n_docs, key, text)
        of_items, hashes = block.of_items(), term_hashes(block.terms)
        send = spark.sparkContext.broadcast
        texts = send((block.terms, of_items))
        probed = staged(_by_bound(found, send((hashes, of_items)), n_docs, all_terms, probe), "probed")
        scores = staged(_scored(docs, probed, texts, n_docs, all_terms, key, text), "scores")
        place = F.row_number().over(Window.partitionBy("item").orderBy(*order))
        best = scores.withColumn("rank", place)
        # Open: the lowest of a full set of bounds reaches the last of the best scores, so others may too.
        lowest = {r.item: r.bound for r in probed.groupBy("item").agg(F.count("*").alias("n"), F.min("bound").alias("bound")).where(F.col("n") >= probe).collect()}
        last = {r.item: r.score for r in best.where(F.col("rank") == top).collect()}
        still = {i: last.get(i, 0) for i, bound in lowest.items() if bound >= last.get(i, 0)}
        if still:
            open_items = [pair if i in still else (pair[0][:0], pair[1][:0]) for i, pair in enumerate(of_items)]
            reaching = _reaching(found, send((hashes, open_items, still)), n_docs, all_terms)
            rest = _scored(docs, reaching, texts, n_docs, all_terms, key, text)
            done = scores.where(~F.col("item").isin(list(still)))
            best = done.unionByName(rest).withColumn("rank", place)
        ids = spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
        rows = best.where(F.col("rank") <= top).join(ids, "item").select("item_id", "rank", "doc_id", "score")
        result = result.unionByName(staged(rows, "ranked"))
    return result


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
