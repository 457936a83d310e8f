"""Language ID: n-gram filters that answer with a bitmask of languages.

Training counts, over all labelled rows, the letter 3-grams and 4-grams of each language. An n-gram belongs to a
language if it makes up at least least_share of that language's n-grams, and at least 1/spread of its share in the
language where it is commonest. The n-grams go into a bit-sliced Bloom filter: a table whose rows have a bit for each
language (a 64-bit word for every 64 of them), so that a single probe answers for all languages at once. A text gets, for each language,
the number of its n-grams that the filter holds, less the false positives that the filter's fill leads to expect;
the greatest decides, the first in order of name at a tie.

Size bound: at most 1 / least_share n-grams for a language, whatever the corpus holds; the filter has a fixed number of
rows, with 2 MB by default for every 64 languages. Training reads whole texts and all labelled rows.

Null texts and texts without a letter are 'und' with score 0. A text whose n-grams no language holds gets the language
with the most training n-grams, score 0. Without a labelled row, all texts are 'und'. Texts are read in pieces of
a million characters to bound memory; pieces overlap, so that every n-gram is counted once. Repeated rows are counted
and judged each. Columns beside text and language are not looked at.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from .common import mixed, remainder, staged, table

UNKNOWN = "und"
PIECE = 1 << 20


@dataclass
class Filters:
    """words: the table, a row for each place and a column for every 64 languages; fill: for each language the share of
    rows with its bit set."""

    languages: list[str]
    words: np.ndarray
    fill: np.ndarray
    hashes: int
    commonest: int

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """A row for each n-gram: bit L % 64 of column L // 64 for each language L that holds it."""
        out, x = np.full((len(grams), self.words.shape[1]), np.uint64(2**64 - 1)), grams
        for _ in range(self.hashes):
            out &= self.words[(x >> np.uint64(11)) & np.uint64(len(self.words) - 1)]
            x = mixed(x + np.uint64(1))
        return out


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def _pieces(texts):
    """(numbers of the texts, code points, which of them are a piece's own) for runs of texts of some MB at most. Each
    piece has a neighbour before and two behind, spaces at the ends of a text, so that its own n-grams lie inside it."""
    parts, size = [], 0
    for k, text in enumerate(texts):
        low = text.lower() if text else ""
        for a in range(0, len(low), PIECE):
            own = min(PIECE, len(low) - a)
            around = (low[a - 1] if a else " ") + low[a:a + own + 2].ljust(own + 2)
            x = np.frombuffer(around.encode("utf-32-le", "surrogatepass"), np.uint32)
            inside = np.zeros(len(x), bool)
            inside[1:own + 1] = True
            parts.append((np.full(len(x), k, np.int32), np.where(_letters()[x], x, 32).astype(np.uint32), inside))
            size += len(x)
            if size >= PIECE:
                yield tuple(map(np.concatenate, zip(*parts)))
                parts, size = [], 0
    if parts:
        yield tuple(map(np.concatenate, zip(*parts)))


def grams(texts):
    """(numbers of the texts, n-gram hashes). N-grams lie within a word and the spaces around it."""
    for owner, x, inside in _pieces(texts):
        letter = x != 32
        wide = x.astype(np.uint64)
        two = wide[:-1] + wide[1:] * np.uint64(1_000_003)
        in3 = letter[1:-1] & inside[1:-1]
        three = two[:-1][in3] * np.uint64(3) + (wide[2:] * np.uint64(10**12 + 39))[in3]
        in4 = letter[1:-2] & letter[2:-1] & inside[1:-2]
        four = two[:-2][in4] + (two[2:] * np.uint64(10**15 + 37))[in4]
        yield np.concatenate([owner[1:-1][in3], owner[1:-2][in4]]), mixed(np.concatenate([three, four]))


def train(df: DataFrame, text: str = "text", lang: str = "lang", *, least_share: float = 2e-5, spread: float = 8,
          words: int = 1 << 18, hashes: int = 3) -> Filters:
    """Filters from the rows of df with a text and a language."""

    def count(batches):
        for batch in batches:
            names = np.array(batch.column("l").to_pylist(), dtype=object)
            texts = batch.column("t").to_pylist()
            kinds, of = np.unique(names.astype(str), return_inverse=True)
            for owner, gram in grams(texts):
                key = of[owner]
                for k, kind in enumerate(kinds):
                    found, n = np.unique(gram[key == k], return_counts=True)
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([kind] * len(found)), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["l", "g", "n"])

    counts = (df.select(F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"))
              .where("l IS NOT NULL AND t IS NOT NULL")
              .mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")))
    counts = staged(counts, "grams")
    sizes = counts.groupBy("l").agg(F.sum("n").alias("total"))
    totals = {r.l: r.total for r in sizes.collect()}  # a row for each language
    languages = sorted(totals)
    table_ = np.zeros((words, max(1, -(-len(languages) // 64))), np.uint64)
    if not languages:
        return Filters([], table_, np.zeros(0), hashes, 0)
    kept = counts.join(sizes, "l").where(F.col("n") >= least_share * F.col("total")).toPandas()  # 1 / least_share rows for each language at most
    share = kept.n / kept.total
    kept = kept[share >= share.groupby(kept.g).transform("max") / spread]
    of = kept.l.map({k: i for i, k in enumerate(languages)}).to_numpy(np.int64)
    bits = np.uint64(1) << (of % 64).astype(np.uint64)
    x = kept.g.to_numpy(np.int64).view(np.uint64)
    for _ in range(hashes):
        np.bitwise_or.at(table_, ((x >> np.uint64(11)) & np.uint64(words - 1), of // 64), bits)
        x = mixed(x + np.uint64(1))
    fill = np.array([np.count_nonzero(table_[:, i // 64] & (np.uint64(1) << np.uint64(i % 64))) / words for i in range(len(languages))])
    return Filters(languages, table_, fill, hashes, max(range(len(languages)), key=lambda i: totals[languages[i]]))


def score(filters: Filters, texts) -> pd.DataFrame:
    """lang and score of each text; known: the share of its n-grams that the winner holds."""
    n = len(texts)
    count = np.zeros(n)
    hits = np.zeros((n, max(1, len(filters.languages))))
    for owner, gram in grams(texts):
        masks = filters.masks(gram)
        count += np.bincount(owner, minlength=n)
        for i in range(len(filters.languages)):
            hits[:, i] += np.bincount(owner, (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), n)
    chance = filters.fill ** filters.hashes if filters.languages else np.zeros(1)
    true = np.maximum(0, (hits - count[:, None] * chance) / (1 - np.minimum(chance, 0.999)))
    best = true.argmax(axis=1)
    best[true.max(axis=1) == 0] = filters.commonest
    top = true[np.arange(n), best]
    known = np.divide(top, count, out=np.zeros(n), where=count > 0)
    rest = (true.sum(axis=1) - top) / max(1, len(filters.languages) - 1)
    score_ = np.clip(np.divide(top - rest, count, out=np.zeros(n), where=count > 0), 0, 1)
    names = np.array([*filters.languages, UNKNOWN], dtype=object)
    empty = (count == 0) | (not filters.languages)
    return pd.DataFrame({"lang_pred": np.where(empty, UNKNOWN, names[best]), "score": np.where(empty, 0.0, score_), "known": np.where(empty, 0.0, np.clip(known, 0, 1))})


def identify(spark: SparkSession, filters: Filters, text: Column) -> Column:
    """A struct of lang_pred, score and known for a column of texts."""
    shared = spark.sparkContext.broadcast(filters)

    @pandas_udf("lang_pred string, score double, known double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return score(shared.value, texts.tolist())

    return run(text.cast("string"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    filters = train(docs.where("NOT held_out"))
    found = docs.select("doc_id", "held_out", identify(spark, filters, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.known")


#: Texts that no language knows go: less than this share of their n-grams is in the winner's filter.
LEAST_KNOWN = 0.1


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose text has a language. Trained on the rows of docs themselves."""
    filters = train(docs.where(remainder(F.col("doc_id"), 4) != 2))
    name = "__found"
    return (docs.withColumn(name, identify(spark, filters, F.col("text")))
            .where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.known") >= LEAST_KNOWN)).drop(name))
