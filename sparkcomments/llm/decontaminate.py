"""Benchmark decontamination: spaced-seed hashing.

Texts become words in lower case without punctuation. A mask names which of eight neighbouring words count; the others
may differ. Seeds of the benchmark, at every word, are joined with seeds of the documents, at every second word. The
masks are such that any 13 words with up to two of them replaced share a seed, wherever they stand. Each hit names an
alignment of an item with a document; alignments are verified once, word by word: an overlap is a window of 13 aligned
words of which at least 11 agree (items of 9 to 12 words: the whole item, with one word replaced at most).

Everything is DataFrame functions. The benchmark's seeds are broadcast only if their number, counted first, is at most
most_broadcast; else both sides are joined by a shuffle. Texts are not moved with the seeds: hits are grouped by
document, item and stretch of 64 alignments, so that no row grows with the hits of a document, and meet the documents in
one join.

Null and empty texts, and items of fewer than nine words, overlap with nothing. Repeated documents or items give the
rows of one; rows without a doc_id or item_id take part under a null id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: Offsets that count. Found by search: with STEP they meet every window of 13 words with two replaced.
MASKS = ((0, 1, 4, 6, 7), (0, 3, 4, 5, 6), (0, 3, 5, 6, 7))
SPAN, STEP = 8, 2
WINDOW, EQUAL, LEAST = 13, 11, 9
#: Alignments of an item with a document are verified in rows of 2 ** STRETCH neighbouring ones at most.
STRETCH = 6


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{M}\p{N}]+"), "")


def seeds(df: DataFrame, tokens: str, step: int) -> DataFrame:
    """A row for each place and mask: df without the words, p, the place, and h, a hash of the mask and the words it
    counts. Two generators in a row stay in one generated loop; the words are not copied for each place."""
    w, p = F.col(tokens), F.col("p")
    places = F.when(F.size(w) >= SPAN, F.sequence(F.lit(0), F.size(w) - SPAN, F.lit(step)))
    found = F.array(*[F.xxhash64(F.lit(m), *[w[p + o] for o in mask]) for m, mask in enumerate(MASKS)])
    keep = [c for c in df.columns if c != tokens]
    return df.select(*df.columns, F.explode(places).alias("p")).select(*keep, "p", F.explode(found).alias("h"))


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
             item_text: str = "text", most_broadcast: int = 1_000_000) -> DataFrame:
    """A row for each document and item that overlap: the key, the item, start (place of the alignment among the
    document's words), matched (equal words in the alignment) and share (of the item's words)."""
    d = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("k"), words(F.col(text)).alias("w"))
    b = (items.select(F.col(item).alias("item"), words(F.col(item_text)).alias("iw")).where(F.size("iw") >= LEAST)
         .dropDuplicates().withColumn("b", F.xxhash64("item", "iw")))
    marks = seeds(b.select("b", F.size("iw").alias("n"), "iw"), "iw", 1).withColumnRenamed("p", "ip")
    if marks.limit(most_broadcast + 1).count() <= most_broadcast:
        marks = F.broadcast(marks)
    spots = seeds(d, "w", STEP)
    hits = (spots.join(marks, "h").groupBy("d", "k", "b", "n", (F.col("p") - F.col("ip")).alias("shift")).agg(F.lit(1).alias("one"))
            .groupBy("d", "k", "b", F.shiftright("shift", STRETCH).alias("stretch")).agg(F.collect_list(F.struct("b", "n", "shift")).alias("hits")))
    same = docs.select(F.col(key).alias("d2"), F.xxhash64(text).alias("k2"), F.col(text).alias("t"))
    met = (same.join(hits, F.col("d2").eqNullSafe(F.col("d")) & (F.col("k2") == F.col("k")))
           .select("d", "k", "hits", words(F.col("t")).alias("w"))
           .select("d", "k", F.explode(F.transform("hits", lambda h: F.struct(
               h.b.alias("b"), h.shift.alias("shift"),
               F.slice("w", F.greatest(h.shift, F.lit(0)) + 1, h.n + F.least(h.shift, F.lit(0))).alias("part")))).alias("x"))
           .select("d", "k", "x.*"))
    skip = F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(F.size("part"), F.size("iw") - skip)
    equal = F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), lambda i: (F.get("part", i) == F.get("iw", i + skip)).cast("int")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("eq") - WINDOW + 1), lambda i: total(F.slice("eq", i, WINDOW))))
    verdict = F.when(F.size("iw") < WINDOW, F.col("matched") >= F.size("iw") - 1).otherwise((F.size("eq") >= WINDOW) & (best >= EQUAL))
    return (met.join(b, "b").withColumn("eq", equal).where("eq IS NOT NULL").withColumn("matched", total(F.col("eq"))).where(verdict)
            .groupBy("d", "item").agg(F.max_by(F.struct(F.greatest("shift", F.lit(0)).alias("start"), "matched", (F.col("matched") / F.size("iw")).alias("share")),
                                               F.struct("matched", -F.col("shift"))).alias("m"))
            .select(F.col("d").alias(key), F.col("item").alias(item), "m.start", "m.matched", "m.share"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that overlap with no item of the benchmark."""
    bad = overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti")
