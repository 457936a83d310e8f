"""Quality rules: risk-controlled thresholds.

Every rule rejects texts on one side of a cutoff of one measure. Labelled texts are dealt to two holdouts by a hash of
their key, and cutoffs are selected apart for each stratum:

1. The first holdout puts the steps (a rule and one of its cutoffs) in order: first the one that rejects the greatest
   share of bad texts for its share of good ones. Steps that reject no larger share of bad texts than of good are left out.
2. The second holdout tests the steps in that order, each together with all before it: whether the exact
   (Clopper-Pearson) upper bound on the share of good texts that these steps reject jointly is at most the risk.

Testing ends at the first step that fails (a fixed sequence, which spends no further share of delta; the order does not
depend on the texts that test it), and delta is divided by the number of strata (Bonferroni). So with probability
1 - delta, in no stratum do all rules together reject more than the risk of its good texts. With nothing good rejected a
stratum needs log(delta / strata) / log(1 - risk) good texts to have any cutoff.

Everything is SQL functions over single rows, but for the counts of labelled rows by step, which are summed before they
are shuffled. Measures are computed once and staged without the texts.

Null texts have no words. Texts with fewer than twenty words, or with over 30 % repeated ones, fail without a cutoff. A
null stratum is a stratum. A document with several labels is good if all of them say so; repeated rows are judged each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import remainder, staged, table

#: White space as in the contract: a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Rules: a measure and its cutoffs from strict to lenient; a text is rejected at or above the cutoff (measures are
#: oriented so that bad is high).
CUTOFFS = {
    "symbols": [0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15],
    "repeats": [0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25],
    "duplicate_lines": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5],
    "capitals": [0.2, 0.35, 0.5, 0.7, 0.9],
    "long_words": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
    "short_words": [0.2, 0.22, 0.25, 0.3, 0.35, 0.5],
    "sameness": [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE), "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def window_hashes(tokens: Column) -> Column:
    """A hash of each window of eight words, from hashes of the words."""
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(F.slice(h, i + 1, WINDOW)))

    return F.when(F.size(tokens) > WINDOW, _let(F.transform(tokens, lambda w: F.xxhash64(w)), windows)).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column) -> Column:
    """Words in windows that stand twice or more in the text: windows in order of their hash, then position; those beside
    an equal hash count, and each covers eight words up to the next one's start. Texts without such a window, most of
    them, are told by the number of different hashes."""
    def starts(a: Column) -> Column:
        same = F.filter(a, lambda x, i: (F.get(a, i - 1).h == x.h) | (F.get(a, i + 1).h == x.h))
        return F.sort_array(F.transform(same, lambda x: x.i))

    def covered(a: Column) -> Column:
        return total(F.transform(a, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(a, i + 1) - x, F.lit(WINDOW))).cast("long")))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(ordered, lambda a: _let(starts(a), covered))).otherwise(F.lit(0).cast("long"))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the contract's counts and the measures of the rules; the text goes."""
    out = df.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("__w", words(F.col("__t")))
    out = out.withColumn("__h", window_hashes(F.col("__w")))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")),
        "__lines": F.size(lines),
        "n_repeat_words": repeated_words(F.col("__h")),
        "__distinct": F.size(F.array_distinct("__w")),
        "__upper": F.length("__t") - F.length(F.translate("__t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
    })
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return out.select(
        *[c for c in df.columns if c != text], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbols"), (F.col("n_repeat_words") / n).alias("repeats"),
        (F.col("n_dup_lines") / F.greatest("__lines", F.lit(1))).alias("duplicate_lines"), (F.col("__upper") / chars).alias("capitals"),
        (F.col("word_chars") / n).alias("long_words"), (n / chars).alias("short_words"),
        (1 - F.col("__distinct") / n).alias("sameness"))


def safe_cutoff(x: Column, n: Column, tests: Column, risk: float, delta: float) -> Column:
    """Whether the exact upper bound on a share of which x in n were seen is at most risk, with a chance of error of
    delta / tests: P(Bin(n, risk) <= x) is no greater. The sum runs over logarithms, term by term, and only where the
    share seen is below the risk."""
    start = n * F.lit(math.log1p(-risk))
    odds = math.log(risk) - math.log1p(-risk)

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + F.lit(odds)
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    below = x < n * risk
    terms = F.when(below & (x > 0), F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(terms, F.struct(start.alias("term"), start.alias("sum")), step)["sum"]
    return below & (tail <= F.log(F.lit(delta) / tests))


STEPS = [(rule, c) for rule, values in CUTOFFS.items() for c in values]


def labelled(measured: DataFrame, labels: DataFrame, key: str, stratum: str, label: str) -> DataFrame:
    """The labelled rows that pass the base rules: s, the stratum, good, first (of which holdout) and the measures."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(label).alias("__good"))
    return (measured.where("NOT base_failed").join(known, F.col(key) == F.col("__k"))
            .select(F.col(stratum).alias("s"), (F.col("__good") == 1).alias("good"), (remainder(F.col(key), 2) == 0).alias("first"), *CUTOFFS))


def order(rows: DataFrame) -> DataFrame:
    """A row for each stratum: steps, those that tell bad texts from good in the first holdout, best first."""
    at = [(F.col(r) >= c) for r, c in STEPS]
    counts = rows.where("first").groupBy("s").agg(
        F.count_if("good").alias("n1"), F.count_if(~F.col("good")).alias("n0"),
        F.array(*[F.struct(F.count_if(F.col("good") & x).alias("x1"), F.count_if(~F.col("good") & x).alias("x0")) for x in at]).alias("x"))
    steps = F.transform(F.col("x"), lambda x, i: F.struct(
        (-(x.x0 / F.col("n0")) / ((x.x1 + 1) / (F.col("n1") + 1))).alias("worth"), i.alias("i")))
    kept = F.array_sort(F.filter(steps, lambda x: x.worth < -1))
    known = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff")) for r, c in STEPS])
    return counts.where("n0 > 0").select("s", F.transform(kept, lambda x: F.get(known, x.i)).alias("steps"))


def cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", label: str = "quality", *,
            risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """A row for each stratum: a map from rule to its cutoff, for the rules that apply there."""
    rows = labelled(measured, labels, key, stratum, label)
    steps = order(rows).withColumnRenamed("s", "__s")
    value = F.create_map(*[x for r in CUTOFFS for x in (F.lit(r), F.col(r))])
    hit = F.transform(F.col("steps"), lambda t: F.col("value")[t.rule] >= t.cutoff)
    tried = (rows.where("good AND NOT first").join(steps, F.col("s").eqNullSafe(F.col("__s"))).select("s", "steps", value.alias("value"))
             .select("s", "steps", F.array_position(hit, True).alias("at"))
             .groupBy("s").agg(F.first("steps").alias("steps"), F.count("*").alias("n"),
                               F.array(*[F.count_if((F.col("at") > 0) & (F.col("at") <= k + 1)) for k in range(len(STEPS))]).alias("x")))
    tests = tried.withColumn("strata", F.count("*").over(_everything())).select("s", "steps", "n", "strata", F.posexplode("x").alias("k", "x"))
    # the rejected only grow with the steps, so the steps before the first failure are all that are safe
    safe = tests.where((F.col("k") < F.size("steps")) & safe_cutoff(F.col("x"), F.col("n"), F.col("strata"), risk, delta))
    return (safe.select("s", F.get("steps", F.col("k")).alias("t")).groupBy("s", F.col("t.rule").alias("rule")).agg(F.min("t.cutoff").alias("cutoff"))
            .groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")))  # seven entries at most


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over one row for each stratum


def judge(measured: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with rejected_by, the rules that reject the row. The cutoffs are a row for each stratum."""
    over = F.array_compact(F.array(*[F.when(F.col(r) >= F.col("cutoffs")[r], F.lit(r)) for r in CUTOFFS]))
    return (measured.join(chosen.withColumnRenamed("s", "__s"), F.col(stratum).eqNullSafe(F.col("__s")), "left")
            .withColumn("rejected_by", F.coalesce(over, F.array().cast("array<string>"))).drop("__s", "cutoffs"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = staged(measures(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "measures")
    chosen = cutoffs(measured, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judge(measured, chosen).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
