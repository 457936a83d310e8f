"""PII: fixed patterns, extended by bootstrapped contextual extraction.

Base. E-mail addresses, IP addresses, card numbers and phone numbers by pattern; matches that fail their test are
dropped. The patterns are written so that Java matches what the contract's expressions match, in time linear in the
text and without deep recursion.

Bootstrap. Base finds, and tokens outside of them with a digit or an at sign, are instances; the one or two words before
them, and the one or two after them, are lexical patterns. The base finds are the seeds: instances of their kind with
score 1. In each round, a pattern's confidence for a kind is the score of its instances over their number (plus one). An
instance's score is the chance that its best pattern before or its best one after is right. Patterns need seeds of three
different values. Instances whose score passes least_score are identifiers of that kind, wherever they occur under such
a pattern, and seeds of the next round. The rounds end when one finds no new instance; as none is given up again, they
do end. Counts of the pattern-instance graph are over distinct values, summed before they are shuffled, so that a
frequent value or a common pattern counts once and lies in no task alone.

Everything is DataFrame functions. Texts are read once: base matches and instances with their contexts are staged, and
all later steps work on these short rows. Offsets are code points, ends exclusive.

Null and empty texts hold nothing. Repeated rows each have their spans. A null doc_id is kept. Where two kinds tie for an
instance, the first of KINDS has it. Other columns than key and text are not looked at.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import staged, table

KINDS = ("email", "ip", "card", "phone")
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The contract's patterns. A match begins where a run begins or the last match ended; runs are taken whole.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@(?={LABEL}++\.{LABEL})(?:[A-Za-z0-9.-](?<!\.(?!{LABEL})))++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9 -](?<![ -](?![0-9])))++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{14}", "phone": r"\+[0-9]"}
TOKEN = r"(?<!\S)\S*?[0-9@]\S*"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a run of digits passes the check digit test."""
    n = F.length(value)

    def place(i: Column) -> Column:
        d = F.substring(value, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), place), F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(digits(value)))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """Structs of v, a match, g and h, the text between the match before and it, and that between it and the next one."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.when(text.rlike(hint), F.arrays_zip(found.alias("v"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), F.slice(gaps, F.lit(2), F.size(found)).alias("h")))


def _words(gap: Column) -> Column:
    return F.array_remove(F.split(F.lower(gap), r"\s+"), "")


#: Context words of more characters are patterns by their hash, so that a pattern stays short.
LONG_WORD = 64


def _word(words: Column, at: Column) -> Column:
    """The word at a place, # where there is none."""
    w = F.get(words, at)
    return F.when(w.isNull(), "#").when(F.length(w) > LONG_WORD, F.hex(F.xxhash64(w))).otherwise(w)


CONTEXT = ("l1", "l2", "r1", "r2")


def _patterns() -> Column:
    """The lexical patterns of a token: words before it (1, 2) and after it (3, 4). No words are no pattern."""
    own = [("1", "l1", F.col("l1")), ("2", "l1", F.concat_ws(" ", "l2", "l1")), ("3", "r1", F.col("r1")), ("4", "r1", F.concat_ws(" ", "r1", "r2"))]
    return F.explode(F.array_compact(F.array(*[F.when(F.col(near) != "#", F.concat(F.lit(f"{n} "), words)) for n, near, words in own])))


def _read(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each text: its id, a row number r, its base matches and its tokens with their contexts."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,v:string>>")

    def found(n: int, kind: str) -> Column:
        return F.coalesce(F.transform(_matches(F.col("t"), PATTERNS[kind], HINTS[kind]), lambda m, i: F.struct(
            F.lit(n).alias("kind"), i.alias("i"), F.length(m.g).alias("gap"), m.v.alias("v"))), none)

    base = [found(n, kind) for n, kind in enumerate(KINDS)]

    def token(m: Column, i: Column) -> Column:
        left, right = _words(m.g), _words(m.h)
        context = [_word(left, F.size(left) - 1), _word(left, F.size(left) - 2), _word(right, F.lit(0)), _word(right, F.lit(1))]
        return F.struct(i.alias("i"), F.length(m.g).alias("gap"), m.v.alias("v"), *[w.alias(name) for w, name in zip(context, CONTEXT)])

    tokens = F.coalesce(F.transform(_matches(F.col("t"), TOKEN, "[0-9@]"), token),
                        F.array().cast(f"array<struct<i:int,gap:int,v:string,{','.join(f'{c}:string' for c in CONTEXT)}>>"))
    return staged(df.select(F.col(key).alias("d"), F.xxhash64(text).alias("k"), t.alias("t"))
                  .select("d", "k", F.monotonically_increasing_id().alias("r"), F.concat(*base).alias("base"), tokens.alias("tokens")), "pii")


def _placed(rows: DataFrame, *by: str) -> DataFrame:
    """rows with start and end, from the gaps and lengths of the matches of one text."""
    order = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum(F.col("gap") + F.length("v")).over(order).cast("long")).withColumn("start", F.col("end") - F.length("v"))


def _base_spans(read: DataFrame) -> DataFrame:
    rows = _placed(read.select("r", F.explode("base").alias("m")).select("r", "m.*"), "r", "kind")
    good = F.coalesce(*[F.when(F.col("kind") == n, passes(k, F.col("v"))) for n, k in enumerate(KINDS)])
    return rows.where(good).select("r", "kind", "start", "end")


def _instances(read: DataFrame, base: DataFrame) -> DataFrame:
    """Tokens that overlap no base span, and base spans, with their kind as seed: v is what their tokens hold, the words
    before are those of the first token, the words after those of the last. Tokens meet spans in order of place."""
    tokens = _placed(read.select("r", F.explode("tokens").alias("m")).select("r", "m.*"), "r")
    both = tokens.select("r", "start", "end", "v", *CONTEXT, F.lit(None).cast("int").alias("kind")).unionByName(
        base.select("r", "start", "end", *[F.lit(None).cast("string").alias(c) for c in ("v", *CONTEXT)], "kind"))
    order = Window.partitionBy("r").orderBy("start", F.col("kind").isNull())
    spans = F.when(F.col("kind").isNotNull(), F.struct("end", "start", "kind"))
    last = F.max(spans).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.first(spans, True).over(order.rowsBetween(1, Window.unboundedFollowing))
    met = F.when(F.col("a.end") > F.col("start"), F.col("a")).when(F.col("b.start") < F.col("end"), F.col("b"))
    met = both.withColumn("a", last).withColumn("b", following).where("v IS NOT NULL").withColumn("span", met).drop("a", "b", "kind")
    seeds = (met.where("span IS NOT NULL").groupBy("r", F.col("span.start").alias("at"), F.col("span.kind").alias("seed"))
             .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(F.struct("l1", "l2"), "start").alias("l"), F.max_by(F.struct("r1", "r2"), "start").alias("n"),
                  F.sort_array(F.collect_list(F.struct("start", "v"))).alias("vs"))  # the tokens of one span: 19 digits at most
             .select("r", "start", "end", F.array_join("vs.v", " ").alias("v"), "l.*", "n.*", "seed"))
    return met.where("span IS NULL").select("r", "start", "end", "v", *CONTEXT, F.lit(None).cast("int").alias("seed")).unionByName(seeds)


def _plausible(kind: Column, value: Column) -> Column:
    """What an identifier of a kind must have at least."""
    n = F.length(digits(value))
    return (F.when(kind == 0, value.contains("@")).when(kind == 1, n.between(4, 12) & value.rlike(r"[0-9][.:][0-9]"))
            .when(kind == 2, n.between(12, 19)).otherwise(n.between(7, 15)))


def find(df: DataFrame, key: str = "doc_id", text: str = "text", *, least_score: float = 0.75, least_seeds: int = 3) -> DataFrame:
    """A row for each row of df: d, its key, k, a hash of its text, and spans, an array of structs of kind (its place in
    KINDS), start, end and base (whether a base pattern found it), ordered by kind and start."""
    read = _read(df, key, text)
    base = _base_spans(read)
    free = staged(_instances(read, base)
                  .withColumn("lead", F.length(F.regexp_extract("v", r"^[^A-Za-z0-9+@]*", 0)))
                  .withColumn("core", F.regexp_replace("v", r"^[^A-Za-z0-9+@]+|[^A-Za-z0-9]+$", "")).where("core != ''"), "pii-tokens")
    # the graph: distinct pairs of pattern and value, with the kind of seeds
    edges = staged(free.select("core", "seed", _patterns().alias("p")).groupBy("p", F.col("core").alias("v")).agg(F.min("seed").alias("seed")), "pii-edges")
    totals = staged(edges.groupBy("p").agg(F.count("*").alias("n")), "pii-totals")
    scores = staged(edges.where("seed IS NOT NULL").groupBy("v").agg(F.min("seed").alias("kind")).withColumn("score", F.lit(1.0)), "pii-scores")
    for n in count():
        confident = (edges.join(scores, "v").groupBy("p", "kind").agg(F.sum("score").alias("good"), F.count("*").alias("seeds"))
                     .where(F.col("seeds") >= least_seeds).join(totals, "p").select("p", "kind", (F.col("good") / (F.col("n") + 1)).alias("sure")))
        confident = staged(confident.where("sure >= 0.5"), f"pii-patterns-{n}")
        before = F.substring("p", 1, 1).isin("1", "2")
        best = [F.coalesce(F.max(F.when(side, F.col("sure"))), F.lit(0.0)) for side in (before, ~before)]
        found = (edges.where("seed IS NULL").join(confident, "p").where(_plausible(F.col("kind"), F.col("v")))
                 .groupBy("v", "kind").agg((1 - (1 - best[0]) * (1 - best[1])).alias("score"))
                 .groupBy("v").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("x"))
                 .select("v", "x.*").where(F.col("score") >= least_score))
        found = staged(found.join(scores.select("v"), "v", "left_anti"), f"pii-found-{n}")
        if found.isEmpty():
            break
        scores = staged(scores.unionByName(found), f"pii-scores-{n}")
    known = scores.where("score < 1").select(F.col("v").alias("core"), F.col("kind").alias("found"))
    new = (free.where("seed IS NULL").join(known, "core")
           .select("r", _patterns().alias("p"), "start", "lead", "core", "found")
           .join(confident.select("p", F.col("kind").alias("found")), ["p", "found"], "left_semi")
           .select("r", F.col("found").alias("kind"), (F.col("start") + F.col("lead")).alias("start"), (F.col("start") + F.col("lead") + F.length("core")).alias("end")).distinct())
    spans = (base.withColumn("base", F.lit(True)).unionByName(new.withColumn("base", F.lit(False)))
             .groupBy("r").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("spans")))  # of one text
    return read.select("d", "k", "r").join(spans, "r", "left").select(
        "d", "k", F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")).alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.base)
    counts = [F.size(F.array_remove(F.transform(base, lambda s: F.when(s.kind == n, 1).otherwise(0)), 0)).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]  # noqa: B023
    return found.select(F.col("d").alias("doc_id"), *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def masked(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with each span of its texts replaced by its kind in brackets; spans that overlap become one, of the first kind."""
    found = find(df, key, text).where("size(spans) > 0").dropDuplicates(["d", "k"])
    rows = found.select("d", "k", F.explode("spans").alias("s")).select("d", "k", "s.*")
    order = Window.partitionBy("d", "k").orderBy("start", "end", "kind")
    rows = rows.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.sum((F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).cast("int")).over(order))
    joined = (rows.groupBy("d", "k", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
              .groupBy("d", "k").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("__s")).select(F.col("d").alias("__d"), F.col("k").alias("__k"), "__s"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("__s"), i - 1).end)
        return F.concat(F.substring(F.col(text), (begin + 1).cast("int"), (s.start - begin).cast("int")), F.get(names, s.kind))

    tail = F.substring(F.col(text), (F.element_at("__s", -1).end + 1).cast("int"), F.length(text))
    clean = F.concat(F.array_join(F.transform("__s", piece), ""), tail)
    return (df.join(joined, F.col(key).eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__k")), "left")
            .withColumn(text, F.when(F.col("__s").isNull(), F.col(text)).otherwise(clean)).drop("__s", "__d", "__k"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data masked; n_chars, where there is one, follows the text."""
    out = masked(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
