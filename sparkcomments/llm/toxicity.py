"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, hint of one, threat, target, negation, report). Four transducers rewrite the symbols of a clause:
reported speech marks what somebody is said to have said, negation marks what it reaches, target marks what is aimed at
someone, and threat asks for a target. Composed into one machine, they give every clause its strongest reading, and a
text the reading of its strongest clause with the number of clauses that have one. A text's score is the share of toxic
texts among labelled ones with that reading, smoothed towards a weight of the grammar.

The insults are learned: words, and stems that take any ending, that occur in toxic texts far more often than in others,
counted by the contexts (word before, word after) their words stand in, so that copies of one text count once. Fitting
reads at most fit_rows labelled texts of each label (those whose hashed id comes first), weighted to the shares of all
labels; the grammar holds every stem of theirs that passes the test. Scoring reads every whole text and needs no
label.

Null and empty texts have the reading 'none'. Without a labelled row, the fixed weights alone decide. An id with several
labels is toxic if one of them says so; repeated rows are scored each.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from .common import remainder, staged, table

#: Fixed words of the grammar, in the languages of the corpus.
THREATS = "kill hurt stab shoot beat strangle punch burn destroy töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = ("you your yours yourself u he him his she her they them their du dich dir dein deine ihr euch sie ihn tu te toi "
           "ton vous votre il elle ils tú ti usted ustedes él ella ellos").split()
NEGATIONS = "not no never nobody none isn't aren't wasn't don't cannot nicht kein keine nie pas jamais aucun no nunca ningún".split()
REPORTS = ("said says say wrote writes called calls told tells claimed claims quoted quotes heard alleged sagte sagt schrieb nannte "
           "dit écrit appelé dijo dice escribió llamó").split()
#: Readings from weak to strong, with the weight that the grammar gives each by itself.
READINGS = {"none": 0.05, "threat word": 0.15, "suspect": 0.2, "reported": 0.3, "negated": 0.3, "insult": 0.85, "threat": 0.85, "aimed insult": 0.95}
STRONGER = {r: k for k, r in enumerate(READINGS)}
#: Labelled texts that such a weight counts as.
PRIOR = 4.0
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[^.!?;:\n]+")


class Transducer:
    """States, and for a state and a symbol the next state and what is put out. What is not named stays as it is."""

    def __init__(self, arcs: dict[tuple[str, str], tuple[str, str]], start: str = "start", after: dict[str, str] | None = None):
        self.arcs, self.start, self.after = arcs, start, after or {}

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get((state, symbol), (self.after.get(state, state), symbol))


def composed(machines: list[Transducer], symbols: list[str]) -> dict[tuple, dict[str, tuple[tuple, str]]]:
    """The machine that passes symbols through all machines in turn, with the states that can be reached."""
    start = tuple(m.start for m in machines)
    table_: dict[tuple, dict[str, tuple[tuple, str]]] = {}
    todo = [start]
    while todo:
        state = todo.pop()
        if state in table_:
            continue
        table_[state] = {}
        for symbol in symbols:
            out, reached = symbol, []
            for m, s in zip(machines, state):
                s, out = m.step(s, out)
                reached.append(s)
            table_[state][symbol] = (tuple(reached), out)
            todo.append(tuple(reached))
    return table_


REPORTED = Transducer({
    ("start", "REPORT"): ("said", "OTHER"), ("said", "INSULT"): ("said", "reported"), ("said", "THREAT"): ("said", "reported")})
#: A negation reaches three words.
NEGATED = Transducer(
    {("start", "NEGATION"): ("three", "OTHER")} | {(s, "NEGATION"): ("three", "OTHER") for s in ("three", "two", "one")}
    | {(s, x): ("start", "negated") for s in ("three", "two", "one") for x in ("INSULT", "THREAT")},
    after={"three": "two", "two": "one", "one": "start"})
THREAT = Transducer({
    ("start", "TARGET"): ("aimed", "TARGET"), ("start", "THREAT"): ("open", "threat word"), ("aimed", "THREAT"): ("aimed", "threat"),
    ("open", "TARGET"): ("aimed", "threat"), ("open", "THREAT"): ("open", "threat word")})
TARGET = Transducer({
    ("start", "TARGET"): ("aimed", "OTHER"), ("start", "INSULT"): ("open", "insult"), ("aimed", "INSULT"): ("aimed", "aimed insult"),
    ("open", "TARGET"): ("aimed", "aimed insult"), ("open", "INSULT"): ("open", "insult"),
    ("start", "HINT"): ("start", "suspect"), ("aimed", "HINT"): ("aimed", "suspect"), ("open", "HINT"): ("open", "suspect")})
GRAMMAR = composed([REPORTED, NEGATED, THREAT, TARGET], ["OTHER", "INSULT", "HINT", "THREAT", "TARGET", "NEGATION", "REPORT"])
START = tuple(m.start for m in (REPORTED, NEGATED, THREAT, TARGET))


@dataclass
class Model:
    """insults: the learned stems, with a $ at the end where nothing may follow. weights: by reading and number of
    clauses (3: three or more). sure: the stems whose share of toxic contexts is close to one; others are hints."""

    insults: list[str]
    sure: set[str]
    weights: dict[tuple[str, int], float]

    @cached_property
    def stems(self) -> tuple[set[str], list[int]]:
        return set(self.insults), sorted({len(w) for w in self.insults})

    @cached_property
    def symbols(self) -> dict[str, str]:
        out = {w: "THREAT" for w in THREATS} | {w: "TARGET" for w in TARGETS} | {w: "NEGATION" for w in NEGATIONS} | {w: "REPORT" for w in REPORTS}
        return out

    def symbol(self, word: str) -> str:
        out = self.symbols.get(word)
        if out is None:
            stems, lengths = self.stems
            ended = word + "$"
            own = [ended[:k] for k in lengths if ended[:k] in stems]
            out = "INSULT" if not self.sure.isdisjoint(own) else "HINT" if own else "OTHER"
        return out

    @cached_property
    def search(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for w in [*(w.rstrip("$") for w in self.insults), *THREATS]:
            found.add_word(w, w)
        found.make_automaton()
        return found

    def clause(self, text: str) -> str:
        """The strongest reading of a clause in lower case."""
        state, best = START, "none"
        for word in WORD.findall(text):
            state, out = GRAMMAR[state][self.symbol(word)]
            if STRONGER.get(out, 0) > STRONGER[best]:
                best = out
        return best

    def read(self, text: str | None) -> tuple[str, int]:
        """The strongest reading of a text's clauses, and how many clauses have one."""
        low = (text or "").lower()
        hits = iter(self.search.iter(low)) if low else iter(())
        at = next(hits, None)
        best, n = "none", 0
        if at is not None:
            for m in CLAUSE.finditer(low):
                if m.end() <= at[0]:
                    continue
                reading = self.clause(m[0])
                if reading != "none":
                    n += 1
                    best = max(best, reading, key=STRONGER.__getitem__)
                while at is not None and at[0] < m.end():
                    at = next(hits, None)
                if at is None:
                    break
        return best, min(n, 3)

    def score(self, reading: str, n: int) -> float:
        return self.weights.get((reading, n), READINGS[reading])


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def stems(found: dict[str, int]) -> list[str]:
    """Of stems with the number of toxic contexts: each family once, by the longest stem that nearly all of it shares."""
    chosen: list[str] = []
    children: dict[str, list[str]] = {}
    for p in found:
        children.setdefault(p[:-1], []).append(p)
    for p in sorted(found, key=lambda p: (len(p), p)):
        under = [c for c in chosen if c.startswith(p)]
        if any(p.startswith(c) for c in chosen) or sum(found[c] for c in under) > 0.9 * found[p]:
            continue
        n, longer = found[p], p
        while longer and (more := [q for q in children.get(longer, []) if found[q] >= 0.95 * n]):
            longer = more[0]
        chosen.append(longer)
    return chosen


def _terms(batches):
    """For every text, its words with their contexts, each once."""
    for batch in batches:
        terms, contexts, labels = [], [], []
        for text, label in zip(batch.column("t").to_pylist(), batch.column("toxic").to_pylist()):
            words = [w for w in WORD.findall((text or "").lower())]
            seen = {(w, f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}") for k, w in enumerate(words) if len(w) > 2}
            for w, c in seen:
                terms.append(w)
                contexts.append(hash_text(c))
            labels += [label] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(contexts, pa.int64()), pa.array(labels, pa.int32())], ["w", "c", "toxic"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", *,
          fit_rows: int = 4_000, least_contexts: int = 5, least_share: float = 0.6, sure_share: float = 0.9) -> Model:
    known = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
             .groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("toxic")))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = known.where("toxic = 1").orderBy(F.xxhash64("k"), "k").limit(fit_rows).unionAll(
        known.where("toxic = 0").orderBy(F.xxhash64("k"), "k").limit(fit_rows))
    sample = staged(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
                    .join(F.broadcast(chosen), "k").select("t", "toxic"), "toxic-sample")  # 2 * fit_rows ids at most
    share = 1.96 ** 2
    n, p = F.col("n"), F.col("bad") / F.col("n")
    lower = (p + share / (2 * n) - 1.96 * F.sqrt(p * (1 - p) / n + share / (4 * n * n))) / (1 + share / n)
    terms = (sample.mapInArrow(_terms, "w string, c long, toxic int").groupBy("w", "c").agg(F.max("toxic").alias("toxic"))
             .groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
             .select(F.explode(F.transform(F.sequence(F.lit(3), F.least(F.lit(10), F.length("w") + 1)), lambda k: F.concat("w", F.lit("$")).substr(F.lit(1), k))).alias("w"), "n", "bad")
             .groupBy("w").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
             .withColumn("low", lower).where((F.col("bad") >= least_contexts) & (F.col("low") >= least_share)).orderBy(F.desc("bad"), "w").collect())  # of 2 * fit_rows texts
    fixed = {*THREATS, *TARGETS, *NEGATIONS, *REPORTS}
    rows = {r.w: r for r in terms if r.w.rstrip("$") not in fixed}
    sure = {w for w, r in rows.items() if r.low >= sure_share}
    strong = stems({w: rows[w].bad for w in sure})
    weak = [w for w in stems({w: r.bad for w, r in rows.items() if w not in sure}) if not any(w.startswith(c) or c.startswith(w) for c in strong)]
    model = Model(strong + weak, set(strong), {})
    counts = (sample.select("toxic", readings(docs.sparkSession, model, F.col("t")).alias("r"))
              .groupBy("toxic", "r.reading", "r.clauses").agg(F.count("*").alias("n")).collect())
    taken: dict[int, int] = {}
    for r in counts:
        taken[r.toxic] = taken.get(r.toxic, 0) + r.n
    seen: dict[tuple[str, int], list[float]] = {}
    for r in counts:
        pair = seen.setdefault((r.reading, r.clauses), [0.0, 0.0])
        pair[r.toxic == 1] += r.n * sizes[r.toxic] / taken[r.toxic]
    model.weights = {k: (bad + PRIOR * READINGS[k[0]]) / (good + bad + PRIOR) for k, (good, bad) in seen.items()}
    return model


def readings(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct of reading, clauses and score for a column of texts."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("reading string, clauses int, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        found = [m.read(t) for t in texts.tolist()]
        return pd.DataFrame({"reading": [r for r, _ in found], "clauses": [n for _, n in found],
                             "score": [min(1.0, max(0.0, m.score(r, n))) for r, n in found]})

    return run(text.cast("string"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), readings(spark, model, F.col("text")).alias("r"))
    return found.select("doc_id", "held_out", "r.score", F.when(F.col("r.score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
                        "r.reading", "r.clauses")
