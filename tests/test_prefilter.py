"""The derived conditions are necessary: no text that the JVM's matcher finds is passed over."""

import dataclasses
import random
import string
from re import _constants as K, _parser

import pytest
from pyspark.sql import functions as F

from sparkcomments.functions import prefilter as P, rules, scoring


def _sample(nodes, r) -> str:
    """A random text that the pattern matches, but for boundaries."""
    out = []
    for op, value in nodes:
        if op is K.LITERAL:
            out.append(chr(value))
        elif op is K.ANY:
            out.append(r.choice("ab .x"))
        elif op is K.IN:
            if value[0][0] is K.NEGATE:
                out.append(r.choice("abz09/"))
                continue
            kind, x = r.choice(value)
            out.append({K.LITERAL: lambda: chr(x), K.RANGE: lambda: chr(r.randint(*x)), K.CATEGORY: lambda: r.choice("0123456789" if x is K.CATEGORY_DIGIT else " \t")}[kind]())
        elif op is K.SUBPATTERN:
            out.append(_sample(value[-1], r))
        elif op is K.BRANCH:
            out.append(_sample(r.choice(value[1]), r))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            least, most, inner = value
            out += [_sample(inner, r) for _ in range(r.randint(least, min(int(most), least + 2)))]
        else:
            assert op is K.AT, op
    return "".join(out)


OWN = (
    r"\bzeb(ra|u)s?\b", r"(ab|cd)+x?", r"[xy]{2}z", r"\d\d:\d\d", r"^\s*deal\b|\bsteal$", r"a?b?c?", r"(?:win|won)\s+\$\d+|free\.ly", r"\b(go|no)[td]\b", r"\w+ing\b",
    r"\b[\w.]+!{2,}",
)


def _texts(pattern, r, n):
    tree = _parser.parse(pattern)
    for _ in range(n):
        text = _sample(tree, r)
        if r.random() < 0.3 and text:  # near misses
            k = r.randrange(len(text))
            text = text[:k] + r.choice(["", r.choice(string.ascii_lowercase), " "]) + text[k + 1:]
        text = r.choice(["", "so ", "x", "and/or "]) + text + r.choice(["", " ok", "y", "!", " a/b"])
        yield r.choice([text, text, text.upper(), text.title(), text + " " + text])


@pytest.mark.parametrize("part", [0, 1])
def test_no_match_is_passed_over(spark, part):
    r = random.Random(part)
    own = [rules.Signal(f"U{i}", f"U{i}", "own", f"Own {i}", 0.1, rules.NORM, p) for i, p in enumerate(OWN)]
    signals = (rules.SIGNALS, tuple(own))[part]
    legitimacy = (rules.LEGITIMACY, ())[part]
    texts = [t for rule in (*signals, *legitimacy) for t in _texts(rule.pattern, r, 150)] + ["", "plain words only", "12 34"]
    df = spark.createDataFrame([(i, t, texts[-1 - i]) for i, t in enumerate(texts)], "id long, text string, author string")
    ids = [x.id for x in (*signals, *legitimacy)]

    def hits(change=lambda rule: rule):
        scored = scoring.analyze(df, F.col("text"), F.col("author"), signals=tuple(map(change, signals)),
                                 legitimacy=tuple(map(change, legitimacy)), columns=(), working=ids)
        return sorted(map(tuple, scored.select("id", *ids).collect()))

    with_conditions = hits()
    without = hits(lambda rule: dataclasses.replace(rule, starts=(), hints=(), probe=""))
    differing = [(texts[a[0]], ids[k]) for a, b in zip(with_conditions, without) for k in range(len(ids)) if a[k + 1] != b[k + 1]]
    assert differing == []
    found = [sum(row[k + 1] for row in without) for k in range(len(ids))]
    assert min(found) > 0 and sum(found) > 40 * len(ids)  # every rule is met, most often


def test_conditions():
    assert P.prefilter(rules.CRYPTO).starts[:3] == ("fx", "10x", "btc") and P.prefilter(rules.CRYPTO).hints == ()
    assert P.prefilter(rules.PHONE, False) == P.Prefilter((), (), r"\+\d|\d{3}")
    assert P.prefilter(rules.EMAIL).starts == ("(", "@", "[")
    assert P.prefilter(rules.FINANCIAL).starts == () and "guaranteed" in P.prefilter(rules.FINANCIAL).hints
    assert P.prefilter("a?b?c?") == P.Prefilter() == P.prefilter(rules.BADGE)
    assert all(P.prefilter(r.pattern) != P.Prefilter() for r in (*rules.SIGNALS, *rules.LEGITIMACY) if r.id != "S09")
