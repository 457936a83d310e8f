"""Whether the methods named do the work, and hold beyond the bounds that earlier forms had."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcomments.llm import decontaminate, html_text, language_id, near, pii, toxicity

WORDS = "stone water bridge river valley night market paper house winter garden letter road field morning harbour".split()


def plain_grams(text):
    """The 3-grams and 4-grams around letters, each by itself."""
    s = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + "  "
    three = [s[i - 1:i + 2] for i in range(1, len(s) - 2) if s[i] != " "]
    return three + [s[i - 1:i + 3] for i in range(1, len(s) - 2) if s[i] != " " and s[i + 1] != " "]


def counted(texts):
    out = collections.Counter()
    for owner, gram in language_id.grams(texts):
        out.update(zip(owner.tolist(), gram.tolist()))
    return out


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 20])
def test_grams_across_pieces(monkeypatch, piece):
    texts = [None, "", "...", "a", "Über den Fluß, it's", "İstanbul ΟΔΟΣ 日本語 x", "one two  three" * 3]
    whole = counted(texts)
    monkeypatch.setattr(language_id, "PIECE", piece)
    assert counted(texts) == whole
    assert [sum(n for (k, _), n in whole.items() if k == i) for i in range(len(texts))] == [len(plain_grams(t)) for t in texts]
    assert len({g for _, g in whole}) == len({g for t in texts for g in plain_grams(t)})


def test_more_than_64_languages(spark):
    rnd = random.Random(3)
    own = {f"l{k:02d}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(70)}
    rows = [(lang, " ".join(rnd.choices(words, k=30))) for lang, words in own.items() for _ in range(3)]
    filters = language_id.train(spark.createDataFrame(rows, "lang string, text string"), words=1 << 14)
    assert len(filters.languages) == 70 and filters.words.shape == (1 << 14, 2)
    fresh = [" ".join(rnd.choices(words, k=30)) for words in own.values()]
    assert language_id.score(filters, fresh).lang_pred.tolist() == list(own)
    # the share of n-grams that a filter holds, with plain sets: no language loses an n-gram, few gain one
    known = {lang: {g for l, t in rows if l == lang for g in plain_grams(t)} for lang in own}
    held = filters.masks(np.concatenate([g for _, g in language_id.grams([rows[0][1]])]))
    assert (held[:, 0] & np.uint64(1)).all() and known["l00"] >= set(plain_grams(rows[0][1]))


def in_a_row(machines, symbols):
    for m in machines:
        state, out = m.start, []
        for x in symbols:
            state, y = m.step(state, x)
            out.append(y)
        symbols = out
    return symbols


def test_grammar_is_the_machines_in_a_row():
    machines = [toxicity.REPORTED, toxicity.NEGATED, toxicity.THREAT, toxicity.TARGET]
    alphabet = ["OTHER", "INSULT", "HINT", "THREAT", "TARGET", "NEGATION", "REPORT"]
    rnd = random.Random(5)
    cases = [*itertools.product(alphabet, repeat=4), *(rnd.choices(alphabet, k=rnd.randint(5, 30)) for _ in range(500))]
    for case in cases:
        state, out = toxicity.START, []
        for x in case:
            state, y = toxicity.GRAMMAR[state][x]
            out.append(y)
        assert out == in_a_row(machines, list(case))


def sentence(rnd, low, high):
    return " ".join(rnd.choices(WORDS, k=rnd.randint(low, high)))


def linked(rnd, low, high):
    return f"<a href='/x'>{sentence(rnd, low, high)}</a>"


def neutral_page(rnd):
    """A page whose elements say nothing, and its main text."""
    tag = rnd.choice(["div", "p", "td"])
    block = lambda x: f"<{tag}>{x}</{tag}>"
    body, truth = [], []
    for x in [sentence(rnd, 1, 6), *(s for _ in range(rnd.randint(2, 6)) for s in ([sentence(rnd, 14, 80)] + [sentence(rnd, 1, 3)] * (rnd.random() < 0.3))),
              sentence(rnd, 14, 80)]:
        if len(x.split()) > 14 and rnd.random() < 0.3:
            head, tail = x.split()[:10], x.split()[10:]
            body.append(block(f"{' '.join(head)} <a>{' '.join(tail[:3])}</a> {' '.join(tail[3:])}"))
        else:
            body.append(block(x))
        truth.append(x)
    before = [block(" | ".join(linked(rnd, 1, 3) for _ in range(rnd.randint(2, 5)))) for _ in range(rnd.randint(1, 2))]
    after = [block(linked(rnd, 1, 20)) for _ in range(rnd.randint(1, 4))]
    page = "".join(before + body + after)
    return (f"<table><tr>{page}</tr></table>" if tag == "td" else f"<body>{page}</body>"), " ".join(truth)


def test_tree_asks_for_links_and_neighbours(spark):
    tree = html_text.train(spark)
    asked = {html_text.FEATURES[f] for f in tree.feature if f >= 0}
    assert "link_density" in asked and asked & {"words_before", "density_before", "words_after", "density_after"}
    rnd = random.Random(11)
    cases = [neutral_page(rnd) for _ in range(300)]
    got = html_text.main_text(tree, [page for page, _ in cases])
    right = sum(a == b for a, b in zip(got, (truth for _, truth in cases)))
    assert right >= 0.95 * len(cases), right
    # without links and neighbours the same tree cannot tell menus from text
    rows = np.concatenate([html_text.features(html_text.blocks(p)) for p, _ in cases])
    blind = rows.copy()
    blind[:, 1:6] = 0
    assert (tree.predict(rows) != tree.predict(blind)).mean() > 0.1


def test_tree_is_read_as_spark_predicts(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(2)
    rows = rng.random((400, 4)).round(2)
    labels = ((rows[:, 0] > 0.4) ^ (rows[:, 2] < 0.3) | (rows[:, 3] > 0.9)).astype(float)
    data = spark.createDataFrame([(Vectors.dense(r), float(y)) for r, y in zip(rows.tolist(), labels)], ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=6, seed=1).fit(data.coalesce(1))
    want = [r.prediction == 1.0 for r in model.transform(data).select("prediction").collect()]
    assert html_text.read_tree(model.toDebugString).predict(rows).tolist() == want
    assert html_text.read_tree("one leaf\n  Predict: 1.0\n").predict(rows).all()


def test_html_empty_table_and_odd_rows(spark):
    tree = html_text.train(spark)
    frame = spark.createDataFrame([(None, None, 1), (1, "<p>" + "x" * 200_000, 2), (1, "plain text without a tag", 2)], "page_id long, html string, words long")
    out = html_text.extract(frame, tree)
    assert out.columns == ["page_id", "words", "text"] and out.count() == 3
    assert html_text.extract(frame.where("false"), tree).count() == 0


def test_unseen_identifiers_are_discovered(spark):
    """Identifiers that no base pattern matches, planted under contexts that lead to each other in three rounds, or whose
    words before say nothing; numbers in other contexts are left alone."""
    rnd = random.Random(17)
    seed = [f"+1 (275) 555-{k:04d}" for k in range(40)]
    first, second, third = ([f"0{k}.{a}55.{k:04d}" for k in range(n)] for a, n in ((1, 20), (2, 6), (3, 3)))
    texts, planted = [], set()

    def add(before, value, after, kind=None):
        text = f"{sentence(rnd, 3, 9)} {before} {value} {after} {sentence(rnd, 3, 9)}"
        if kind:
            planted.add((len(texts), f"{kind}:{len(text.split(value)[0])}:{len(text.split(value)[0]) + len(value)}"))
        texts.append(text)

    long_word = "w" * 100
    for v in seed + first:
        add("my phone", v, "until noon", "phone" if v in first else None)
    for v in first + second:
        add(long_word + "a", v, "or fax", "phone")
    for v in second + third:
        add("dial now", v, "and ask", "phone")
    for k in range(40):
        add(f"{sentence(rnd, 1, 1)}{rnd.random():.9f}".translate(str.maketrans("0123456789.", "abcdefghijk")), f"person{k}@mail.com", "is their mailbox")
    for k in range(5):
        add(f"by{chr(97 + k)}", f"person{k}@intranet", "is their mailbox", "email")
    for k in range(60):
        add("order number", f"0{k}.77.{k:06d}", "was sent", None)
        add(long_word + "b", f"{k:08d}", "pieces", None)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, None), (999, "")], "doc_id long, text string")
    out = pii.find(frame).select("d", pii.written(F.filter("spans", lambda s: ~s.base)).alias("learned")).collect()
    found = {(r.d, x) for r in out for x in r.learned.split(",") if x}
    assert found == planted and len(out) == len(texts) + 2


def plain_overlaps(texts, items):
    """For each document and item the best alignment that passes, by trying all of them."""
    out = {}
    for (d, text), (i, item) in itertools.product(texts, items):
        w, x = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (text, item))
        for shift in range(-len(x) + 1, len(w)) if len(x) >= 9 else ():
            eq = [w[shift + k] == x[k] for k in range(max(0, -shift), min(len(x), len(w) - shift))]
            if len(x) < 13:
                ok = sum(eq) >= len(x) - 1
            else:
                ok = any(sum(eq[k:k + 13]) >= 11 for k in range(len(eq) - 12))
            if ok and (sum(eq), -shift) > out.get((d, i), ((-1, 0),))[0]:
                out[d, i] = (sum(eq), -shift), (max(shift, 0), sum(eq), sum(eq) / len(x))
    return {k: v for k, (_, v) in out.items()}


@pytest.mark.parametrize("most_broadcast", [1_000_000, 0])
def test_overlaps_equal_brute_force(spark, most_broadcast):
    rnd = random.Random(23)
    many = [f"w{k}" for k in range(300)]
    items = [(k, rnd.choices(many, k=rnd.choice([8, 9, 11, 12, 13, 14, 20, 45]))) for k in range(40)] + [(90, ["a", "b"] * 10), (91, [])]
    docs = [(1000, None), (1001, ""), (1002, "a b " * 30), (1003, "a b a " * 20)]
    for k in range(160):
        item = list(rnd.choice(items[:40])[1])
        for _ in range(rnd.randint(0, 3)):
            item[rnd.randrange(len(item))] = "changed"
        a = rnd.choice([0, 0, 0, rnd.randrange(4)])
        docs.append((k, " ".join(rnd.choices(many, k=rnd.randint(1, 40)) + item[a:] + rnd.choices(many, k=rnd.randint(1, 40)))))
    items = [(k, " ".join(x).title()) for k, x in items]
    got = decontaminate.overlaps(spark.createDataFrame(docs + docs[:3], "doc_id long, text string").withColumn("extra", F.lit(1)),
                                 spark.createDataFrame(items + items[:2], "item_id long, text string"), most_broadcast=most_broadcast).collect()
    want = plain_overlaps(docs, items)
    assert len(want) > 60 and {(r.doc_id, r.item_id): (r.start, r.matched, r.share) for r in got} == want and len(got) == len(want)


def test_classes_and_links_equal_brute_force(spark):
    """All pairs of texts, compared by their sets of five words."""
    rnd = random.Random(29)
    many = [f"w{k}" for k in range(2000)]
    texts = []
    for size in (5, 6, 9, 14, 25, 60, 150):
        for _ in range(12):
            base = rnd.choices(many, k=size)
            for _ in range(rnd.randint(1, 6)):
                copy = list(base)
                for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                    at = rnd.choice([0, len(copy) - 1, rnd.randrange(len(copy))])
                    copy[at] = rnd.choice(many)
                texts.append(" ".join(copy))
    rnd.shuffle(texts)
    rows = list(enumerate(texts)) + [(5000, None), (5001, ""), (5002, "two words")]
    sets = {k: frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for k, t in rows for w in [(t or "").split()]}
    kinds = {s for s in sets.values() if s}
    linked_to = {s: [t for t in kinds if t != s and 5 * len(s & t) >= 4 * len(s | t)] for s in kinds}
    root, members = {}, collections.defaultdict(list)
    for k, s in sets.items():
        members[s].append(k)
    for s in sorted(kinds, key=lambda s: min(members[s])):
        todo = [s] if s not in root else []
        while todo:
            t = todo.pop()
            if t not in root:
                root[t] = min(members[s])
                todo += linked_to[t]
    out = {r.doc_id: (r.class_id, r.n_links, r.n_copies)
           for r in near.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {k: (root[s], len(linked_to[s]), len(members[s])) if s else (k, 0, 1) for k, s in sets.items()}
    assert sum(n > 0 for _, n, _ in want.values()) > 60
    assert {k: v for k, v in out.items() if v != want[k]} == {}
