"""Lexical search, URL rules and resampling: small rows of every kind, and brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcomments.llm import importance, lexical_search as search, url_filter
from sparkcomments.llm.common import terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def documents(n=400, seed=1):
    """Common and rare words, exact copies, a very long text, null, empty, repeated ids."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "x1"]
    texts = [" ".join(r.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=r.randint(1, 60))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, "W1, w2; w3!" + " w40" * 3) for i in range(60)]  # copies
    rows += [(2000, None), (2001, ""), (2002, "... --"), (None, "w5 w50 w5"), (None, "w7 w51"), (2003, "w9 " * 3000 + " ".join(f"v{i}" for i in range(3000))),
             (2004, "w55 w56"), (2004, "w55 w57"), (2004, "w55 w57")]
    return rows


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(256))) + "Éa_b 日本 x\x00y~z"
    assert [t.decode() for t in terms(text.encode())] == words(text) and terms(None) == terms(b"") == []


def brute_search(rows, items, top):
    held = [(d, collections.Counter(words(t))) for d, t in rows]
    held = [(d, c) for d, c in held if c]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, query in items.items():
        found = []
        for d, c in held:
            m = 25 + 75 * c.total() * n_docs // length
            found.append((-sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                               for t, r in query.items()), d is None, d))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1) if s]
    return sorted(out, key=repr)


@pytest.mark.parametrize("probe, block_terms", [(64, 1 << 16), (3, 4), (10, 1)])
def test_search_is_exact(spark, probe, block_terms):
    rows = documents()
    asked = [(1, "w1 w40 W40"), (2, "Ünï 日本 w30"), (3, None), (4, "nothing here"), (5, "w1"), (6, "w9 v17 v2999"), (None, "w50 w51"),
             (7, "w55"), (7, "w57"), (8, " ".join(f"w{i}" for i in range(60)))]
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, item long, score string").repartition(5)
    items = spark.createDataFrame([(i, t, 0) for i, t in asked], "item_id long, text string, doc_id long")
    got = sorted((tuple(r) for r in search.search(docs, items, probe=probe, block_terms=block_terms).collect()), key=repr)
    queries = collections.defaultdict(collections.Counter)
    for i, t in asked:
        queries[i].update(words(t))
    expected = brute_search(rows, queries, 10)
    # Rows of one id and score may change places; their ranks and scores are the same.
    assert got == expected and {g[0] for g in got} == {1, 2, 5, 6, None, 7, 8}


def test_bounds_are_never_below_scores(spark):
    rows = documents(seed=2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = search.index(docs, bits=2, most_width=64).collect()  # full signatures: high bounds
    n_docs, length = sum(len(r.docs) for r in found), sum(sum(r.terms) for r in found)
    asked = [b"w1", b"w40", b"w30", b"v17"]
    weights, held = np.array([5, 900, 700, 3]), collections.Counter()
    exact = {}
    for d, t in rows:
        c = collections.Counter(words(t))
        if c:
            m = search.length_part(c.total(), n_docs, length)
            exact.setdefault((d, c.total()), []).append(sum(int(w) * search.term_part(c[x.decode()], m) for x, w in zip(asked, weights) if c[x.decode()]))
    for r in found:
        by = dict(search.bounds(r.asDict(), search.term_hashes(asked), [(np.arange(4), weights)], n_docs, length))
        for d, n, bound in zip(r.docs, r.terms, by.get(0, np.zeros(len(r.docs)))):
            held[bound >= max(exact[d, n])] += 1
    assert held == {True: n_docs} and n_docs == sum(bool(words(t)) for _, t in rows)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs, items).collect() == []
    assert search.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.where("false")).collect() == []
    assert search.search(spark.createDataFrame([(1, "..."), (2, None)], "doc_id long, text string"), items).collect() == []


URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://example.net/en", "http://example.net", "http://net/x", "http://net?x=/en/",
    "https://b.example.com/de/x?y#z", "https://badexample.com/de/x", "http://x.org/fr/", "http://x.org/fr", "http://xorg/fr/", "ftp://a.b.c.org/fr//x",
    None, "", "no scheme", "://", "http:///de/", "http://Éa.NET/é", "http://a.net/http://b.org/fr/", "http://a..net/", "http://user@h.net:80/en/",
    "http://" + "a." * 3000 + "net/" + "x/" * 3000, "http://x.org/fr/\nmore", "http://x.net#/a", "http://x.example.com/dead/", "http://x.example.com/de", "http://q.example.com",
]
MORE = (("example.com", "/de", "allow"), ("example.com", "", "block"), ("b.example.com", "/", "block"), ("EXAMPLE.com", "/dead", "block"),
        ("x.org", "/fr/", "block"), ("x.org", "/fr/", "allow"), ("c.org", "/fr//", "allow"), (None, "/", "block"), ("", "", "block"))


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path, host = re.match(r"[^?#]*", rest[len(host):])[0], host.translate(LOWER)
    fits = [(len(h) + len(p or ""), len(h), v, h.translate(LOWER) + (p or "")) for h, p, v in rules
            if h is not None and (host == h.translate(LOWER) or host.endswith("." + h.translate(LOWER)) and h) and path.startswith(p or "")]
    return (host, path, *((max(fits)[3], max(fits)[2]) if fits else (None, "allow")))


@pytest.mark.parametrize("rules, prefix", [(url_filter.RULES, 8), (url_filter.RULES + MORE, 8), (url_filter.RULES + MORE, 1), (MORE[:0], 8)])
def test_urls(spark, rules, prefix, monkeypatch):
    monkeypatch.setattr(url_filter, "PREFIX", prefix)  # one digit: most prefixes meet, the digests tell them apart
    rows = list(enumerate(URLS * 2))
    pages = spark.createDataFrame([(i, u, "h", "v", 1) for i, u in rows], "page_id long, url string, host string, verdict string, _path int")
    out = url_filter.judged(pages, url_filter.rules_of(spark, rules))
    assert out.columns == ["page_id", "url", "_path", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in rows}
    assert url_filter.judged(pages.where("false"), url_filter.rules_of(spark, rules)).count() == 0


def test_rule_verdicts_are_checked(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    with pytest.raises(Exception, match="allow or block"):
        url_filter.judged(pages, url_filter.rules_of(spark, (("net", "/", "perhaps"),))).collect()


def test_crcs_by_columns():
    r = random.Random(3)
    features = [b"", b"a", "é日".encode(), b"x" * 5000, b"y" * 4096, *(bytes(r.choices(range(256), k=r.randint(1, 40))) for _ in range(3000))]
    assert importance.feature_crcs(np.array(features, dtype=object)).tolist() == [zlib.crc32(x) for x in features]
    assert [f.decode() for f in importance.runs([b"a", b"b", b"c"], 3)] == ["a", "b", "c", "a b", "b c", "a b c"]


@pytest.mark.parametrize("longest, stretch", [(1, 1 << 22), (2, 50)])
def test_resampling(spark, longest, stretch, monkeypatch):
    monkeypatch.setattr(importance, "STRETCH", stretch)
    rows = documents(seed=4)
    target = [(1, "w1 W2 Ünï"), (2, None), (3, "w40 w41 w42")]
    docs = spark.createDataFrame([(d, t, 7, 8) for d, t in rows], "doc_id long, text string, weight long, place long").repartition(3)
    items = spark.createDataFrame(target, "item_id long, text string")

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 500 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = (collections.Counter(itertools.chain(*(features(x) for _, x in side))) for side in (rows, target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 500) / ((s[b] + 1) * (t.total() + 500)))) for b in s}
    expected = []
    for d, text in rows:
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features(text))
        expected.append((d, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(words(text)) >= 9))
    eligible = sorted((x for x in expected if x[4]), key=lambda x: (-x[3], x[0] is None, x[0]))
    drawn = eligible[:len(eligible) * 25 // 100]
    out = importance.resample(docs, items, percent=25, seed=7, least_words=9, buckets=500, longest=longest).collect()
    assert sorted((tuple(r)[:4] for r in out), key=repr) == sorted((x[:4] for x in expected), key=repr)
    assert [tuple(r)[:4] for r in sorted((r for r in out if r.rank), key=lambda r: r.rank)] == [x[:4] for x in drawn]
    assert sorted(r.rank for r in out if r.rank) == list(range(1, len(drawn) + 1))


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    got = {r.doc_id: r for r in importance.resample(some, none).collect()}
    assert got[2].weight == got[2].n_features == 0 and got[1].n_features == 2 and got[1].rank is None
    assert importance.resample(some, none).columns == ["doc_id", "n_features", "weight", "score", "rank"]
