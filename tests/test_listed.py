"""Long user lists by their index, and scoring once for all requests."""

import random

import pytest
from pyspark.sql import functions as F

from sparkcomments import Options, run_urls
from sparkcomments.functions import normalize
from sparkcomments.operators import listed
from sparkcomments.plans import run as plan, scoring as batch


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def _brute(text, patterns):
    folded = normalize.folded(text or "")
    found = [(k, normalize.folded(p.strip())) for k, p in patterns if p and p.strip() and normalize.folded(p.strip()) in folded]
    return min(found) if found else None


@pytest.mark.parametrize("filter_bits", [21, 6])
def test_first_listed_pattern(spark, filter_bits):
    r = random.Random(5)
    letters = "aAbB éÉß😀.*(ςΣ\n'"
    texts = ["".join(r.choices(letters, k=r.randint(0, 60))) for _ in range(300)] + [None, "", "   ", "aaaa" * 500]
    patterns = [(k, "".join(r.choices(letters, k=r.randint(0, 12)))) for k in range(200)] + [(900, None), (901, " "), (902, "😀"), (-1, "aaaab")]
    r.shuffle(patterns)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    table = spark.createDataFrame(patterns, "position long, pattern string")
    got = {x.id: (x.position, x.pattern) for x in listed.first_listed(rows, "id", "text", table, filter_bits=filter_bits).collect()}
    assert got == {i: b for i, t in enumerate(texts) if (b := _brute(t, patterns))}
    assert listed.first_listed(rows, "id", "text", table.where("false")).collect() == []
    assert listed.first_listed(rows.where("false"), "id", "text", table).collect() == []


def test_hundred_thousand_patterns(spark, no_broadcast):
    """A long list gives what the short list of its patterns that occur gives; it is not broadcast."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9)))
    patterns = [(k, f"{word()} {word()}") for k in range(100_000)]
    r.shuffle(patterns)
    texts = [f"{word()} {word()} {word()}" for _ in range(300)] + [f"{word()} {r.choice(patterns)[1].upper()}s {r.choice(patterns)[1]}" for _ in range(300)]
    texts += [texts[-1]] * 400  # one text in many rows
    rows = spark.createDataFrame([(i, t, "a", 0) for i, t in enumerate(texts)], "id long, text string, author_name string, like_count long")
    table = spark.createDataFrame(patterns, "position long, pattern string")
    found = listed.first_listed(rows, "id", "text", table)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    occur = [p for p in patterns if any(p[1] in t.lower() for t in set(texts))]
    assert 300 <= len(occur) < 1000
    expected = {i: _brute(t, occur) for i, t in enumerate(texts)}
    assert {x.id: (x.position, x.pattern) for x in found.collect()} == {i: b for i, b in expected.items() if b}
    names = ("is_spam", "spam_score", "reason", "signals", "primary_category", "normalized_text")
    long_list = batch.analyze_listed(rows, "id", blacklist=table, columns=names)
    short_list = batch.analyze_comments(rows, blacklist=[p for _, p in sorted(occur)], columns=names)
    assert long_list.columns == short_list.columns
    by_id = lambda df: sorted(map(tuple, df.select("id", *names).collect()), key=lambda x: x[0])
    assert by_id(long_list) == by_id(short_list)


def _comments(spark):
    texts = ["hi", "Enter your seed phrase", "what is bitcoin?", "click the link below", "python", "Buy bitcoin and ethereum now"]
    return spark.createDataFrame(
        [("abcdefghijk", i, "Joe", f"UC{i % 2}", t, "2024-01-05T00:00:00Z", i, 0) for i, t in enumerate(texts)] + [("other567890", 0, "Joe", "UC0", "hi", "", 0, 0)],
        "video_id string, arrival_pos long, author_name string, author_channel_id string, text string, published_at string, like_count long, reply_count long")


def _videos(spark):
    return spark.createDataFrame([("abcdefghijk", "T", "", 1, 1, 1, "UC1", "u")],
                                 "video_id string, title string, published_at string, view_count long, like_count long, comment_count long, channel_id string, url string")


def test_a_comment_is_scored_once(spark):
    """One video asked three times with different settings: its comments are scored once, and each request gets its own verdicts."""
    urls = spark.createDataFrame([(k, "youtu.be/abcdefghijk") for k in range(3)], "request_pos long, url string")
    requests = plan.requests_for(urls, Options(filter_spam=True)).withColumns({
        "threshold": F.when(F.col("request_pos") == 0, 0.05).when(F.col("request_pos") == 1, 0.5).otherwise(7.0),
        "min_likes": F.when(F.col("request_pos") == 2, F.lit(4)).otherwise(F.lit(1)).cast("long")})
    requested, _ = plan.requested_videos(requests, _videos(spark), None)
    asked = plan.asked_for(requested)
    scored = plan.score_requested(asked, _comments(spark))
    assert sorted(r.arrival_pos for r in scored.collect()) == [1, 2, 3, 4, 5]  # each once; 0 has too few likes for all
    assert plan.deal_to_requests(scored, asked).count() == 5 + 5 + 2
    text = scored._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join LeftSemi") == 1 and text.index("Generate inline") < text.index("Join LeftSemi")
    result = plan.run(requests, _videos(spark), _comments(spark))
    flagged = {(r.request_pos, r.arrival_pos) for r in result.spam.collect()}
    assert flagged == {(0, 1), (0, 2), (0, 3), (0, 5), (1, 1), (1, 5)}  # a threshold above 1 counts as 1
    assert {(r.request_pos, r.arrival_pos, r.is_creator) for r in result.comments.collect()} == {
        (0, 4, False), (1, 2, False), (1, 3, True), (1, 4, False), (2, 4, False), (2, 5, True)}


def test_latest_row_of_a_video(spark):
    videos = _videos(spark).withColumn("landed", F.lit(2)).unionByName(_videos(spark).withColumns({"title": F.lit("Z"), "landed": F.lit(1)}))
    urls = spark.createDataFrame([(0, "youtu.be/abcdefghijk")], "request_pos long, url string")
    assert [r.title for r in run_urls(urls, videos, _comments(spark)).metadata.collect()] == ["T"]


def test_rules_of_weight_zero_are_signals(spark):
    from sparkcomments.functions import rules, scoring

    nothing = rules.Signal("U1", "U1", "own", "Own rule", 0.0, rules.NORM, r"\bzebra\b")
    df = spark.createDataFrame([("a zebra",), ("x",), ("a zebra, enter your seed phrase",)], "text string")
    got = scoring.analyze(df, F.col("text"), signals=(*rules.SIGNALS, nothing), columns=("reason", "spam_score"), working=("n_signals",)).collect()
    assert [(r.n_signals, r.reason) for r in got] == [
        (1, "Own rule"), (0, "No spam signals detected"), (2, "Seed phrase / wallet scam pattern; Own rule")]


@pytest.mark.parametrize("first, filter_bits", [(0, None), (9, 6), (1 << 16, None)])
def test_first_listed_by_tasks_and_by_join(spark, first, filter_bits):
    """The first of the list in the tasks, the others by join; patterns of many lengths that begin alike, texts in more than one slice."""
    r = random.Random(8)
    pick = lambda n: "".join(r.choices("aбÉ😀 Σ", [9, 2, 1, 1, 1, 1], k=n))
    texts = [pick(r.randint(0, 80)) for _ in range(400)] + ["x" * 300_000 + pick(40), "ab" * 5000 + "c", None, ""]
    patterns = [(k, pick(r.randint(4, 20))) for k in range(300)] + [(300 + k, "a" * k + "É") for k in range(1, 40)] + [(-5, "x" * 5000 + "aa"), (700, "bc")]
    r.shuffle(patterns)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    table = spark.createDataFrame(patterns, "position long, pattern string")
    got = {x.id: (x.position, x.pattern) for x in listed.first_listed(rows, "id", "text", table, filter_bits=filter_bits, first=first).collect()}
    assert got == {i: b for i, t in enumerate(texts) if (b := _brute(t, patterns))}


def test_patterns_that_begin_alike_do_not_meet(spark, monkeypatch):
    """What a text gives out are the patterns it contains, not its places times the patterns that begin as they do."""
    kept = {}
    monkeypatch.setattr(listed, "staged", lambda df, name, stage=listed.staged: kept.setdefault(name, stage(df, name)))
    table = spark.createDataFrame([(k, f"all alike {k:04d}") for k in range(2000)], "position long, pattern string")
    texts = [" ".join(f"all alike {(7 * i + 131 * k) % 4000:04d}" for k in range(20)) for i in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    contained = [[k for k in {(7 * i + 131 * j) % 4000 for j in range(20)} if k < 2000] for i in range(200)]
    for first, most in ((1 << 16, 200), (0, 1.2 * sum(map(len, contained)))):
        kept.clear()
        got = {x.id: x.position for x in listed.first_listed(rows, "id", "text", table, first=first).collect()}
        assert got == {i: min(c) for i, c in enumerate(contained) if c}
        assert kept["pieces"].count() <= most


def test_equal_hashes_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(listed, "_mixed", lambda x: x & np.uint64(3))
    r = random.Random(9)
    word = lambda n: bytes(r.choices(b"abc", k=n))
    patterns = list(dict.fromkeys(word(r.randint(2, 6)) for _ in range(60)))
    texts = [word(r.randint(1, 12)) for _ in range(300)]
    spelled = listed.Spelled(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    found = listed.Head(patterns, 0).first(spelled, np.arange(len(spelled.data)))
    assert found == {i: min(k for k, p in enumerate(patterns) if p in t) for i, t in enumerate(texts) if any(p in t for p in patterns)}
