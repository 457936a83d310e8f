import pytest
from pyspark.sql import functions as F

from sparkcomments import Options, run_urls
from sparkcomments.functions import inputs, urls
from sparkcomments.operators import aggregates, cap, filters, ordering
from sparkcomments.plans.scoring import preset_sweep


def test_video_ids(spark):
    cases = {
        "https://www.youtube.com/watch?v=abcdefghijk": "abcdefghijk", "youtube.com/watch?v=abcdefghijkLMN": "abcdefghijk",
        "http://youtube.com/v/abc_ef-hijk": "abc_ef-hijk", "youtube.com/embed/abcdefghijk?x=1": "abcdefghijk",
        "https://m.youtube.com/shorts/abcdefghijk": "abcdefghijk", "youtu.be/abcdefghijk": "abcdefghijk",
        "https://www.youtube.com/watch?list=x&v=abcdefghijk": None, "HTTPS://YOUTUBE.COM/watch?v=abcdefghijk": None,
        "youtu.be/short": None, "  youtu.be/abcdefghijk  ": "abcdefghijk", "": None, "x" * 60: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = df.select("url", urls.video_id(F.col("url")).alias("id"), urls.url_error(F.col("url")).alias("e")).collect()
    assert {r.url: r.id for r in got} == cases
    errors = {r.url: r.e for r in got}
    assert errors[""] == "URL cannot be empty" and errors["youtu.be/abcdefghijk"] is None
    assert errors["x" * 60] == "Invalid YouTube URL format: " + "x" * 50 + "..."
    assert urls.url_summary(df, "url").first()[:] == (7, 4, "✓ 7 valid, 4 invalid")
    assert urls.url_summary(df.where("url like '%watch?v=abcdefghijk'"), "url").first()[2] == "✓ 1 valid, 1 invalid"
    assert urls.url_summary(df.where("url = 'youtu.be/abcdefghijk'"), "url").first()[2] == "✓ 1 valid URL"
    assert urls.url_summary(df.where("url = ''"), "url").first()[:] == (0, 0, "")


def test_requests(spark):
    rows = [
        (0, "youtu.be/abcdefghijk", "", "", "", "", ""), (1, "youtu.be/abcdefghijk", "5", "500", "python, tutorial ,,x", "2024-01-31", ""),
        (2, "youtu.be/abcdefghijk", "-3", "0", " , ", "2024-02-30", "2024/01/01"), (3, "x", "abc", "abc", "C++", "2024-02-01", "2024-01-01"),
        (4, "youtu.be/abcdefghijk", "1_0", "12.5", "", "2024-02-01", "2024-01-01"),
    ]
    df = spark.createDataFrame(rows, "request_pos int, url string, min_likes string, max_comments string, words string, date_from string, date_to string")
    got = {r.request_pos: r for r in inputs.validate_requests(df).collect()}
    assert [got[i].min_likes for i in range(5)] == [0, 5, 0, 0, 10]
    assert [got[i].max_comments for i in range(5)] == [None, 500, None, None, None]
    assert got[1].words == ["python", "tutorial", "x"] and got[2].words == [] and got[3].words == ["C++"]
    assert got[2].warnings == ["Min likes cannot be negative, using 0", "Max comments must be positive, using unlimited"]
    assert (got[2].date_from, got[2].date_to, got[2].error) == (None, None, None)
    assert got[3].error == "Invalid YouTube URL format: x" and got[4].error == "From date cannot be after To date"
    dates = df.select(inputs.date_error(F.col("date_from")).alias("a"), inputs.date_error(F.col("date_to")).alias("b")).collect()
    assert dates[2][:] == ("Invalid date: '2024-02-30'", "Invalid date format: '2024/01/01'. Use YYYY-MM-DD")


def test_fetch_failures(spark):
    rows = [(403, "commentsDisabled"), (403, "quotaExceeded"), (403, "x"), (404, None), (500, "y" * 300), (500, "403")]
    kind, message = inputs.fetch_failure(F.col("status"), F.col("body"))
    got = spark.createDataFrame(rows, "status int, body string").select(
        kind.alias("k"), message.alias("m"), inputs.shown_failure(message).alias("s")).collect()
    assert [r.k for r in got] == ["comments_disabled", "forbidden", "forbidden", "not_found", "api_error", "api_error"]
    assert got[4].m == "YouTube API error (500): " + "y" * 200
    assert got[1].s == got[5].s == "Comments are disabled for this video"


def test_filters(spark):
    df = spark.createDataFrame([
        ("Python!", "2024-01-05T10:00:00Z"), ("pythonic", ""), ("xa.b", ""), ("a.b", ""), ("axb", ""), ("c++x", ""), ("c++ rocks", "")],
        "text string, published_at string")

    def texts(condition):
        return [r.text for r in df.where(condition).collect()]

    assert texts(filters.has_word(["python"])) == ["Python!"]
    assert texts(filters.has_word(["A.B"])) == ["a.b"]
    assert texts(filters.has_word(["c++"])) == ["c++x"]
    assert len(texts(filters.has_word([]))) == 7
    assert texts(filters.in_date_range("2024-01-05", "2024-01-05")) == ["Python!"]
    assert texts(filters.in_date_range("2024-01-06")) == []
    assert len(texts(filters.in_date_range(None, "2024-01-05"))) == 7
    assert len(texts(filters.in_date_range(F.lit(None).cast("string"), F.lit("")))) == 7


@pytest.mark.parametrize("stretch", [1, 3, 65536])
def test_cap_equals_reading_in_order(spark, stretch):
    """A hot group with most rows, small ones, capped and not, against a plain loop."""
    rows = []
    for group, n, limit in (("hot", 400, 57), ("few", 5, 9), ("free", 20, None), ("zero", 7, 0), ("one", 6, 1)):
        rows += [(group, pos, limit, (pos * 7919 + len(group)) % 3 == 0) for pos in range(n)]
    df = spark.createDataFrame(rows, "g string, arrival_pos long, n long, is_spam boolean").repartition(8)
    expected = set()
    for group in {r[0] for r in rows}:
        kept = 0
        for _, pos, limit, spam in sorted(r for r in rows if r[0] == group):
            if limit and kept >= limit:
                break
            kept += not spam
            expected.add((group, pos))
    got = {(r.g, r.arrival_pos) for r in cap.capped(df, "g", "n", ~F.col("is_spam"), stretch).collect()}
    assert got == expected


def _world(spark):
    verdicts = ["hi", "Enter your seed phrase", "hello", "Enter your seed phrase", "hey"]
    comments = spark.createDataFrame(
        [("abcdefghijk", i, "Joe", "UC1", t, f"2024-01-0{i + 1}T00:00:00Z", 5, 0) for i, t in enumerate(verdicts)],
        "video_id string, arrival_pos long, author_name string, author_channel_id string, text string, published_at string, like_count long, reply_count long")
    videos = spark.createDataFrame(
        [("abcdefghijk", "T", "2024", 1, 2, 3, "UC9", "u")],
        "video_id string, title string, published_at string, view_count long, like_count long, comment_count long, channel_id string, url string")
    asked = spark.createDataFrame(
        [(0, "youtu.be/abcdefghijk"), (1, "bad"), (2, "youtu.be/zzzzzzzzzzz"), (3, "youtu.be/abcdefghijk")], "request_pos long, url string")
    return asked, videos, comments


def test_run(spark):
    asked, videos, comments = _world(spark)
    result = run_urls(asked, videos, comments, Options(max_comments=2, filter_spam=True, sort_by="date_desc"))
    assert [(r.request_pos, r.arrival_pos) for r in result.comments.collect()] == [(0, 2), (0, 0), (3, 2), (3, 0)]
    assert [(r.request_pos, r.arrival_pos) for r in result.spam.collect()] == [(0, 1), (3, 1)]
    assert [(r.request_pos, r.spam_filtered) for r in result.metadata.collect()] == [(0, 1), (3, 1)]
    assert {r.request_pos: r.reason for r in result.rejects.collect()} == {1: "invalid_url", 2: "not_found"}
    assert aggregates.totals(result.metadata, result.comments, result.spam).first()[:] == (2, 4, 2)


def test_run_without_spam_filter_and_with_failures(spark):
    asked, videos, comments = _world(spark)
    result = run_urls(asked.where("request_pos = 0"), videos, comments, Options(sort_by="nothing"))
    assert [r.arrival_pos for r in result.comments.collect()] == [0, 1, 2, 3, 4] and result.spam.isEmpty()
    failed = spark.createDataFrame([("https://youtu.be/abcdefghijk", 403, "commentsDisabled")], "url string, status int, body string")
    result = run_urls(asked.where("request_pos = 0"), videos, comments, failures=failed)
    assert result.metadata.isEmpty() and result.comments.isEmpty()
    assert result.rejects.first().reason == "comments_disabled"


def test_sort_keys_and_presets(spark):
    assert [ordering.sort_key(n) for n in ("Likes", "Date (Newest)", "Date (Oldest)", "?")] == ["likes", "date_desc", "date_asc", "likes"]
    df = spark.createDataFrame([("bitcoin", "", 0), ("Enter your seed phrase", "", 0)], "text string, author_name string, like_count long")
    swept = {r.preset: (r.spam_count, r.strength) for r in preset_sweep(df).collect()}
    assert swept == {"light": (1, "Light"), "moderate": (1, "Moderate"), "aggressive": (2, "Aggressive"), "strict": (2, "Strict")}


def test_ranks_equal_a_sort(spark):
    rows = [("hot", i, (i * 7919) % 13) for i in range(300)] + [("one", 5, 1)]
    df = spark.createDataFrame(rows, "g string, arrival_pos long, like_count long").withColumn("published_at", F.lit(""))
    got = ordering.ranked(df.repartition(8), "g", ordering.comment_order("likes")).where("g = 'hot'").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 301))
    expected = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[2], r[1]))
    assert [r.arrival_pos for r in got] == [r[1] for r in expected]
