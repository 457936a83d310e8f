"""Comments, videos and requests as views over the test tables.

Every event is a comment: the text is the whole document of the same number,
where there is one, followed by one of the phrases below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.patterns import sql
from .functions.urls import CANONICAL_URL
from .session import configure

# Phrases that make comments of every kind, by number.
PHRASES = (
    "Great video, thank you", "Buy bitcoin and ethereum now", "Enter your seed phrase",
    "guaranteed returns for everyone", "join t.me/somegroup today", "message me on whatsapp",
    "call +1 555 123 4567", "write to joe [at] mail [dot] com", "write to joe@mail.com",
    "write to joe@mail.com and/or me", "official pinned message", "subscribe to my channel",
    "click the link below", "my new ebook is out", "go to bit.ly/abc123 fast", "see https://example.com/page",
    "Hello [name] welcome", "total game changer", "visit a dating site", "like if you agree", "first", "first!",
    "соntact me", "t.e.l.e.g.r.a.m now", "wh@ts@pp group", "great explanation at 5:32",
    "what is bitcoin?", "@joe thanks for the tip", "1000x moon and 10x", "earn $500 daily",
    "earn $500 daily and/or weekly", "not sure about this but maybe helpful",
)


# Pieces with invisible characters, marks, and characters that decompose into several.
VARIANTS = (
    "ze\u200bro wi\u2060dth", "e\u0301te\u0301 a\u030a", "\ufb01nal o\ufb03ce", "\xbd cup \u2163", "5\u338f \u2122",
    "wait\u2026", "\ud55c\uae00", "\uff22\uff35\uff39 now", "\xc5ngstr\xf6m \u1e9b\u0323", "\ufeffplain",
)


def table(spark: SparkSession, sf_dir: str, name: str, spread: int | None = None) -> DataFrame:
    """A test table; ``spread`` deals its rows over so many partitions, for tables of one unsplittable file."""
    df = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(spread) if spread else df


def comments(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    events, documents = table(spark, sf_dir, "events", spread), table(spark, sf_dir, "documents", spread)
    phrases = f"array({', '.join(map(sql, PHRASES))})"
    joined = events.join(
        documents.select(F.col("doc_id").alias("event_id"), F.col("text").alias("document"), "source"),
        "event_id", "left")
    key = F.coalesce(F.col("source"), F.concat(F.lit("user"), F.col("user_id")))
    name_end = F.when(F.col("event_type") == "signup", " official").when(F.col("event_type") == "error", " ✅").otherwise("")
    return joined.select(
        F.substring(F.md5(key), 1, 11).alias("video_id"),
        F.col("event_id").alias("arrival_pos"),
        F.concat(F.lit("UC"), F.col("user_id")).alias("author_channel_id"),
        F.concat(F.lit("user"), F.col("user_id"), name_end).alias("author_name"),
        F.concat_ws(" ", "document", F.expr(f"{phrases}[int(event_id % {len(PHRASES)})]")).alias("text"),
        F.floor("value").cast("long").alias("like_count"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        (F.col("event_id") % 7).alias("reply_count"),
    )


def variants(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    """``doc_id, text, threshold``: the start of each document with one of the pieces; some texts blank or null.

    Thresholds lie below, in and above the range that counts.
    """
    c, n = F.col, F.col("doc_id") % 11
    piece, phrase = (F.expr(f"array({', '.join(map(sql, x))})[int(doc_id % {len(x)})]") for x in (VARIANTS, PHRASES))
    text = F.when(n == 0, "").when(n == 1, " \t\n ").when(n == 2, F.lit(None)).otherwise(
        F.concat(F.substring("text", 1, 120), F.lit(" "), piece, F.lit(" "), phrase))
    return table(spark, sf_dir, "documents", spread).select(
        "doc_id", text.alias("text"), F.when(c("doc_id") % 3 == 0, -1.0).when(c("doc_id") % 3 == 1, 0.4).otherwise(2.0).alias("threshold"))


def videos(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    """One video per id among the comments; its creator wrote the first comment."""
    first = comments(spark, sf_dir, spread).groupBy("video_id").agg(
        F.min_by("author_channel_id", "arrival_pos").alias("channel_id"),
        F.min("published_at").alias("published_at"),
        F.sum("like_count").alias("like_count"),
        F.count("*").alias("comment_count"),
    )
    return first.select(
        "video_id", F.concat(F.lit("Video "), "video_id").alias("title"), "published_at",
        (F.col("like_count") * 10).alias("view_count"), "like_count", "comment_count", "channel_id",
        F.concat(F.lit(CANONICAL_URL), "video_id").alias("url"),
    )


def raw_requests(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    """Requests as typed: one per customer, in many URL forms, some of them wrong."""
    c = F.col
    customer = table(spark, sf_dir, "customer", spread)
    video = F.substring(F.md5(F.concat(F.lit("user"), c("c_custkey"))), 1, 11)
    number = c("c_nationkey")
    return customer.select(
        c("c_custkey").alias("request_pos"),
        F.concat(
            F.when(number < 5, "https://www.youtube.com/watch?v=").when(number < 9, " youtu.be/")
            .when(number < 12, "https://m.youtube.com/shorts/").when(number < 15, "youtube.com/embed/")
            .when(number < 18, "http://youtube.com/v/").when(number < 20, "youtube.com/watch?list=x&v=")
            .when(number < 21, "HTTPS://YOUTUBE.COM/watch?v=").otherwise("https://www.youtube.com/watch?v="),
            F.when(number == 22, F.substring(video, 1, 10)).when(number == 23, "").otherwise(video),
            F.when(number % 2 == 0, "  ").otherwise("&t=1"),
        ).alias("url"),
        F.when(c("c_mktsegment") == "BUILDING", "").when(c("c_mktsegment") == "MACHINERY", "abc")
        .otherwise(F.concat(F.lit(" "), F.floor(c("c_acctbal") / 100).cast("string"))).alias("min_likes"),
        F.when(number < 6, "").when(number < 8, "all").when(number < 10, "0").when(number < 12, "1_0")
        .otherwise((number - 13).cast("string")).alias("max_comments"),
        F.when(c("c_mktsegment") == "FURNITURE", "telegram, Bitcoin ,,now").when(c("c_mktsegment") == "HOUSEHOLD", " , ")
        .otherwise("").alias("words"),
        F.when(number < 4, "2024-02-30").when(number < 8, "2024/01/01").when(number < 12, " 2024-01-15 ")
        .when(number < 16, "2024-03-01").otherwise("").alias("date_from"),
        F.when(number % 3 == 0, "2024-02-01").otherwise("").alias("date_to"),
    )


def requests(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    """One request per video, every fifth of them twice, options by video."""
    c = F.col
    options = videos(spark, sf_dir, spread).select(
        "video_id", F.conv(F.substring(F.md5("video_id"), 1, 6), 16, 10).cast("long").alias("n"))
    twice = options.withColumn("part", F.explode(F.when(c("n") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.select(
        (c("n") * 2 + c("part")).alias("request_pos"),
        F.concat(F.lit(CANONICAL_URL), "video_id").alias("url"),
        "video_id",
        (c("n") % 3).alias("min_likes"),
        F.when(c("n") % 4 == 0, F.lit(None)).otherwise(c("n") % 7 * 3).cast("long").alias("max_comments"),
        F.when(c("n") % 6 == 0, F.array(F.lit("now"), F.lit("Thank"), F.lit("c++")))
        .otherwise(F.array().cast("array<string>")).alias("words"),
        F.when(c("n") % 5 == 1, "2024-01-03").alias("date_from"),
        F.when(c("n") % 7 == 2, "2024-01-20").alias("date_to"),
        (c("n") % 8 != 3).alias("filter_spam"),
        (c("n") % 2 == 0).alias("exclude_creator"),
        F.when(c("n") % 4 == 0, "likes").when(c("n") % 4 == 1, "date_desc").when(c("n") % 4 == 2, "date_asc")
        .otherwise("arrival").alias("sort_by"),
        F.when(c("n") % 3 == 0, F.lit(0.4)).otherwise(F.lit(0.5)).alias("threshold"),
    )


def fetch_log(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    """Failed fetches: one per event, with page text as body."""
    c = F.col
    events, pages = table(spark, sf_dir, "events", spread), table(spark, sf_dir, "pages", spread)
    joined = events.join(pages.select(c("page_id").alias("event_id"), "html"), "event_id", "left")
    body = (
        F.when(c("event_type") == "click", "{reason: commentsDisabled}")
        .when(c("event_type") == "view", "The owner has Disabled Comments here")
        .when(c("event_type") == "signup", "quotaExceeded")
        .otherwise(F.coalesce(c("html"), F.concat(F.lit("upstream 403 "), c("props"))))
    )
    return joined.select(
        "event_id",
        F.when(c("user_id") % 4 == 0, 404).when(c("user_id") % 4 == 1, 500).otherwise(403).alias("status"),
        body.alias("body"),
    )
