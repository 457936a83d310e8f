
from __future__ import annotations

import functools
import os
import sys
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

import oracle  # noqa: E402
from sparkcomments import adapters as A  # noqa: E402
from sparkcomments.functions import inputs, normalize, rules, scoring, urls  # noqa: E402
from sparkcomments.functions.patterns import java  # noqa: E402
from sparkcomments.operators import aggregates, filters, listed, ordering  # noqa: E402
from sparkcomments.plans import run as plan, scoring as batch  # noqa: E402
from sparkcomments.sinks import tables as sinks  # noqa: E402
from sparkcomments.sources import chains, pages as sources  # noqa: E402
from sparkcomments.staging import workspace  # noqa: E402
from sparkcomments.streaming import pages as streaming  # noqa: E402

try:  # the operators for training data can be left out
    import corpus_pipeline
    from sparkcomments.llm import queries as llm
except ImportError:
    llm = None

c = F.col


def _spread(spark) -> int:
    """Each test table is one file of one row group, which no reader setting splits: deal rows to all cores."""
    return spark.sparkContext.defaultParallelism


def _scored(spark, sf_dir, columns=(), blacklist=None, whitelist=None, working=()) -> DataFrame:
    return scoring.analyze(
        A.comments(spark, sf_dir, _spread(spark)), c("text"), c("author_name"), c("like_count"),
        blacklist=blacklist, whitelist=whitelist, columns=columns, working=working)


def normalize_text(spark, sf_dir):
    return scoring.normalized(A.comments(spark, sf_dir, _spread(spark)), c("text")).select("arrival_pos", "normalized_text")


def obfuscation_flag(spark, sf_dir):
    return A.comments(spark, sf_dir, _spread(spark)).select(
        "arrival_pos", normalize.has_lookalikes(c("text")).alias("has_lookalikes"),
        c("author_name").rlike(java(rules.BADGE)).alias("has_badge"))


def normalize_variants(spark, sf_dir):
    return scoring.normalized(A.variants(spark, sf_dir, _spread(spark)), c("text")).select("doc_id", "normalized_text")


def threshold_clamp(spark, sf_dir):
    """Blank texts, and thresholds outside of the range that counts."""
    names = ("is_spam", "spam_score", "threshold", "reason")
    rows = A.variants(spark, sf_dir, _spread(spark)).withColumnRenamed("threshold", "_wanted")
    return scoring.analyze(rows, c("text"), threshold=c("_wanted"), columns=names).select("doc_id", *names)


def signal_hits(spark, sf_dir):
    entries = ["(IF(lookalike, 'S01', NULL), weights[0])"]
    for i, slot in enumerate(scoring.slots(rules.SIGNALS), 1):
        cases = " ".join(f"WHEN {r.id} THEN '{r.id}'" for r in slot)
        entries.append(f"(CASE {cases} END, weights[{i}])")
    scored = _scored(spark, sf_dir, working=("lookalike", "weights", *(r.id for r in rules.SIGNALS)))
    hits = scored.select("arrival_pos", F.expr(f"inline(array({', '.join(entries)}))").alias("signal_id", "weight"))
    return hits.where("signal_id IS NOT NULL")


def signal_matches(spark, sf_dir):
    scored = _scored(spark, sf_dir, ("signals", "legitimacy_signals"))
    matches = F.transform("signals", lambda s: F.concat(s["category"], F.lit("="), s["matched_text"]))
    return scored.select(
        "arrival_pos", F.array_join(matches, "|").alias("signal_matches"),
        F.array_join(c("legitimacy_signals.matched_text"), "|").alias("legitimacy_matches"))


def signal_counts_by_category(spark, sf_dir):
    categories = _scored(spark, sf_dir, ("categories",)).select(F.explode("categories").alias("category"))
    return categories.groupBy("category").agg(F.count("*").alias("comments"))


def crypto_keyword_count(spark, sf_dir):
    counted = _scored(spark, sf_dir, working=("S03_count",))
    return counted.where("S03_count > 0").select("arrival_pos", c("S03_count").alias("keywords"))


def base_score(spark, sf_dir):
    return _scored(spark, sf_dir, working=("n_signals", "base")).select(
        "arrival_pos", "n_signals", F.round("base", 9).alias("base_score"))


def legitimacy_adjustment(spark, sf_dir):
    return _scored(spark, sf_dir, ("legitimacy_reason",), working=("adjustment",)).select(
        "arrival_pos", F.round("adjustment", 9).alias("adjustment"), "legitimacy_reason")


def spam_score(spark, sf_dir):
    return _scored(spark, sf_dir, ("is_spam", "spam_score")).select("arrival_pos", "is_spam", "spam_score")


def spam_reason(spark, sf_dir):
    return _scored(spark, sf_dir, ("reason", "primary_category")).select("arrival_pos", "reason", "primary_category")


def whitelist_blacklist(spark, sf_dir):
    names = ("is_spam", "spam_score", "reason", "legitimacy_reason", "signals", "primary_category", "normalized_text")
    scored = _scored(spark, sf_dir, names, oracle.BLACKLIST, oracle.WHITELIST)
    matches = F.transform("signals", lambda s: F.concat(s["category"], F.lit("="), s["matched_text"]))
    return scored.select("arrival_pos", *(n for n in names if n != "signals"), F.array_join(matches, "|").alias("signal_matches"))


def _listed_patterns(spark, sf_dir) -> DataFrame:
    """User lists that grow with the tables: a piece of each third document, and the phrases' own words."""
    place, size = 11 + c("doc_id") % 40, 3 + c("doc_id") % 23
    pieces = A.table(spark, sf_dir, "documents").where(c("doc_id") % 3 == 0).select(
        c("doc_id").alias("position"), F.substr(F.col("text"), place, size).alias("pattern"))
    typed = [(-1 - i, pattern) for i, pattern in enumerate(oracle.BLACKLIST + oracle.WHITELIST)]
    return pieces.unionByName(spark.createDataFrame(typed, "position long, pattern string"))


def listed_patterns(spark, sf_dir):
    rows = A.comments(spark, sf_dir, _spread(spark)).select("arrival_pos", "text")
    return listed.first_listed(rows, "arrival_pos", "text", _listed_patterns(spark, sf_dir))


def listed_blacklist(spark, sf_dir):
    """The lists of whitelist_blacklist as tables."""
    black, white = (
        spark.createDataFrame(list(enumerate(patterns)), "position long, pattern string") for patterns in (oracle.BLACKLIST, oracle.WHITELIST))
    names = ("is_spam", "spam_score", "reason", "legitimacy_reason", "signals", "primary_category", "normalized_text")
    scored = batch.analyze_listed(
        A.comments(spark, sf_dir, _spread(spark)), "arrival_pos", blacklist=black, whitelist=white, columns=names)
    matches = F.transform("signals", lambda s: F.concat(s["category"], F.lit("="), s["matched_text"]))
    return scored.select("arrival_pos", *(n for n in names if n != "signals"), F.array_join(matches, "|").alias("signal_matches"))


def analyze_documents(spark, sf_dir):
    return batch.analyze_batch(A.table(spark, sf_dir, "documents", _spread(spark)).select("doc_id", "text")).select(
        "doc_id", "is_spam", "spam_score", "reason", F.array_join("categories", "|").alias("categories"),
        "had_obfuscation", "normalized_text")


def analyze_conversations(spark, sf_dir):
    return batch.analyze_batch(A.table(spark, sf_dir, "conversations", _spread(spark))).select(
        "conv_id", "turn", "is_spam", "spam_score", "reason", "legitimacy_reason")


def spam_flag(spark, sf_dir):
    documents = A.table(spark, sf_dir, "documents", _spread(spark)).select("doc_id", "text")
    return batch.spam_score(batch.spam_flag(documents, "text"), "text").select("doc_id", "is_spam", "spam_score")


def filter_min_likes(spark, sf_dir):
    return A.comments(spark, sf_dir, _spread(spark)).where(filters.min_likes(25)).select("video_id", "arrival_pos", "like_count")


def filter_date_range(spark, sf_dir):
    return A.comments(spark, sf_dir, _spread(spark)).where(filters.in_date_range("2024-01-05", "2024-01-20")).select(
        "video_id", "arrival_pos", "published_at")


def filter_words(spark, sf_dir):
    return A.comments(spark, sf_dir, _spread(spark)).where(filters.has_word(["Telegram", "video", "GREAT"])).select("video_id", "arrival_pos")


def exclude_creator(spark, sf_dir):
    flagged = filters.attach_creator(A.comments(spark, sf_dir, _spread(spark)), A.videos(spark, sf_dir, _spread(spark)))
    return flagged.where(filters.not_by_creator()).select("video_id", "arrival_pos", "author_channel_id")


def _run(spark, sf_dir) -> plan.Result:
    return plan.run(A.requests(spark, sf_dir, _spread(spark)), A.videos(spark, sf_dir, _spread(spark)), A.comments(spark, sf_dir, _spread(spark)))


def capped_comments(spark, sf_dir):
    return _run(spark, sf_dir).comments


def capped_spam(spark, sf_dir):
    return _run(spark, sf_dir).spam


def run_metadata(spark, sf_dir):
    return _run(spark, sf_dir).metadata


def sorted_comments(spark, sf_dir):
    keys = A.requests(spark, sf_dir, _spread(spark)).select("request_pos", "sort_by")
    rows = _run(spark, sf_dir).comments.select("request_pos", "arrival_pos", "like_count", "published_at")
    ranked = ordering.ranked(rows.join(keys, "request_pos"), "request_pos", ordering.comment_order(c("sort_by")))
    return ranked.select("request_pos", "arrival_pos", "rank")


def sorted_spam(spark, sf_dir):
    rows = _run(spark, sf_dir).spam.select("request_pos", "arrival_pos", "spam_score")
    return ordering.ranked(rows, "request_pos", ordering.spam_order()).select("request_pos", "arrival_pos", "rank")


def video_summary(spark, sf_dir):
    return aggregates.video_summary(_scored(spark, sf_dir, ("is_spam",)))


def totals(spark, sf_dir):
    result = _run(spark, sf_dir)
    return aggregates.totals(result.metadata, result.comments, result.spam)


def _url_lines(spark, sf_dir):
    typed = A.raw_requests(spark, sf_dir, _spread(spark)).select(F.lit("request").alias("origin"), c("request_pos").alias("id"), "url")
    return typed.unionByName(
        A.table(spark, sf_dir, "pages", _spread(spark)).select(F.lit("page").alias("origin"), c("page_id").alias("id"), "url"))


def extract_video_id(spark, sf_dir):
    return _url_lines(spark, sf_dir).select("origin", "id", urls.video_id(c("url")).alias("video_id"))


def url_summary(spark, sf_dir):
    return urls.url_summary(_url_lines(spark, sf_dir), "url", ["origin"])


def validate_requests(spark, sf_dir):
    return inputs.validate_requests(A.raw_requests(spark, sf_dir, _spread(spark))).withColumns(
        {"warnings": F.array_join("warnings", "; "), "words": F.array_join("words", "|")})


def date_checks(spark, sf_dir):
    rows = A.raw_requests(spark, sf_dir, _spread(spark))
    return rows.select("request_pos", *(inputs.date_error(c(name)).alias(f"{name}_error") for name in ("date_from", "date_to")))


def classify_fetch_errors(spark, sf_dir):
    kind, message = inputs.fetch_failure(c("status"), c("body"))
    return A.fetch_log(spark, sf_dir, _spread(spark)).select(
        "event_id", kind.alias("failure"), message.alias("message"), inputs.shown_failure(message).alias("shown"))


def rejected_requests(spark, sf_dir):
    requests = plan.requests_for(A.raw_requests(spark, sf_dir, _spread(spark)).select("request_pos", "url"))
    _, rejects = plan.requested_videos(requests, A.videos(spark, sf_dir, _spread(spark)), None)
    return rejects.select("request_pos", "reason", "message")


def failed_requests(spark, sf_dir):
    """Requests whose fetch failed: the log's entry of a number is that of the request of that number."""
    raw = A.raw_requests(spark, sf_dir, _spread(spark)).select("request_pos", "url")
    log = A.fetch_log(spark, sf_dir, _spread(spark)).join(raw.withColumnRenamed("request_pos", "event_id"), "event_id")
    _, rejects = plan.requested_videos(plan.requests_for(raw), A.videos(spark, sf_dir, _spread(spark)), log)
    return rejects.select("request_pos", "reason", "message", "shown")


def filter_spam_batch(spark, sf_dir):
    rows = A.comments(spark, sf_dir, _spread(spark)).withColumn("like_count", c("like_count").cast("string"))
    return batch.filter_spam(rows, "text", "author_name", "like_count", include_scores=True).select(
        "video_id", "arrival_pos", "text", "spam_score", "spam_signals")


def preset_sweep(spark, sf_dir):
    return batch.preset_sweep(A.comments(spark, sf_dir, _spread(spark)))


def export_metadata(spark, sf_dir):
    return sinks.export_metadata(_run(spark, sf_dir).metadata)


def export_comments(spark, sf_dir):
    return sinks.export_comments(_run(spark, sf_dir).comments)


def export_spam(spark, sf_dir):
    return sinks.export_spam(_run(spark, sf_dir).spam)


def saved_workbook(spark, sf_dir):
    """The comments of a workbook, written and read back."""
    result, folder = _run(spark, sf_dir), workspace(spark).path("workbook")
    sinks.save_workbook(folder, sinks.export_metadata(result.metadata), sinks.export_comments(result.comments))
    return spark.read.parquet(f"{folder}/{sinks.WORKBOOK_TABLES[1]}")


def _lines(sheets: dict[str, DataFrame]) -> DataFrame:
    """The rows of several tables, each as one line."""
    lines = [df.select(F.lit(name).alias("sheet"), F.concat_ws("|", *(F.col(f"`{x}`").cast("string") for x in df.columns)).alias("line"))
             for name, df in sheets.items()]
    return functools.reduce(DataFrame.unionByName, lines)


def _exports(spark, sf_dir) -> list[DataFrame]:
    result = _run(spark, sf_dir)
    return [sinks.export_metadata(result.metadata), sinks.export_comments(result.comments), sinks.export_spam(result.spam)]


def workbook_sheets(spark, sf_dir):
    """All three sheets of a workbook, written and read back."""
    folder = sinks.save_workbook(workspace(spark).path("workbook"), *_exports(spark, sf_dir))
    return _lines({name: spark.read.parquet(f"{folder}/{name}") for name in sinks.WORKBOOK_TABLES})


def saved_csv(spark, sf_dir):
    """All three CSV tables, written and read back."""
    base = sinks.save_csv(workspace(spark).path("csv"), *_exports(spark, sf_dir))
    return _lines({name: sinks.read_csv(spark, base, name) for name in ("metadata", "comments", "spam")})


def _pages(spark, sf_dir) -> DataFrame:
    """The comments as API answers: one page per stretch of 100 positions of a video."""
    rows = A.comments(spark, sf_dir)
    snippet = F.struct(
        c("author_name").alias("authorDisplayName"), F.struct(c("author_channel_id").alias("value")).alias("authorChannelId"),
        c("text").alias("textDisplay"), c("published_at").alias("publishedAt"), c("like_count").alias("likeCount"))
    item = F.struct(F.struct(
        c("reply_count").alias("totalReplyCount"), F.struct(snippet.alias("snippet")).alias("topLevelComment")).alias("snippet"))
    # At most 100 positions share a page, whatever the size of the video.  Places
    # of a page without a comment of this video are left empty.
    page_no = F.floor(c("arrival_pos") / sources.PAGE_SIZE)
    pages = rows.groupBy("video_id", page_no.alias("page_no")).agg(
        F.map_from_entries(F.collect_list(F.struct((c("arrival_pos") % sources.PAGE_SIZE).cast("int").alias("k"), item.alias("v")))).alias("m"))
    filled = pages.select("video_id", "page_no", F.sort_array(F.map_entries("m")).alias("filled"))
    empty = F.get(F.transform("filled", lambda x: x["value"]), F.lit(-1))

    def with_gap(x, i):
        before = F.when(i == 0, -1).otherwise(F.get("filled", i - 1)["key"])
        return F.concat(F.array_repeat(empty, x["key"] - before - 1), F.array(x["value"]))

    after = F.array_repeat(empty, sources.PAGE_SIZE - 1 - F.element_at("filled", -1)["key"])
    items = F.concat(F.flatten(F.transform("filled", with_gap)), after)
    return filled.select("video_id", "page_no", items.alias("items"))


def _land(pages: DataFrame, path: str) -> str:
    pages.write.mode("append").json(path, compression="gzip")
    return path


def _landed_pages(spark, sf_dir) -> str:
    """A folder with all pages."""
    return _land(_pages(spark, sf_dir), workspace(spark).path("pages"))


def _landed_apart(spark, sf_dir, which: str) -> list[str]:
    """Two folders: the pages for which a condition holds, and all others."""
    path = workspace(spark).path("pages")
    pages = _pages(spark, sf_dir).withColumn("_apart", F.coalesce(F.expr(which), F.lit(False)))
    pages.write.partitionBy("_apart").json(path, compression="gzip")
    return [f"{path}/_apart={value}" for value in ("true", "false")]


def _land_again(spark, path: str, *landed: str) -> str:
    """The pages of folders land in another, as they are: as copies of their files."""
    hadoop, conf, landing = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), uuid.uuid4().hex
    files = hadoop.Path(path).getFileSystem(conf)

    def copy(source):
        target = hadoop.Path(path, f"{landing}-{source.getParent().getName()}-{source.getName()}")
        if not hadoop.FileUtil.copy(files, source, files, target, False, conf):
            raise OSError(f"{source} was not copied")

    files.mkdirs(hadoop.Path(path))
    sources = [status.getPath() for folder in map(hadoop.Path, landed) if files.exists(folder) for status in files.listStatus(folder)]
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(copy, [source for source in sources if not source.getName().startswith(("_", "."))]))
    return path


def filter_spam_fractions(spark, sf_dir):
    rows = A.comments(spark, sf_dir, _spread(spark)).withColumns(
        {"like_count": c("like_count") + F.lit(0.5), "is_spam": F.lit("mine")})
    return batch.filter_spam(rows, "text", "author_name", "like_count").select("video_id", "arrival_pos", "is_spam")


def parse_comment_pages(spark, sf_dir):
    return sources.read_comment_pages(spark, _landed_pages(spark, sf_dir)).select(*plan.COMMENT_COLUMNS[:-1])


def video_pages(spark, sf_dir):
    """The videos as landed answers, each landed twice."""
    videos = A.videos(spark, sf_dir, _spread(spark))
    item = F.struct(
        c("video_id").alias("id"),
        F.struct("title", c("published_at").alias("publishedAt"), c("channel_id").alias("channelId")).alias("snippet"),
        F.struct(*(c(n).cast("string").alias(k) for n, k in (
            ("view_count", "viewCount"), ("like_count", "likeCount"), ("comment_count", "commentCount")))).alias("statistics"))
    path = workspace(spark).path("videos")
    answers = videos.select("video_id", F.array(item).alias("items"))
    for _ in range(2):
        answers.write.mode("append").json(path)
    return sources.read_video_pages(spark, path)


def url_list(spark, sf_dir):
    """The typed URLs as a folder of several lists, read back in order."""
    path = workspace(spark).path("urls")
    A.raw_requests(spark, sf_dir).repartitionByRange(4, "request_pos").sortWithinPartitions("request_pos").select(
        "url").write.text(path)
    return sources.read_url_list(spark, path)


def stream_scores(spark, sf_dir):
    pages, folder = _landed_pages(spark, sf_dir), workspace(spark).path("stream")
    streaming.write_scored(streaming.score_pages(spark, pages), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return streaming.read_scored(spark, f"{folder}/out").select("arrival_pos", "is_spam", "spam_score")


def stream_deduplicated(spark, sf_dir):
    """A folder whose pages landed twice, read as a stream: each page counts once."""
    landed, folder = _landed_pages(spark, sf_dir), workspace(spark).path("stream")
    pages = workspace(spark).path("twice")
    for _ in range(2):
        _land_again(spark, pages, landed)
    rows = sources.stream_comment_pages(spark, pages)
    streaming.write_rows(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*plan.COMMENT_COLUMNS[:-1])


def stream_capped(spark, sf_dir):
    """The first five kept comments of each video, over two landings: even pages, then all (so the odd ones are late)."""
    even, odd = _landed_apart(spark, sf_dir, "page_no % 2 = 0")
    pages, folder = workspace(spark).path("parts"), workspace(spark).path("stream")
    for landing in ([even], [even, odd]):
        _land_again(spark, pages, *landing)
        scored = streaming.score_pages(spark, pages, first=5)
        streaming.write_capped(scored, f"{folder}/out", f"{folder}/checkpoint", 5).awaitTermination()
    return streaming.read_scored(spark, f"{folder}/out").select("video_id", "arrival_pos", "is_spam")


def _landed_chains(spark, sf_dir) -> DataFrame:
    """Landed pages with their tokens, without comments. Of every other video, the last page landed again without one."""
    numbers = A.comments(spark, sf_dir, _spread(spark)).select(
        "video_id", F.floor(c("arrival_pos") / sources.PAGE_SIZE).alias("page_no")).distinct()
    ends = numbers.groupBy("video_id").agg(F.max("page_no").alias("page_no")).where(F.substring("video_id", 11, 1) < "8")
    path = workspace(spark).path("chains")
    numbers.withColumn("nextPageToken", F.concat(F.lit("page"), c("page_no") + 1)).write.json(path)
    ends.write.mode("append").json(path)
    return sources.read_comment_answers(spark, path)


def incomplete_videos(spark, sf_dir):
    """The pages that lack, by stretches."""
    return chains.missing_pages(_landed_chains(spark, sf_dir))


def video_chains(spark, sf_dir):
    return chains.chain_summary(_landed_chains(spark, sf_dir))


QUERIES = (
    normalize_text, obfuscation_flag, signal_hits, signal_matches, signal_counts_by_category, crypto_keyword_count,
    base_score, legitimacy_adjustment, spam_score, spam_reason, whitelist_blacklist, analyze_documents, spam_flag,
    analyze_conversations, filter_min_likes, filter_date_range, filter_words, exclude_creator, capped_comments,
    capped_spam, run_metadata, sorted_comments, sorted_spam, video_summary, totals, extract_video_id, url_summary,
    validate_requests, classify_fetch_errors, rejected_requests, failed_requests, filter_spam_batch, filter_spam_fractions, preset_sweep, export_metadata,
    export_comments, export_spam, saved_workbook, parse_comment_pages, video_pages, url_list, stream_scores,
    stream_deduplicated, stream_capped, incomplete_videos, video_chains, listed_patterns, listed_blacklist,
    normalize_variants, threshold_clamp, date_checks, workbook_sheets, saved_csv,
)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Flagship query: kept comments and flagged spam per video."""
    return video_summary(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {query.__name__: query for query in QUERIES}
    return found | llm.QUERIES | {"pipeline": corpus_pipeline.run} if llm else found


def oracle_sql() -> dict[str, str]:
    found = oracle.oracle_sql()
    return found | llm.ORACLE_SQL if llm else found
