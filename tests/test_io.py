import itertools
import json
import os
import random
import time

import pandas as pd

from sparkcomments.plans.run import COMMENT_COLUMNS
from sparkcomments.sinks import tables
from sparkcomments.sources import chains, pages
from sparkcomments.staging import Workspace, shared_folder, staged
from sparkcomments.streaming import cap, pages as streaming


def _item(text, likes=0, author={"value": "UC1"}):
    snippet = {"authorDisplayName": "Joe", "textDisplay": text, "publishedAt": "2024-01-01T00:00:00Z", "likeCount": likes}
    if author is not None:
        snippet["authorChannelId"] = author
    return {"snippet": {"totalReplyCount": 2, "topLevelComment": {"snippet": snippet}}}


def _land(folder, name, page_no, items, video="v"):
    folder.mkdir(exist_ok=True)
    page = {"video_id": video, "page_no": page_no, "items": items}
    (folder / f"{name}.json").write_text(json.dumps(page))


def test_comment_pages(spark, tmp_path):
    broken = _item("x")
    del broken["snippet"]["topLevelComment"]["snippet"]["textDisplay"], broken["snippet"]["topLevelComment"]["snippet"]["likeCount"]
    _land(tmp_path / "p", "a", 0, [_item("a", 3), _item("b", author=None), _item("c", author="plain")])
    _land(tmp_path / "p", "b", 1, [broken])
    _land(tmp_path / "p", "c", 2, [])
    got = pages.read_comment_pages(spark, str(tmp_path / "p")).orderBy("arrival_pos").collect()
    assert [(r.arrival_pos, r.text, r.author_channel_id, r.like_count, r.reply_count) for r in got] == [
        (0, "a", "UC1", 3, 2), (1, "b", "", 0, 2), (2, "c", "", 0, 2), (100, "", "UC1", 0, 2)]


def test_video_pages_and_url_list(spark, tmp_path):
    (tmp_path / "v").mkdir()
    lines = [
        {"video_id": "abcdefghijk", "items": [{"id": "abcdefghijk", "snippet": {"title": "T", "channelId": "UC"}, "statistics": {"viewCount": "12"}}]},
        {"video_id": "b", "items": []}, {"video_id": "c", "items": [{"id": "c", "snippet": {}}]},
    ]
    (tmp_path / "v" / "x.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r.video_id: r for r in pages.read_video_pages(spark, str(tmp_path / "v")).collect()}
    assert set(got) == {"abcdefghijk", "c"} and got["abcdefghijk"].view_count == 12 and got["c"].title == ""
    assert got["c"].url == "https://www.youtube.com/watch?v=c" and got["c"].like_count == 0
    (tmp_path / "v" / "y.json").write_text("\n".join(map(json.dumps, lines[:1])))  # landed again
    assert pages.read_video_pages(spark, str(tmp_path / "v")).count() == 2
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "1.txt").write_text("z\n")
    (tmp_path / "lists" / "2.txt").write_text("long list\n\nb\n" * 50)
    (tmp_path / "lists" / "3.txt").write_text("a\n")
    several = pages.read_url_list(spark, str(tmp_path / "lists")).orderBy("request_pos").collect()
    assert [r.url for r in several] == ["z", *["long list", "b"] * 50, "a"]
    (tmp_path / "urls.txt").write_text(" b \n\n a\nb\n")
    listed = pages.read_url_list(spark, str(tmp_path / "urls.txt")).orderBy("request_pos").collect()
    assert [r.url for r in listed] == ["b", "a", "b"]


def test_csv_and_workbook(spark, tmp_path):
    comments = spark.createDataFrame(
        [("v", "Joe", 'say "hi",\nyou ', "2024", 3, 0, True)],
        "video_id string, author_name string, text string, published_at string, like_count long, reply_count long, is_creator boolean")
    shown = tables.export_comments(comments)
    assert shown.columns[-1] == "Is Creator" and "Is Creator" not in tables.export_comments(comments, False).columns
    tables.save_csv(str(tmp_path / "out"), shown, shown, shown.limit(0))
    part = max(((tmp_path / "out_comments").glob("*.csv")), key=lambda p: p.stat().st_size).read_text()
    assert part == ('Video ID,Author Name,Comment Text,Comment Date,Comment Likes,Replies,Is Creator\n'
                    'v,Joe,"say ""hi"",\nyou ",2024,3,0,True\n')
    assert not (tmp_path / "out_spam").exists()
    tables.save_workbook(str(tmp_path / "book"), shown, shown)
    assert spark.read.parquet(str(tmp_path / "book" / "Comments")).count() == 1


def test_stream_equals_batch_and_cap_holds_across_batches(spark, tmp_path):
    folder = tmp_path / "pages"
    texts = ["hi", "Enter your seed phrase", "hello"]
    _land(folder, "a", 0, [_item(t) for t in texts])
    scored = streaming.score_pages(spark, str(folder))
    streaming.write_scored(scored, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.arrival_pos: r.is_spam for r in streaming.read_scored(spark, str(tmp_path / "out")).collect()}
    assert got == {0: False, 1: True, 2: False}
    for page, video in ((0, "v"), (1, "v"), (1, "w")):
        if page:
            _land(folder, f"{page}{video}", page, [_item(t) for t in texts], video)
        streaming.write_capped(scored, str(tmp_path / "cap"), str(tmp_path / "ck2"), 3).awaitTermination()
    rows = streaming.read_scored(spark, str(tmp_path / "cap")).collect()
    assert sorted((r.video_id, r.arrival_pos) for r in rows) == [
        ("v", 0), ("v", 1), ("v", 2), ("v", 100), ("w", 100), ("w", 101), ("w", 102)]
    assert set(COMMENT_COLUMNS[:-1]) <= set(rows[0].asDict())


def test_like_counts_of_number_columns(spark):
    from pyspark.sql import functions as F

    from sparkcomments.functions.inputs import lenient_likes

    rows = spark.createDataFrame([(150.0, "12.5"), (99.5, " 12 "), (None, "x")], "n double, t string")
    out = rows.select(lenient_likes(F.col("n")).alias("n"), lenient_likes(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in out] == [(150, 0), (99, 12), (0, 0)]


def _land_at(folder, name, when, *pages_):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, pages_)))
    os.utime(folder / f"{name}.json", (when, when))


def _page(text, page_no, video="v", token=None):
    return {"video_id": video, "page_no": page_no, "items": [_item(text)]} | ({"nextPageToken": token} if token else {})


def test_pages_landed_again(spark, tmp_path):
    folder = tmp_path / "p"
    _land_at(folder, "b", 1000, _page("old", 0), _page("one", 1), _page("null", 0, None))
    _land_at(folder, "a", 2000, _page("new", 0), _page("x", 0, "w"), _page("null, again", 0, None))
    _land_at(folder, "c", 2000, _page("newest", 0), _page("y", 0, "w"), _page("z", 0, "w"))  # equal times: by path, then place
    texts = lambda keep: sorted((r.video_id or "-", r.arrival_pos, r.text) for r in pages.read_comment_pages(spark, str(folder), keep).collect())
    assert texts("latest") == [("-", 0, "null, again"), ("v", 0, "newest"), ("v", 100, "one"), ("w", 0, "z")]
    assert texts("first") == [("-", 0, "null"), ("v", 0, "old"), ("v", 100, "one"), ("w", 0, "x")]


def test_no_text_is_shuffled_for_the_latest_answer(spark, tmp_path):
    _land_at(tmp_path / "p", "a", 1000, _page("a", 0), _page("b", 1))
    _land_at(tmp_path / "p", "b", 2000, _page("c", 0))
    read = pages.read_comment_pages(spark, str(tmp_path / "p"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert sorted(r.text for r in read.collect()) == ["b", "c"]


def test_stream_reads_a_page_once(spark, tmp_path):
    """Over several micro-batches and restarts, the stream equals the batch that keeps the first answer."""
    folder, out, checkpoint = tmp_path / "p", str(tmp_path / "out"), str(tmp_path / "ck")
    for landing in range(3):
        _land_at(folder, f"{landing}a", 1000 + 2 * landing, _page(f"text {landing}", 0), _page(f"own {landing}", landing + 1))
        _land_at(folder, f"{landing}b", 1001 + 2 * landing, _page(f"again {landing}", 0), _page("w", 0, "w"))
        rows = pages.stream_comment_pages(spark, str(folder), files_per_batch=1)
        streaming.write_rows(rows, out, checkpoint).awaitTermination()
    batch = pages.read_comment_pages(spark, str(folder), keep="first")
    stream = spark.read.parquet(out)
    assert stream.columns == batch.columns and sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
    assert stream.count() == 5


def test_capped_stream_late_pages_and_expiry(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "p", str(tmp_path / "out"), str(tmp_path / "ck")

    def run(remembered):
        rows = streaming.score_pages(spark, str(folder), remembered=remembered)
        streaming.write_capped(rows, out, checkpoint, 3, remembered).awaitTermination()
        return sorted((r.video_id, r.arrival_pos, r.is_spam) for r in streaming.read_scored(spark, out).collect())

    spam = "Enter your seed phrase"
    _land(folder, "5", 5, [_item("hi"), _item(spam), _item("hello")])
    first = run(1)
    assert first == [("v", 500, False), ("v", 501, True), ("v", 502, False)]
    _land(folder, "1", 1, [_item(spam), _item("late"), _item(spam), _item("too late")])  # takes what is left, up to the third kept one
    late = run(1)
    assert late == sorted([*first, ("v", 100, True), ("v", 101, False)])
    _land(folder, "6", 6, [_item(spam), _item("full")])
    assert run(1) == late
    time.sleep(4)
    _land(folder, "w", 0, [_item("moves the clock on")], "w")
    run(1)
    time.sleep(2)
    _land(folder, "w2", 1, [_item("moves the clock on")], "w")
    run(1)
    _land(folder, "7", 7, [_item("anew")])  # long after: the total of v is gone
    assert ("v", 700, False) in run(1)


def test_cut_of_a_video_does_not_depend_on_frames():
    r = random.Random(1)
    for _ in range(200):
        flags = [r.random() < 0.5 for _ in range(r.randint(0, 12))]
        rows = pd.DataFrame({"arrival_pos": range(len(flags)), "is_spam": flags}).sample(frac=1, random_state=r.randint(0, 99))
        left, held = r.randint(1, 5), None
        for start in range(0, len(rows), 3):
            part = rows.iloc[start:start + 3]
            held = cap.FirstKept._until_cut(part if held is None else pd.concat([held, part]), left)
        kept_before = [0, *itertools.accumulate(not f for f in flags)]
        assert ([] if held is None else held.arrival_pos.tolist()) == [i for i in range(len(flags)) if kept_before[i] < left]


def test_page_chains(spark):
    landed = {
        "whole": ([0, 1, 2], 2), "open": ([0, 1], None), "start": ([2, 3], 3), "inside": ([0, 1, 5, 6, 9], 9), "one": ([0], 0), "far": ([7, 8, 70], None),
        "early end": ([0, 1, 2], 1)}
    rows = [(v, n, None if n == last else "t") for v, (numbers, last) in landed.items() for n in numbers]
    rows += [("one", 0, ""), ("whole", 2, None), (None, 1, None), ("minus", -1, None), ("null", None, None)]
    table = spark.createDataFrame(rows, "video_id string, page_no long, nextPageToken string")
    expected = {("open", 2, None, "end"), ("start", 0, 1, "start"), ("inside", 2, 4, "inside"), ("inside", 7, 8, "inside"), ("far", 0, 6, "start"),
                ("far", 9, 69, "inside"), ("far", 71, None, "end"), ("early end", 3, None, "end"), (None, 0, 0, "start")}
    for stretch in (1, 3, 8, 65_536):
        got = [tuple(r) for r in chains.missing_pages(table, stretch).collect()]
        assert len(got) == len(expected) and set(got) == expected
        found = {r.video_id: tuple(r)[1:] for r in chains.chain_summary(table, stretch).collect()}
        assert found == {"whole": (3, 2, 0, True, True), "open": (2, 1, 0, False, False), "start": (2, 3, 2, True, False), "inside": (5, 9, 5, True, False),
                         "one": (1, 0, 0, True, True), "far": (3, 70, 68, False, False), "early end": (3, 2, 0, False, False), None: (1, 1, 1, True, False)}
    assert chains.missing_pages(table.where("false")).count() == chains.chain_summary(table.where("false")).count() == 0


def test_workspaces_delete_what_they_hold(spark):
    df = spark.range(5)
    with Workspace(spark) as outer:
        first = staged(df, "a")
        with Workspace(spark):
            second = staged(first, "b")
            assert second.count() == 5
        assert first.count() == 5 and os.path.isdir(outer.folder.removeprefix("file:"))
    assert not os.path.exists(outer.folder.removeprefix("file:"))
    outer.close()
    assert outer.folder.startswith(shared_folder(spark))


def test_rows_beyond_the_cut_stay_where_they_are_read():


    r = random.Random(4)
    for n in (0, 1, 300):
        rows = pd.DataFrame({"v": [r.choice(["a", "b", None]) for _ in range(n)], "at": [r.randint(0, 120) for _ in range(n)],
                             "spam": [r.random() < 0.5 for _ in range(n)]}, index=range(5, 5 + n)).astype({"v": object})
        got = cap.before_cut(rows["v"], rows["at"], rows["spam"].astype(bool), 5).tolist()
        every = list(rows.itertuples(index=False))
        assert got == [sum(y.v == x.v and y.at < x.at and not y.spam for y in every) < 5 for x in every]


def test_a_large_video_does_not_go_to_one_task(spark, tmp_path):
    """Of a video with 3,000 kept comments in one micro-batch, a few from each task reach the state; the rows are those of the plain cut."""
    from pyspark.sql import functions as F

    pages, cut = str(tmp_path / "pages"), 5
    items = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.struct(F.struct(F.struct(F.struct(
        F.concat(F.lit("hi "), i).alias("textDisplay")).alias("snippet")).alias("topLevelComment")).alias("snippet")))
    spark.range(30, numPartitions=4).select(F.lit("v").alias("video_id"), F.col("id").alias("page_no"), items.alias("items")).write.json(pages)
    query = streaming.write_capped(streaming.score_pages(spark, pages), str(tmp_path / "out"), str(tmp_path / "cp"), cut)
    query.awaitTermination()
    assert sorted(r.arrival_pos for r in streaming.read_scored(spark, str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]
    plan = query._jsq.explainInternal(False)
    assert "may_pass" in plan and plan.index("TransformWithState") < plan.index("may_pass")


def test_bounds_of_videos_hold_over_frames(monkeypatch):
    """Against a plain count, also where more videos come than are remembered."""
    r = random.Random(3)
    for noted in (2_000_000, 40, 4):
        for n in (1, 2, 5):
            monkeypatch.setattr(cap, "NOTED", noted)
            bounds, seen = cap.Bounds(n), []
            for size in (0, 60, 7, 40, 60):
                rows = [(r.choice(["a", "b", "c", "d", "e", None]), r.randint(0, 90), r.random() < 0.5) for _ in range(size)]
                frame = pd.DataFrame(rows, columns=["v", "at", "counted"]).astype({"v": object, "at": "int64", "counted": bool})
                got = bounds.beyond(frame["v"], frame["at"], frame["counted"].to_numpy())
                seen += [(v, at) for v, at, counted in rows if counted]
                exact = [sum(w == v and before < at for w, before in seen) >= n for v, at, _ in rows]
                assert not [1 for g, e in zip(got, exact) if g and not e]
                assert noted < 2_000_000 or [g for g, (v, *_) in zip(got, rows) if v] == [e for e, (v, *_) in zip(exact, rows) if v]


def test_comments_beyond_the_cut_are_not_scored(spark):
    """Of a large video few texts are scored, of one that begins with spam as many as it takes; the cut is that of all scored."""
    from pyspark.sql import Observation, functions as F

    limit, read = 5, [Observation(), Observation()]
    kinds = F.when(F.col("id") % 5000 < 4000, "large").when(F.col("id") % 5000 < 4300, "spam first").otherwise(F.concat(F.lit("v"), F.col("id") % 100))
    comments = spark.range(20_000, numPartitions=4).select(
        kinds.alias("video_id"), F.when(F.col("id") != 17, F.col("id") % 5000 * 10 + F.col("id") % 3).alias("arrival_pos"),
        F.when((F.col("id") % 5000).between(4000, 4199), "spam").when(F.col("id") % 7 == 0, "spam").when(F.col("id") % 11 == 0, "").otherwise("text").alias("text"))

    def score(rows, text, prefix):
        seen = rows.observe(read[prefix == "_then_"], F.count(text).alias("n"))
        return seen.withColumn(prefix + "is_spam", F.coalesce(F.col(text) == "spam", F.lit(False))).drop(text)

    def first(rows):
        held = sorted((r.video_id, r.arrival_pos is None, r.arrival_pos or 0, r.text, r.is_spam) for r in rows)
        return [x for x in held if sum(y[0] == x[0] and y[1:3] < x[1:3] and not y[4] for y in held) < limit]

    got = cap.scored_to_cut(comments, limit, score, ("is_spam",))
    assert got.columns == ["video_id", "arrival_pos", "text", "is_spam"]
    got = got.collect()
    assert first(got) == first(comments.withColumn("is_spam", F.col("text") == "spam").collect())
    assert all(r.is_spam == (r.text == "spam") for r in got)
    assert read[0].get["n"] + read[1].get["n"] < 6000 and len(got) < 4000


def test_capped_stream_scored_to_the_cut(spark, tmp_path):
    """Over two landings, the rows and columns of a stream in which all is scored."""
    spam, texts, folder = "Enter your seed phrase", ["hi", "Enter your seed phrase", "", "hello"], tmp_path / "p"
    for landing, numbers in enumerate(((0, 2, 4), (1, 3, 0))):
        for n in numbers:
            _land(folder, f"{landing}{n}", n, [_item(texts[(i + n) % 4]) for i in range(60)])
            _land(folder, f"{landing}{n}w", n, [_item(spam) for _ in range(60)] + [_item("late")], "w")
        for name, first in (("all", {}), ("cut", {"first": 4})):
            scored = streaming.score_pages(spark, str(folder), **first)
            streaming.write_capped(scored, str(tmp_path / name), str(tmp_path / f"{name}-ck"), 4).awaitTermination()
    every, cut = (streaming.read_scored(spark, str(tmp_path / name)) for name in ("all", "cut"))
    assert every.columns == cut.columns and every.count() > 100
    assert sorted(map(repr, every.collect())) == sorted(map(repr, cut.collect()))


def test_generated_pages_and_their_landings(spark, tmp_path):
    import __spark_entry__ as entry
    from pyspark.sql import functions as F
    from sparkcomments import adapters, schemas

    sf_dir, once, twice = "/root/testdata/sf0.001", str(tmp_path / "once"), str(tmp_path / "twice")
    entry._land(entry._pages(spark, sf_dir), once)
    landed = spark.read.schema(schemas.COMMENT_PAGE).json(once)
    assert {len(r["items"]) for r in landed.select("items").collect()} == {100}
    at = landed.select("video_id", "page_no", F.posexplode("items")).where("col IS NOT NULL").selectExpr(
        "video_id", "page_no * 100 + pos", "col.snippet.topLevelComment.snippet.textDisplay")
    assert sorted(map(tuple, at.collect())) == sorted(map(tuple, adapters.comments(spark, sf_dir).select("video_id", "arrival_pos", "text").collect()))
    apart = entry._landed_apart(spark, sf_dir, "page_no % 2 = 0")
    for landing in ([apart[0]], apart, [once], [str(tmp_path / "none")]):
        entry._land_again(spark, twice, *landing)
    pages, again = (sorted(map(repr, df.collect())) for df in (landed, spark.read.schema(schemas.COMMENT_PAGE).json(twice)))
    even = sorted(map(repr, landed.where("page_no % 2 = 0").collect()))
    assert 0 < len(even) < len(pages) and again == sorted([*even, *pages, *pages])


def test_rows_come_through_the_state_whole(spark, tmp_path):
    """Every column as it was, of types that travel packed and of others."""
    from pyspark.sql import functions as F

    folder = tmp_path / "p"
    texts = ['say "hi" \\ there', "a\n\tb \u0001   é 😀 é", "", "{\"a\": [1, null]}", "NaN", "null", "Enter your seed phrase", "1e400 ​"]
    _land(folder, "0", 0, [_item(t) for t in texts])
    scored = streaming.score_pages(spark, str(folder)).withColumns({
        "at": F.timestamp_micros(F.lit(1_700_000_000_123_456) + F.col("arrival_pos")), "share": F.expr("CASE arrival_pos WHEN 1 THEN double('NaN') WHEN 2 THEN "
        "double('-Infinity') WHEN 3 THEN 0.1D + 0.2D WHEN 4 THEN -0.0D ELSE NULL END"), "most": F.lit(2**63 - 1), "exact": F.lit("1.10").cast("decimal(9,2)")})
    streaming.write_scored(scored, str(tmp_path / "all"), str(tmp_path / "ck")).awaitTermination()
    streaming.write_capped(scored, str(tmp_path / "cap"), str(tmp_path / "ck2"), 100).awaitTermination()
    every, through = (streaming.read_scored(spark, str(tmp_path / name)) for name in ("all", "cap"))
    assert [f"{f.name} {f.dataType}" for f in through.schema] == [f"{f.name} {f.dataType}" for f in every.schema]
    assert sorted(map(repr, through.collect())) == sorted(map(repr, every.collect()))
    assert through.count() == len(texts)
