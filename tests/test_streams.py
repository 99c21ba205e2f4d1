"""Streams against their batch rules: rejects, upserts, expiring reservations."""

import pytest
from pyspark.sql import functions as F

from gleanwork import config
from gleanwork.functions import registered
from gleanwork.operators import gates
from gleanwork.sources import landing, payloads
from gleanwork.streaming import jobs, reservations


def test_landing_stream_splits_rejects_like_a_batch(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.substring("html", 60, 40).alias("title"))
    pages.repartition(3).write.parquet(f"{tmp_path}/in")
    reason = F.when(~gates.valid_article(F.col("url"), F.col("title")), "INVALID").when(F.col("page_id") % 3 == 0, "THIRD")
    stream = jobs.landing(spark, f"{tmp_path}/in", "page_id long, url string, title string")
    good, bad = jobs.normalized(stream, lambda df: df.withColumn("title", F.trim("title")), reason)
    batch_good, batch_bad = gates.split_rejects(pages.withColumn("title", F.trim("title")), reason)
    for name, found, expected in (("good", good, batch_good), ("bad", bad, batch_bad)):
        got = jobs.drained(found, f"{tmp_path}/{name}", f"{tmp_path}/c-{name}")
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in expected.select(got.columns).collect()}


def test_reservations_expire_or_finish(spark, tmp_path):
    rows = [("a", "publishing", "2024-01-01 10:00:00"), ("a", "published", "2024-01-01 10:10:00"), ("b", "publishing", "2024-01-01 10:00:00"), ("c", "publishing", "2024-01-01 10:05:00"), ("c", "failed", "2024-01-01 11:00:00"), ("z", "published", "2024-01-01 14:00:00")]
    df = spark.createDataFrame(rows, "story_id string, status string, t string").select("story_id", "status", F.to_timestamp("t").alias("at"))
    for part in (df.filter("at < '2024-01-01 10:30:00'"), df.filter("at >= '2024-01-01 10:30:00' and story_id <> 'z'"), df.filter("story_id = 'z'")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = jobs.drained(reservations.expiring(stream), f"{tmp_path}/out", f"{tmp_path}/c")
        found = {(r.story_id, r.state, str(r.at)) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert found == {("a", "finished", "2024-01-01 10:10:00"), ("b", "expired", "2024-01-01 10:30:00"), ("c", "expired", "2024-01-01 10:35:00")}


def test_options_come_from_the_environment():
    o = config.Options.from_environment({"NEWSROOM_CLUSTER_WINDOW_HOURS": "900", "NEWSROOM_MAX_ARTICLE_AGE_DAYS": "x", "NEWSROOM_ENABLE_TAVILY": "Yes"})
    assert (o.cluster_hours, o.max_article_age_days, o.with_optional_search, o.stale_reservation_minutes) == (168, 30, True, 30)


def test_functions_by_name(spark):
    df = spark.createDataFrame([("https://www.a.org/x?utm_id=1", "The Fed says rates fell")], "url string, title string")
    out = registered.register_functions(spark, "named", df, {"host": "url_host(url)", "c": "canonicalize_url(url)", "sig": "title_signature(lower(title))"})
    assert tuple(spark.sql("select host, c, sig from named").first()) == tuple(out.select("host", "c", "sig").first()) == ("a.org", "https://a.org/x".replace("a.org", "www.a.org"), "fed fell rates")


def test_payload_shapes_sinks_and_snapshots(spark, tmp_path):
    answers = spark.createDataFrame([('[{"href": "https://a.com/x", "title": "T", "body": "b", "date": "2024-01-02"}, {"title": "no url"}]', "text"), ('[{"url": "https://a.com/y", "title": "U", "excerpt": "e", "source": "S", "date": "2024/01/02"}]', "news")], "payload string, kind string")
    good, bad = payloads.ddgs_articles(answers, F.col("kind"))
    assert {(r.kind, r.title, r.description, r.source_name, str(r.published_at)) for r in good.collect()} == {("text", "T", "b", None, "None"), ("news", "U", "e", "S", "2024-01-02 00:00:00")} and bad.count() == 1
    found = spark.createDataFrame([('{"results": [{"url": "https://a.com/x?utm_id=1", "content": "c", "raw_content": "r", "score": 0.5}, {"title": "none"}]}',)], "payload string")
    assert [(r.title, r.canonical_url, r.snippet, r.content, r.score) for r in payloads.tavily_articles(found).collect()] == [("https://a.com/x?utm_id=1", "https://a.com/x", "c", "r", 0.5)]
    assert [r.content for r in payloads.tavily_articles(found, extract=True).collect()] == ["r"]
    log = spark.createDataFrame([(1, "a"), (2, "b")], "n int, agent string")
    payloads.append_log(log, f"{tmp_path}/log"), payloads.append_log(log.selectExpr("n + 2 as n", "agent"), f"{tmp_path}/log")
    (tmp_path / "log" / "part-broken.json").write_text("\n{oops\n")
    lines = landing.log_lines(spark, f"{tmp_path}/log", "n int, agent string")
    assert [r.n for r in payloads.last_lines(lines, [F.desc("n")], 2).collect()] == [4, 3]
    payloads.write_csv(log, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    for k in (1, 2):
        log.filter(f"n <= {k}").write.parquet(f"{tmp_path}/tables/2024010{k}")
        (tmp_path / "snap").mkdir(exist_ok=True)
        (tmp_path / "snap" / f"run{k}.json").write_text(f'{{"run": {k},\n "post": {{"text": "t{k}"}}}}')
        import os

        os.utime(tmp_path / "snap" / f"run{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    log.write.parquet(f"{tmp_path}/tables/20240103")
    (tmp_path / "tables" / "20240103" / "_SUCCESS").unlink()
    assert payloads.latest_table(spark, f"file://{tmp_path}/tables").count() == 2
    assert [r.run for r in payloads.newest_snapshot(spark, f"{tmp_path}/snap").collect()] == [2]


def test_atom_feeds_and_provider_order(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed><entry><title>One</title><link href="https://e.com/self" rel="self"/><link href="https://e.com/a"/><updated>2024-01-02T10:00:00Z</updated><summary>s</summary><category term="x"/><category term="y"/></entry><entry><title>No link</title></entry></feed>')
    (got,) = landing.feed_items(spark, str(tmp_path), "entry").collect()
    assert (got.title, got.url, got.categories, str(got.published_at)) == ("One", "https://e.com/a", ["x", "y"], "2024-01-02 10:00:00")
    one = lambda s: s.createDataFrame([(1,)], "x int")
    p = landing.Providers.ordered([("b", 2, one), ("a", 2, one), ("c", 1, one)], [("search", one)], ("extra", one))
    rows, failed = p.scan(spark, normalize=lambda df: df.withColumn("y", F.col("x") + 1))
    assert [r.provider for r in rows.orderBy("provider_rank").collect()] == ["c", "a", "b", "search", "extra"] and not failed and rows.first().y == 2


@pytest.mark.parametrize(("url", "domain", "wrong"), [("https://f.org", "f.org", []), ("https://f.org", "", ["publisher"]), ("https://news.google.com/rss", "g", ["publisher"])])
def test_feeds_name_their_publisher(spark, url, domain, wrong):
    feeds = spark.createDataFrame([("a", url, "SCIENCE", 1, True, domain)], "id string, url string, category string, priority int, active boolean, publisher_domain string")
    active, rejects = landing.feed_registry(feeds, ["SCIENCE"])
    assert active.count() == (not wrong) and [r.reasons for r in rejects.collect()] == [wrong] * bool(wrong)


def test_inactivity_groups_and_sliding_counts_of_a_stream_equal_the_batch(spark, sf_dir, tmp_path):
    from gleanwork.plans import relational

    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value", "props")
    last = events.agg(F.max("ts")).first()[0]
    # A row far in the future moves the watermark, so that every group and window closes.
    end = spark.createDataFrame([(-1, last.replace(year=2030), -1, "end", 0.0, "")], schema)
    for part in (events, end):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.landing(spark, f"{tmp_path}/in", schema, files_at_once=1)
    groups = jobs.drained(jobs.inactivity_groups(stream, "user_id", "ts", late="40 days"), f"{tmp_path}/g", f"{tmp_path}/cg")
    assert {tuple(r) for r in groups.collect()} == {(r.user_id, r.first_seen, r["items"]) for r in relational.x06(spark, sf_dir).collect()}
    counts = jobs.drained(jobs.category_counts(stream, F.col("event_type"), "ts", late="40 days", width="48 hours", slide="24 hours"), f"{tmp_path}/w", f"{tmp_path}/cw")
    assert {(r.category, r.start, r.n) for r in counts.collect() if r.category != "end"} == {(r.event_type, r.start, r.n) for r in relational.x04(spark, sf_dir).collect()}
