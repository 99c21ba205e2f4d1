"""Operators against literal cases and pure-Python models."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import dates, taxonomy, text, urls
from gleanwork.operators import clustering, dedup, gates, html, tables
from gleanwork.plans import relational
from gleanwork.sources import landing
from gleanwork.streaming import clusters, jobs


def one(spark, value, use, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(use(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTPS://Example.com:443/Path/?utm_source=x&b=2&a=1#frag", "https://example.com/Path?a=1&b=2"),
        ("http://a.com:80", "http://a.com/"),
        ("https://a.com//x///y/?ref=1", "https://a.com/x/y"),
        ("https://a.com/caf\u00e9?q=a b", "https://a.com/caf%C3%A9?q=a+b"),
        ("https://a.com/%7Eme?a=&utm_id=3", "https://a.com/~me?a="),
        ("not a url", None),
        ("", None),
        (None, None),
        ("ftp://a.com/x", None),
    ],
)
def test_canonical_urls(spark, url, expected):
    assert one(spark, url, urls.canonicalize_url) == expected


def test_url_facts(spark):
    assert one(spark, "https://www.News.example.com/world/", urls.host) == "news.example.com"
    assert one(spark, "https://a.com/world/", urls.is_portal) and not one(spark, "https://a.com/world/story-1", urls.is_portal)
    assert str(one(spark, "https://a.com/2024/2/3/x", urls.date_in_path)) == "2024-02-03"
    assert one(spark, "https://a.com/2024/13/3/x", urls.date_in_path) is None


def test_text(spark):
    assert one(spark, "hello   world\n\n\n\nbye ", text.clean_text) == "hello world\n\nbye"
    assert one(spark, "Breaking: The Fed says rates fell!", text.title_signature) == "fed fell rates"
    assert one(spark, "Is it?", text.title_signature) == "is it"
    assert sorted(one(spark, "Prices fell as companies cited policies", text.claim_tokens)) == ["as", "cit", "company", "fall", "policy", "price"]
    assert one(spark, "Mr. Smith met U.S. envoys. They talked! Ok?", text.sentences) == ["Mr. Smith met U.S. envoys.", "They talked!", "Ok?"]
    assert one(spark, "a short text", lambda c: text.truncate_words(c, 10)) == "a short\u2026"
    assert one(spark, "Lead one. Tiny. In 1999 he said it.", lambda c: text.compress(c, 32, ["said"])) == "Lead one. In 1999 he said it."
    assert one(spark, "one two three four", lambda c: text.word_ngrams(c, 3)) == ["one two three", "two three four"]


def test_dates(spark):
    utc = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    assert one(spark, "Tue, 02 Jan 2024 10:00:00 +0200", lambda c: utc(dates.publication_time(c))) == "2024-01-02 08:00:00"
    assert one(spark, "2024-01-02T10:00:00Z", lambda c: utc(dates.publication_time(c))) == "2024-01-02 10:00:00"
    assert one(spark, "soon", lambda c: utc(dates.publication_time(c))) is None
    assert one(spark, "20240102T030405Z", lambda c: utc(dates.compact_time(c))) == "2024-01-02 03:04:05"
    assert one(spark, "Jan 2, 2024", lambda c: utc(dates.shown_date(c))) == "2024-01-02 00:00:00"


@pytest.mark.parametrize(
    ("title", "primary", "news"),
    [
        ("Startup launches a generative AI assistant", "ARTIFICIAL_INTELLIGENCE", True),
        ("Central bank decides to hold its inflation target", "FINANCE", True),
        ("Hostilities end along the front line as truce is signed", "WAR_CONFLICT", True),
        ("Ten kettles for a small kitchen shelf", None, False),
        ("Chess Tournaments: results from the hall", None, False),
    ],
)
def test_classification(spark, title, primary, news):
    got = one(spark, title, lambda c: taxonomy.classify(c, F.lit("")))
    assert (got.primary_category, got.newsworthiness, got.article_quality) == (primary, news, "snippet")


def test_categories_are_normalized(spark):
    synonyms = {"ai": "ARTIFICIAL_INTELLIGENCE", "us politics": "GLOBAL_POLITICS"}
    norm = lambda v: one(spark, v, lambda c: taxonomy.normalize_category(c, synonyms, True))
    assert [norm(v) for v in ("AI", "technology", "sports", "celebrity", "Global Politics", "new us politics", None)] == ["ARTIFICIAL_INTELLIGENCE", "TECHNOLOGY", "SPORTS", None, "GLOBAL_POLITICS", "GLOBAL_POLITICS", None]


def test_reject_reasons_in_order(spark):
    rows = [
        (None, "A title that is long enough", "b" * 50, "2024-01-10"), ("https://a.com/world", "A title that is long enough", "b" * 50, "2024-01-10"), ("https://a.com/x1", "Short", "b" * 50, "2024-01-10"),
        ("https://a.com/x2", "Sculptor in an interview on marble", "b" * 50, "2024-01-10"), ("https://a.com/x3", "Hostilities end as truce is signed", "short", "2024-01-10"), ("https://a.com/x4", "Nothing of note happened here", "b" * 50, "2024-01-10"),
        ("https://a.com/x5", "Hostilities end as truce is signed", "b" * 50, None), ("https://a.com/x6", "Hostilities end as truce is signed", "b" * 50, "2023-01-10"), ("https://a.com/x7", "Hostilities end as truce is signed", "b" * 50, "2024-01-10"),
    ]
    df = spark.createDataFrame(rows, "url string, title string, body string, at string").withColumn("at", F.to_timestamp("at"))
    reason = gates.reject_reason(F.col("url"), F.col("title"), F.col("body"), F.col("at"), F.to_timestamp(F.lit("2024-01-11")))
    assert [r[0] for r in df.select(reason).collect()] == ["INSUFFICIENT_METADATA", "PORTAL_PAGE", "INSUFFICIENT_METADATA", "OPINION_CONTENT", "INSUFFICIENT_METADATA", "OUT_OF_SCOPE", "INSUFFICIENT_METADATA", "STALE_ARTICLE", None]
    accepted, rejected = gates.split_rejects(df, reason)
    assert (accepted.count(), rejected.count()) == (1, 8)


def test_greedy_dedup_equals_a_sequential_scan(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, "", *[f"i{n}" for n in range(25)]]), rng.choice([None, *[f"u{n}" for n in range(25)]]), f"h{rng.randrange(40)}") for k in range(80)]
    seen, expected = (set(), set(), set()), []
    for k, *keys in rows:
        if not any(v and v in s for v, s in zip(keys, seen, strict=True)):
            expected.append(k)
            for v, s in zip(keys, seen, strict=True):
                s.update([v] if v else [])
    df = spark.createDataFrame(rows, "seq long, a string, b string, c string").repartition(3)
    assert sorted(r.seq for r in dedup.greedy_first_seen(df, ["a", "b", "c"], "seq").collect()) == expected


def test_clusters_grow_and_close(spark):
    rows = [
        ("1", "Acme Corp unveils giant battery plant", ["BUSINESS"], "a.com", "2024-01-01 00:00:00"), ("2", "Acme Corp plans giant battery plant expansion", ["BUSINESS"], "b.com", "2024-01-01 10:00:00"),
        ("3", "Acme Corp unveils giant battery plant", ["SCIENCE"], "c.com", "2024-01-01 11:00:00"), ("4", "Acme Corp unveils giant battery plant", ["BUSINESS"], "c.com", "2024-01-03 11:00:00"), ("5", "Acme Corp unveils giant battery plant", ["BUSINESS"], "c.com", None),
    ]
    df = spark.createDataFrame(rows, "item_id string, title string, categories array<string>, publisher string, at string").withColumn("published_at", F.to_timestamp("at")).withColumn("block", F.lit(1))
    assert {r.item_id: r.story_id for r in clustering.cluster_stories(df, ["block"]).collect()} == {"1": "1", "2": "1", "3": "3", "4": "4", "5": "5"}


def test_html_extraction():
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>T</h1><p>" + "word " * 100 + "</p></article><footer>foot</footer></body></html>"
    body, method, _ = html.extract_one(page)
    assert method == "container" and "menu" not in body and "foot" not in body and body.startswith("T\nword")
    assert html.extract_one(None) == ("", "none", 0.0) and html.extract_one("<p>only text")[:2] == ("only text", "blocks")


def test_payloads_and_registry(spark):
    gdelt = json.dumps({"articles": [{"url": "https://a.com/x", "title": "T", "seendate": "20240102T030405Z"}, {"url": "", "title": "no"}]})
    got = landing.gdelt_articles(spark.createDataFrame([(gdelt,), ("",), (None,)], "payload string")).collect()
    assert [(r.title, r.source_domain, str(r.published_at)[:19]) for r in got] == [("T", "a.com", "2024-01-02 03:04:05")]
    search = json.dumps({"results": [{"href": "https://a.com/x", "title": "T", "body": "b"}, {"url": "https://b.com", "score": 0.5, "content": "c"}, {"title": "no url"}]})
    good, bad = landing.search_articles(spark.createDataFrame([(search,)], "payload string"))
    assert [r.title for r in good.orderBy("url").collect()] == ["T", "https://b.com"] and bad.count() == 1
    feeds = spark.createDataFrame([("a", "https://f", "SCIENCE", 2, True), ("b", "http://f", "SCIENCE", 1, True), ("c", "https://f", "SCIENCE", 1, True), ("c", "https://g", "X", 1, True), ("d", "https://f", "SCIENCE", 1, False)], "id string, url string, category string, priority int, active boolean")
    active, wrong = landing.feed_registry(feeds, taxonomy.CATEGORIES)
    assert [r.id for r in active.collect()] == ["a"] and wrong.count() == 3


def test_feeds_and_providers(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>One</title><link>https://e.com/a?utm_source=x</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><guid>g1</guid><category>x</category></item><item><title>No link</title></item></channel></rss>")
    (got,) = landing.feed_items(spark, str(tmp_path)).collect()
    assert (got.title, got.id, str(got.published_at)) == ("One", "g1", "2024-01-02 10:00:00")
    p = landing.Providers()
    p.register("a", lambda s: s.createDataFrame([(1,)], "x int"))
    p.register("b", lambda s: s.read.parquet("/nowhere"))
    rows, failed = p.scan(spark)
    assert rows.count() == 1 and list(failed) == ["b"]


def test_maintenance(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "id int, v string")
    assert {(r.id, r.v, r.change) for r in tables.upsert(old, new, ["id"]).collect()} == {(1, "a", "kept"), (2, "c", "updated"), (3, None, "inserted")}
    log = spark.createDataFrame([(1, 1, "reserve"), (1, 2, "publish"), (1, 3, "reserve"), (2, 1, "publish")], "k int, t int, s string")
    got = tables.latest_state(log, "k", ["t"], {"new": ["reserve"], "reserve": ["publish"]}, "s", "new")
    assert {(r.k, r.state) for r in got.collect()} == {(1, "publish"), (2, "new")}


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    events = spark.read.schema(schema).parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = jobs.landing(spark, f"{tmp_path}/in", schema)
    assert jobs.drained(jobs.once_by_id(stream, "event_id", "ts", "365 days"), f"{tmp_path}/a", f"{tmp_path}/ca").count() == events.select("event_id").distinct().count()
    late = events.agg(F.max("ts")).first()[0]
    fresh = jobs.drained(jobs.fresh(stream, "ts", F.lit(late)), f"{tmp_path}/b", f"{tmp_path}/cb").count()
    assert fresh == events.filter(F.col("ts") >= F.lit(late) - F.expr("interval 180 minutes")).count()
    counted = []
    jobs.upsert_batches(stream, lambda df, _: counted.append(df.count()), f"{tmp_path}/cc").awaitTermination()
    assert sum(counted) == events.count()
    windows = jobs.category_counts(stream, F.col("event_type"), "ts", late="60 days")
    query = windows.writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = events.groupBy(F.window("ts", "24 hours").start.alias("start"), F.col("event_type").alias("category")).agg(F.count("*").alias("n"))
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in batch.select("start", "category", "n").collect()}


def test_clustering_a_stream_equals_the_batch(spark, tmp_path):
    """Two blocks over nine days: clusters open and end while the stream runs."""
    rng = random.Random(4)
    names = ["Acme Corp", "Blue River", "North Bank"]
    rows = [(str(k), f"{rng.choice(names)} unveils {rng.choice(['giant', 'small'])} {rng.choice(['battery', 'solar'])} plant", [rng.choice(["A", "B"])], rng.choice(["a.com", "b.com", None]), f"2024-01-0{1 + k // 12} {2 * (k % 12):02d}:00:00" if k % 25 else None, rng.choice(["x", "y"])) for k in range(108)]
    df = spark.createDataFrame(rows, "item_id string, title string, categories array<string>, publisher string, at string, block string").select("*", F.to_timestamp("at").alias("published_at"))
    batch = {(r.item_id, r.story_id) for r in clustering.cluster_stories(df, ["block"]).collect()}
    for day in range(9):
        df.filter(F.coalesce(F.dayofmonth("published_at"), F.lit(1)) == day + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = jobs.drained(clusters.cluster_stream(stream, "block"), f"{tmp_path}/out", f"{tmp_path}/c")
        assert {(r.item_id, r.story_id) for r in got.collect()} == batch and len(batch) == 108
        left = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "live").load()
        # Only clusters of the last window are still there, each in a row of its own.
        assert 0 < left.count() < len({s for _, s in batch}) / 2
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_subject_survival_reads_the_whole_seed(spark, tmp_path):
    seed = "the " * 20 + "Harbour Bridge Reopening"
    rows = [(1, 0, seed), (1, 1, "Harbour Bridge Reopening"), (1, 2, "nothing of it")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.turn: r.survives for r in relational.f17(spark, str(tmp_path)).collect()} == {1: True, 2: False}
