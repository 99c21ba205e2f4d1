"""Expressions that are computed once, and work that is spread, whatever the input's files."""

import re

from pyspark.sql import functions as F

from gleanwork.functions import taxonomy, text
from gleanwork.operators.pagetree import parsed
from gleanwork.plans import derived, editorial, newsroom


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_chosen_once(spark):
    df = spark.createDataFrame([("One. Two.",)], "x string").select(text.compress_to_limit(F.col("x"), 40).alias("post"))
    assert plan(df).count("aggregate(") == 1
    assert plan(df).count("array_sort(") <= 2


def test_a_text_is_classified_once(spark, sf_dir):
    once = sum(p.count("semiconductor") for p in taxonomy.SIGNALS.values())
    # Both texts together, and the title and the body for the primary category.
    assert plan(newsroom.c07(spark, sf_dir)).count("semiconductor") == 3 * once
    assert plan(newsroom.f03(spark, sf_dir)).count("semiconductor") == once


def test_a_small_file_is_many_tasks(spark, sf_dir):
    assert derived.table(spark, sf_dir, "wire").rdd.getNumPartitions() >= 4


def test_word_boundaries_in_front_change_nothing():
    said = ["a war", "warm", "new chip set", "telecoms", "the intel unit will launch a device", "front line.", "data centre", "ai", "said", "peace talks", "airstrikes", "", "who is who", "nvidia chips"]
    for pattern in [*taxonomy.SIGNALS.values(), r"\ba|b", r"x\|\by", r"(?:\bq|r)s"]:
        own = taxonomy._at_words(pattern)
        assert [bool(re.search(own, s)) for s in said + derived.TITLES] == [bool(re.search(pattern, s)) for s in said + derived.TITLES]


def test_an_unfinished_reference_is_text():
    """As lxml has it and as the SQL of h02 says: a title cut off in a reference keeps what there is of it."""
    assert parsed("<title>a &amp;&amp</title>")[1]["<title>"] == "a &&amp"
    assert parsed("<p>&lt;b&gt; &#38; AT&T</p>")[0].text() == "<b> & AT&T"
    assert parsed('<link rel="canonical" href="https://a.org/?x=1&copy=2&amp;y=3">')[1]["canonical"] == "https://a.org/?x=1&copy=2&y=3"


def test_sentences_are_not_shuffled_word_by_word(spark, sf_dir):
    assert "collect_list" not in plan(editorial.p03_gate(spark, sf_dir))


def test_pages_are_read_in_slices(spark, sf_dir):
    assert "MapInPandas" not in plan(newsroom.h06(spark, sf_dir))


def test_a_host_is_taken_from_its_address_once_for_all_aggregators(spark):
    from gleanwork.functions import publishers, urls

    shown = str(publishers.is_aggregator(urls.host(F.col("url")))._jc.toString())
    assert shown.count("regexp_extract") <= 2
    hosts = spark.createDataFrame([("bing.com", True), ("a.bing.com", True), ("nobing.com", False), ("bingxcom", False), ("", False), (None, None)], "h string, want boolean")
    assert all(r.got == r.want for r in hosts.select("want", publishers.is_aggregator(F.col("h")).alias("got")).collect())


def test_lines_are_dealt_by_story_once(spark, sf_dir):
    from gleanwork.plans import derived

    rows = derived.table(spark, sf_dir, "claims").groupBy("story_id").agg(F.max("claim_id"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_posts_subject_and_text_are_named_once(spark):
    from gleanwork.operators import posts

    none = F.array().cast("array<string>")
    shown = str(F.array_join(posts.simple_errors(F.col("post"), F.length("post"), none, none, none, text.distinctive(F.col("title"), F.lit("")), none), ",")._jc.toString())
    assert shown.count("split(") == 1


def test_claims_meet_their_support_where_they_are_dealt(spark, sf_dir, monkeypatch):
    """One shuffle for each table of lines, into parts that grow in number with the lines."""
    monkeypatch.setattr(derived, "LINES_AT_ONCE", 500)
    shown = editorial.p05(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange hashpartitioning") == 4
    assert derived.table(spark, sf_dir, "claims").rdd.getNumPartitions() >= 6000 // 500


def test_support_counts_repeated_and_missing_evidence(spark):
    from gleanwork.operators import claims as c_ops

    claims = spark.createDataFrame([(1, "a", ["e1", "e1", "e2", "e9"]), (1, "b", []), (1, "c", None), (2, "a", ["e1", None])], "story_id long, claim_id string, evidence_ids array<string>")
    evidence = spark.createDataFrame([(1, "e1", "s1"), (1, "e2", "s2"), (1, "e2", "s3"), (2, "e1", None)], "story_id long, evidence_id string, source_id string").withColumn("published_at", F.to_date(F.lit("2002-01-01")))
    checks = spark.createDataFrame([(1, "a", "SUPPORTED"), (1, "a", "CONTRADICTED"), (2, "z", "SUPPORTED")], "story_id long, claim_id string, status string")
    ranks = spark.createDataFrame([(1, "s1", "PRIMARY"), (1, "s2", "SECONDARY"), (2, None, "PRIMARY")], "story_id long, source_id string, source_type string")
    got = {(r.story_id, r.claim_id): (r.strength, r.diversity, r.recency_days, r.agreement, r.contradiction) for r in c_ops.support_measures(claims, evidence, checks, ranks, F.to_date(F.lit("2002-01-03"))).collect()}
    assert got == {(1, "a"): ((1 + 1 + 0.75) / 5, 3, 2, 0.5, 0.5), (1, "b"): (0, 0, None, None, None), (1, "c"): (0, 0, None, None, None), (2, "a"): (0, 0, 2, None, None)}


def test_audited_links_are_dealt_by_story_once(spark, sf_dir, monkeypatch):
    """Links and items meet by item, and what is left happens where a story is dealt, without sorting a row for each value."""
    monkeypatch.setattr(derived, "LINES_AT_ONCE", 500)
    rows = newsroom.a14_audit(spark, sf_dir)
    shown = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(story_id", shown)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(item_id", shown)) == 2
    assert "SortAggregate" not in shown
    assert rows.rdd.getNumPartitions() >= 6000 // 500


def test_an_audit_keeps_the_order_of_first_sight_and_every_story(spark):
    from gleanwork.operators import stories

    links = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (1, 11, 3), (1, 99, 0), (2, 99, 1), (3, 12, 1), (3, 10, 1), (4, 13, 1)], "story_id long, item_id long, n int")
    items = spark.createDataFrame([(10, "b.org", "B", "rss", "q", "2024-01-02"), (11, "", "A", "rss", None, None), (12, None, "", "", "z", "2024-01-05"), (13, "d", "", "ddgs", "", "2024-01-04"), (13, "c", "", "ddgs", "", "2024-01-03")], "item_id long, publisher_domain string, publisher_name string, provider string, query string, t string")
    items = items.withColumn("published_at", F.to_date("t")).drop("t")
    for parts in (None, 3):
        got = {r.story_id: (r.publishers, r.providers, r.queries, str(r.published_at), r.sources) for r in stories.audit(links, items, ["n"], parts).collect()}
        assert got == {1: (["A", "b.org"], ["rss"], ["q"], "2024-01-02", 4), 2: ([], [], [], "None", 1), 3: (["b.org"], ["rss"], ["q", "z"], "2024-01-02", 2), 4: (["c", "d"], ["ddgs"], [], "2024-01-03", 2)}


def test_links_meet_where_their_keys_are_dealt(spark, sf_dir, monkeypatch):
    from gleanwork.plans import relational

    monkeypatch.setattr(derived, "LINES_AT_ONCE", 500)
    rows = relational.m04(spark, sf_dir)
    shown = rows._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), (\w+)", shown)
    assert dealt and all(int(n) >= 6000 // 500 and how == "REPARTITION_BY_NUM" for n, how in dealt)
    assert rows.count() == rows.distinct().count()


def test_strongest_claims_meet_their_sources_where_they_are_dealt(spark, sf_dir, monkeypatch):
    """One shuffle for each of claims, verifications, evidence and assessments, and one for posts where they are asked."""
    monkeypatch.setattr(derived, "LINES_AT_ONCE", 500)
    for query, tables in ((editorial.r06, 4), (editorial.r07, 5)):
        shown = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert shown.count("Exchange hashpartitioning") == tables


def test_claims_are_ranked_once_whatever_their_verifications(spark):
    from gleanwork.operators import claims as c_ops

    said = "story_id long, claim_id string, claim_text string, evidence_ids array<string>, is_forecast boolean, is_allegation boolean, is_opinion boolean, uncertainty string"
    claims = spark.createDataFrame([(1, c, "It rained.", ids, None, False, False, None) for c, ids in (("a", ["e1", "e2"]), ("b", ["e1", "e3"]), ("c", []), ("d", None), ("e", ["e4"]), (None, ["e1"]))], said)
    evidence = spark.createDataFrame([(1, "e1", "s1", "https://a.net/1", 1), (1, "e2", "s2", "https://b.net/1", 2), (1, "e3", None, "https://c.net/1", 3), (1, "e4", "s1", "nowhere", 4), (2, "e1", "s1", "https://a.net/1", 1)], "story_id long, evidence_id string, source_id string, url string, pos int")
    # Two verifications of a: the stronger one names nothing that is there, so the other's evidence counts with its status.
    checks = spark.createDataFrame([(1, "a", "SUPPORTED", ["e9"]), (1, "a", "supported_as_attributed", None), (1, "b", "SUPPORTED", []), (1, "c", "SUPPORTED", ["e1"]), (1, "d", "SUPPORTED", None), (1, "e", "SUPPORTED", None), (1, None, "SUPPORTED", None)], "story_id long, claim_id string, status string, evidence_ids array<string>")
    ranks = spark.createDataFrame([(1, "s1", "SECONDARY"), (1, "s1", "PRIMARY"), (1, None, "PRIMARY"), (2, "s2", "PRIMARY")], "story_id long, source_id string, source_type string")
    got = {r.claim_id: (r.position, r.quality, r.sources, r.status) for r in c_ops.ranked_claims(claims, evidence, checks, ranks).collect()}
    assert got == {"a": (1, 4, 2, "SUPPORTED"), "b": (2, 4, 1, "SUPPORTED")}
    assert [r.claim_id for r in c_ops.strongest_claim(claims, evidence, checks, ranks).collect()] == ["a"]


def test_a_central_event_is_read_once_a_story(spark, sf_dir):
    assert re.search(r"Join .*\n(?:.*\n)*.* AS event_tokens", plan(editorial.r07(spark, sf_dir)))
