"""SQL functions of the session against the columns of the library; runs with parts passed in."""

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import catalog, dates, text, urls
from gleanwork.operators import gates, selection

URLS = ["https://www.News.org:443/a/b?x=1#f", "http://user@blog.site.example.com", "ftp://h.net", "no url", "", None, "https://localhost/x", "https://a.test"]
TITLES = ["The Fed's rates—again! Up 5 %", "  a  bb ccc. (DDD) ", "", "One. Two?  Three!\nFour", None]


@pytest.fixture(scope="module")
def sql(spark):
    names = catalog.install(spark)
    assert len(names) == len(catalog.SCALARS) + len(catalog.TABLES)
    return spark.sql


def test_scalars_equal_the_columns(spark, sql):
    rows = spark.createDataFrame([(u, TITLES[k % len(TITLES)], f"2024-01-{1 + 3 * k:02d} 10:00:00" if k % 3 else None) for k, u in enumerate(URLS)], "u string, t string, at string").select("u", "t", F.to_timestamp("at").alias("at"))
    rows.createOrReplaceTempView("catalog_rows")
    now, words = F.to_timestamp(F.lit("2024-01-15 00:00:00")), text.similarity_words(F.lit("rates again the Fed"))
    expected = rows.select(
        urls.host(F.col("u")), urls.is_placeholder(F.col("u")), urls.item_id(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("u")), dates.age_minutes(F.col("at"), now), dates.is_current(F.col("at"), now, 10), dates.is_stale(F.col("at"), now, 30),
        text.normalize_title(F.col("t")), text.similarity_words(F.col("t")), text.jaccard(text.similarity_words(F.col("t")), words),
    ).collect()
    got = sql(
        "SELECT url_host(u), is_placeholder_url(u), article_id(NULL, NULL, u), age_minutes(at, TIMESTAMP'2024-01-15'), is_current(at, TIMESTAMP'2024-01-15', 10), is_stale(at, TIMESTAMP'2024-01-15', 30), "
        "normalized_title(t), similarity_words(t), jaccard(similarity_words(t), similarity_words('rates again the Fed')) FROM catalog_rows"
    ).collect()
    assert list(map(tuple, got)) == list(map(tuple, expected))


def test_they_stand_in_any_clause_with_several_arguments(spark, sql):
    rows = spark.createDataFrame([(0.8,), (0.4,), (0.2,), (0.15,), (0.05,)], "s double")
    rows.createOrReplaceTempView("scores")
    expected = {r[0]: r[1] for r in rows.select("s", gates.relationship(F.col("s"))).collect()}
    assert {r.s: r.r for r in sql("SELECT s, relationship(s) r FROM scores").collect()} == expected
    assert [r.n for r in sql("SELECT count(*) n FROM scores WHERE relationship(s) = 'DUPLICATE'").collect()] == [1]
    assert [tuple(r) for r in sql("SELECT url_on_domain('https://blog.a.org/x', 'A.org'), url_on_domain('https://nota.org', 'a.org'), url_on_domain(NULL, 'a.org')").collect()] == [(True, False, False)]
    assert sql("SELECT idempotency_key('threads', 's1', 'text')").first()[0] == spark.range(1).select(F.sha2(F.concat_ws("\0", F.lit("threads"), F.lit("s1"), F.lit("text")), 256)).first()[0]
    plan = sql("SELECT url_host(u) FROM catalog_rows WHERE age_minutes(at, TIMESTAMP'2024-01-15') < 500")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_table_functions(spark, sql):
    got = sql("SELECT pos, sentence FROM plain_sentences('One. Two?  Three!\nFour')").collect()
    assert [tuple(r) for r in got] == [(0, "One."), (1, "Two?"), (2, "Three!"), (3, "Four")]
    lateral = sql("SELECT t, pos, shingle FROM catalog_rows, LATERAL shingles(t, 2) WHERE t LIKE 'One%'").collect()
    assert sorted({(r.pos, r.shingle) for r in lateral}) == [(0, "one. two?"), (1, "two? three!"), (2, "three! four")]
    assert sql("SELECT * FROM shingles('one', 2)").count() == 0


def test_other_names(spark):
    assert "nw_url_host" in catalog.install(spark, "nw_") and spark.sql("SELECT nw_article_id('', NULL, 'u')").first()[0] == spark.sql("SELECT left(sha2('u', 256), 16)").first()[0]


def test_runs_with_memory_and_attempts_passed_in(spark):
    candidates = spark.createDataFrame([("g", k, f"s{k}") for k in range(6)] + [("h", 0, "t0")], "team string, rank int, id string")

    def memory(df):
        return df.filter("id in ('s1', 's2')").select("id", F.array(F.lit("seen")).alias("warnings"), (F.col("id") == "s1").alias("unresolved"))

    asked = []

    def attempt(df):
        asked.append({r.id for r in df.collect()})
        return df.select("id", F.when(F.col("id") == "s0", "CANDIDATE_REJECTED").when(F.col("id").isin("s2", "s4"), "PUBLISHED").when(F.col("id") == "s3", "CANDIDATE_REJECTED").otherwise("SYSTEM_ERROR").alias("outcome")).filter("id <> 't0'")

    got = {r.id: (r.state, r.outcome, r.warnings) for r in selection.Run(attempt, memory, wanted=2).over(candidates, "team", ["rank"]).collect()}
    assert got == {"s0": ("ATTEMPTED", "CANDIDATE_REJECTED", []), "s1": ("REMEMBERED", None, ["seen"]), "s2": ("ATTEMPTED", "PUBLISHED", ["seen"]), "s3": ("ATTEMPTED", "CANDIDATE_REJECTED", []), "s4": ("ATTEMPTED", "PUBLISHED", []), "s5": ("SKIPPED", None, []), "t0": ("ATTEMPTED", "SYSTEM_ERROR", [])}
    assert asked == [{"s0", "s2", "s3", "s4", "s5", "t0"}]
    plain = selection.Run(attempt, wanted=1).over(candidates, "team", ["rank"])
    assert {r.id for r in plain.filter("state = 'ATTEMPTED'").collect()} == {"s0", "s1", "t0"}
