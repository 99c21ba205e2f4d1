"""Search: terms, conditions that reach the scan, orders and limits."""

import pytest
from pyspark.sql import functions as F

from gleanwork.operators.search import Search, span_minutes, terms_of


@pytest.fixture(scope="module")
def articles(spark):
    rows = [
        (1, "Port strike ends", "The strike at the port is over.", "en", "NO", "2024-01-05 10:00:00", "https://www.coast.org/a", ["Labour", "ports"]),
        (2, "Harbour news", "A port strike, a strike of dockers.", "en", "DK", "2024-01-06 10:00:00", "https://blog.coast.org/b", ["ports"]),
        (3, "Strikes and ports", "Portstrike is one word here.", "en", "NO", "2024-01-07 10:00:00", "https://other.net/c", None),
        (4, None, "port\nstrike", "fr", None, None, None, []),
        (5, "PORT STRIKE", None, "en", "NO", "2024-01-07 10:00:00", "https://notcoast.org/d", [" PORTS "]),
    ]
    df = spark.createDataFrame(rows, "id long, title string, text string, language string, country string, at string, url string, tags array<string>")
    return df.withColumn("published_at", F.to_timestamp("at"))


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    ("wanted", "expected"),
    [
        (Search("port strike"), [5, 2, 1, 4]),
        (Search("port strike", order="TOP"), [1, 5, 2, 4]),
        (Search('"port strike"'), [5, 2, 1, 4]),
        (Search('"strike port"'), []),
        (Search("strike", order="TOP", limit=2), [1, 5]),
        (Search(language="en", country="NO"), [3, 5, 1]),
        (Search(since="2024-01-06 00:00:00", until="2024-01-07 10:00:00"), [2]),
        (Search(span="24h", as_of="2024-01-07 10:00:00"), [3, 5, 2]),
        (Search(include_domains=("Coast.org",)), [2, 1]),
        (Search(include_domains=("coast.org",), exclude_domains=("blog.coast.org",)), [1]),
        (Search(exclude_domains=("www.coast.org",)), [3, 5, 4]),
        (Search(tag="#Ports"), [5, 2, 1]),
        (Search("(port) *strike*"), []),
        (Search(limit=0), []),
        (Search(), [3, 5, 2, 1, 4]),
    ],
)
def test_searches(articles, wanted, expected):
    assert ids(wanted.run(articles)) == expected


def test_conditions_reach_the_scan(articles, tmp_path, spark):
    articles.write.parquet(f"{tmp_path}/a")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = Search("port", language="en", country="NO", since="2024-01-06 00:00:00", limit=3, order="TOP").run(spark.read.parquet(f"{tmp_path}/a"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(line for line in plan.split("\n") if "PushedFilters" in line)
    assert "EqualTo(language,en)" in pushed and "EqualTo(country,NO)" in pushed and "GreaterThanOrEqual(published_at" in pushed
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_texts_of_queries():
    assert terms_of('Port "Night  Shift" port "" a"b') == ["port", "night shift", 'a"b']
    assert (span_minutes("90min"), span_minutes(" 2 d "), span_minutes("1w")) == (90, 2880, 10080)
    for wrong in (lambda: span_minutes("soon"), lambda: Search(order="BEST"), lambda: Search(span="2h"), lambda: Search(limit=-1)):
        with pytest.raises(ValueError):
            wrong()
