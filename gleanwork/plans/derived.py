"""Newsroom tables derived from the star schema, for Spark and as SQL from one specification.

Parts stand for wire articles, orders for stories, their lines for claims and
evidence.  Words are picked by key from the lists below, so that every rule of
the taxonomy and of the gates meets rows that it accepts and rejects; the rows
grow with the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .scalars import read

TITLES = [
    "Hostilities end along the front line as truce is signed", "Startup launches a generative AI assistant for clinics", "Central bank decides to hold its inflation target", "Opinion: what the election means for voters", "Sponsored: shopping deals of the whole week",
    "Chess Tournaments: results from the hall", "Best kettles and toasters to buy before winter", "Climate summit ends as emissions report released", "Too short", "World News - all day", "Nvidia launches a new chip for the cloud", "Clinical trial of a vaccine raises hopes",
    "Company filed for bankruptcy after layoffs", "Major investment in renewable energy approved", "Scientists discover a quantum research result", "Football team wins the championship title", "A quiet day at the lake with nothing at all", "International summit signs a global treaty",
    "Celebrity gossip of the weekend in pictures", "Public health emergency declared as outbreak grows", "Parliament passes new legislation on banks", "Top World News", "Merger of two telecom firms approved", "Guide to the museums of the old town",
]
BODIES = [
    "The decision was announced on Monday, officials said. It follows a long debate in parliament.", "Short text.", None, "Researchers found that machine learning helps hospitals. The clinical trial ran for 12 months. More research is planned, according to the team.",
    "Prices rose by 4 percent in March. The central bank expects inflation to fall. Analysts in London had forecast less.", "Nothing of note happened. People walked along the shore and the weather was fine the whole day.", "",
]
URLS = ["https://www.Site{}.org/2024-01-15/story-", "http://news.site.com/world/", "https://apps.apple.com/app/", "https://news.google.com/rss/articles/CBMiX", "ftp://files.site.net/", None, "https://news.google.com/topics/", "https://m.paper.net/news", "https://desk.paper.net/politics/a-"]
CLAIMS = ["The ministry approved the new budget.", "Officials reported 12 deaths after the storm", "Two banks agreed to merge in April.", "The city expects fewer visitors. Hotels disagree.", "The factory closed its doors on Friday.", "Analysts cited policies of the central bank.", "Ships carried grain through the strait.", "A court ruled against the company!"]
EXTRA = ["", " https://www.pub1.org/a/1", " Source: the desk", " Please return json now.", " Nobody ever claimed such a thing here.", " Yes.", " See https://www.pub3.org/a/3 and https://other.org/x", " The ministry approved the new budget.", " Hidden\0mark"]
NAMES = ["AI", "artificial-intelligence", "US Politics", "Markets", "Healthcare", "paint", "celebrity", "Sports", "tv schedules", "World News", "unknown thing", "FINANCE", "climate_environment", "who", "", None, "Space", "ceasefire news"]
LINES_AT_ONCE = 250_000
STATUSES = ["PUBLISHED", "approved", "blocked", "dry_run", "Publishing", "unknown", "recovery_required", "nonsense", "draft", None]



def pick(values: list[str | None], key: str, duck: bool) -> str:
    """SQL for the value that a key picks, in either dialect."""
    items = ", ".join("CAST(NULL AS STRING)" if v is None and not duck else "NULL" if v is None else _quoted(v, duck) for v in values)
    return f"list_extract([{items}], (({key}) % {len(values)} + 1)::INT)" if duck else f"element_at(array({items}), CAST(({key}) % {len(values)} + 1 AS INT))"


def _quoted(value: str, duck: bool) -> str:
    parts = value.split("\0")
    shown = ["'" + (p if duck else p.replace("\\", "\\\\")).replace("'", "''" if duck else "\\'") + "'" for p in parts]
    return f" || {'chr(0)' if duck else 'char(0)'} || ".join(shown)


def over(key: str, n: int, duck: bool) -> str:
    return f"({key} // {n})" if duck else f"({key} div {n})"


def text_of(number: str, duck: bool) -> str:
    return f"CAST({number} AS {'VARCHAR' if duck else 'STRING'})"


def days_before(days: str, duck: bool, moment: str = "2024-01-20 00:00:00") -> str:
    return f"(TIMESTAMP '{moment}' - to_days(({days})::INT))" if duck else f"timestampadd(DAY, -CAST({days} AS INT), TIMESTAMP '{moment}')"


def strings(items: list[str], duck: bool) -> str:
    return "[" + ", ".join(items) + "]" if duck else "array(" + ", ".join(items) + ")"


def none(duck: bool) -> str:
    return "CAST([] AS VARCHAR[])" if duck else "CAST(array() AS array<string>)"


def wire(duck: bool) -> dict[str, str]:
    """Articles from parts."""
    k = "p_partkey"
    base = pick([u and u.replace("{}", "") for u in URLS], over(k, 24, duck), duck)
    return {
        "id": k,
        "title": pick(TITLES, k, duck),
        "body": pick(BODIES, over(k, 3, duck), duck),
        "url": f"{base} || {text_of(k, duck)}",
        "provider": pick(["rss", "google_news", "ddgs"], over(k, 5, duck), duck),
        "source_name": pick(["Google News", "The Daily Desk", None, "https://news.google.com/x", "GDELT", ""], over(k, 2, duck), duck),
        "source_domain": pick(["www.paper.net", None, "news.google.com", "desk.org"], over(k, 7, duck), duck),
        "publisher": pick([None, "Morning Paper", "", None, "google news rss"], over(k, 11, duck), duck),
        "published_at": f"CASE WHEN {k} % 13 = 0 THEN NULL ELSE {days_before('p_size - 2', duck)} END",
        "topic_fit": f"CASE WHEN {k} % 4 = 0 THEN NULL ELSE {k} % 5 <> 0 END",
        "newsworthiness": f"CASE WHEN {k} % 6 = 0 THEN NULL ELSE {k} % 7 <> 0 END",
        "raw_category": pick(NAMES, k, duck),
        "other_category": pick(NAMES, over(k, 18, duck), duck),
        "status": pick(STATUSES, k, duck),
    }


def claims(duck: bool) -> dict[str, str]:
    return {
        "story_id": "l_orderkey",
        "claim_id": f"'c' || {text_of('l_linenumber', duck)}",
        "claim_text": pick(CLAIMS, "p", duck),
        "evidence_ids": f"CASE WHEN l_linenumber % 5 = 0 THEN {none(duck)} ELSE {strings([chr(39) + 'e' + chr(39) + ' || ' + text_of('s', duck), chr(39) + 'e' + chr(39) + ' || ' + text_of('s + p % 2', duck)], duck)} END",
        "is_forecast": "p % 7 = 0", "is_allegation": "p % 11 = 0", "is_opinion": "p % 13 = 0",
        "attribution": pick(["the Finance Ministry", "", None, "aides"], "p", duck),
        "uncertainty": pick(["", "unclear"], "s", duck),
    }


LINES = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS f, min(l_shipdate) AS seen FROM lineitem GROUP BY l_orderkey, l_linenumber"
SOURCES = "SELECT l_orderkey, l_suppkey AS s, min(l_shipdate) AS seen FROM lineitem GROUP BY l_orderkey, l_suppkey"
KINDS = "SELECT l_orderkey, l_suppkey % 20 AS k FROM lineitem GROUP BY l_orderkey, l_suppkey % 20"
FIRST = "SELECT l_orderkey, min(l_linenumber) AS n, min_by(p, l_linenumber) AS p, {ids} AS every FROM (" + LINES + ") GROUP BY l_orderkey"


def evidence(duck: bool) -> dict[str, str]:
    url = pick(["https://www.pub{}.org/a/", "http://news.google.com/x", "https://example.com/y", "https://Pub.net/z", None], "s", duck)
    return {"story_id": "l_orderkey", "evidence_id": f"'e' || {text_of('s', duck)}", "source_id": f"'s' || {text_of('s % 20', duck)}", "url": f"CASE WHEN s % 5 = 0 THEN 'https://www.pub' || {text_of('s % 8', duck)} || '.org/a/' || {text_of('s', duck)} ELSE {url} END", "pos": "s", "published_at": "seen"}


def verifications(duck: bool) -> dict[str, str]:
    own = strings([f"'e' || {text_of('s', duck)}"], duck)
    return {"story_id": "l_orderkey", "claim_id": f"'c' || {text_of('l_linenumber', duck)}", "status": "CASE f WHEN 'A' THEN 'SUPPORTED' WHEN 'R' THEN 'supported_as_attributed' ELSE 'CONTRADICTED' END", "evidence_ids": f"CASE WHEN s % 3 = 0 THEN {none(duck)} ELSE {own} END"}


def assessments(duck: bool) -> dict[str, str]:
    return {"story_id": "l_orderkey", "source_id": f"'s' || {text_of('k', duck)}", "source_type": pick(["PRIMARY", "secondary", "AGGREGATOR", "UNKNOWN", "OPINION", None, "Official"], "k", duck)}


def posts(duck: bool) -> dict[str, str]:
    one = f"'c' || {text_of('n', duck)}"
    return {
        "story_id": "l_orderkey",
        "post": f"CASE WHEN l_orderkey % 17 = 0 THEN '' ELSE {pick(CLAIMS, 'p', duck)} || {pick(EXTRA, 'l_orderkey', duck)} END",
        "claim_ids": f"CASE WHEN l_orderkey % 5 = 0 THEN {none(duck)} WHEN l_orderkey % 7 = 0 THEN {strings([one, chr(39) + 'c99' + chr(39)], duck)} ELSE {strings([one], duck)} END",
        "draft_claim_ids": f"CASE WHEN l_orderkey % 4 = 0 THEN {none(duck)} ELSE every END",
        "allowed_claim_ids": f"CASE WHEN l_orderkey % 3 = 0 THEN every ELSE {strings([one], duck)} END",
        "seed_title": pick(CLAIMS, over("l_orderkey", 3, duck), duck),
        "seed_summary": pick(["", "ministry and banks", None], "l_orderkey", duck),
    }


SPECS = {"wire": (wire, "part", "part"), "claims": (claims, f"({LINES})", f"({LINES})"), "evidence": (evidence, f"({SOURCES})", f"({SOURCES})"), "verifications": (verifications, f"({LINES})", f"({LINES})"), "assessments": (assessments, f"({KINDS})", f"({KINDS})")}
_IDS = {True: "list_sort(list('c' || l_linenumber))", False: "sort_array(collect_list('c' || CAST(l_linenumber AS STRING)))"}
SPECS["posts"] = (posts, f"({FIRST.replace('{ids}', _IDS[False])})", f"({FIRST.replace('{ids}', _IDS[True]).replace('min_by(', 'arg_min(')})")


def sql(name: str) -> str:
    """The derived table as a DuckDB subquery."""
    spec, _, source = SPECS[name]
    return "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in spec(True).items()) + f" FROM {source})"


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all tasks: a table of few bytes and many rows is one file and so one task, whatever is computed for each row."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def parts_of_lines(spark: SparkSession, d: str) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-read(spark, d, "lineitem").count() // LINES_AT_ONCE))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    spec, source, _ = SPECS[name]
    # Lines are dealt by story once: all groups and joins by story then need no further shuffle.  So that a task's
    # rows are as many whatever the table's size, their number says into how many parts.
    if "FROM lineitem " in source:
        source = source.replace("FROM lineitem ", f"FROM (SELECT /*+ REPARTITION({parts_of_lines(spark, d)}, l_orderkey) */ * FROM parquet.`{d}/lineitem.parquet`) ")
    rows = spread(read(spark, d, "part"), "p_partkey") if source == "part" else spark.sql(f"SELECT * FROM {source}")
    return rows.selectExpr(*[f"{e} AS {n}" for n, e in spec(False).items()])
