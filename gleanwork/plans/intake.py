"""Queries over provider payloads, feed registries and the outcomes of runs.

Payloads are built from the pages and suppliers of the given tables, in the
shapes in which the providers answer, so that every branch meets rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import articles, outcomes, posts
from ..sources import landing, payloads
from .scalars import CANONICAL, HOST, claim_tokens_sql, read

C = F.col
SHOWN = "yyyy-MM-dd HH:mm:ss"
_DAY_SQL = "lpad((page_id % 28 + 1)::VARCHAR, 2, '0')"


def _day():
    return F.lpad((C("page_id") % 28 + 1).cast("string"), 2, "0")


def _every(n, column, other=None):
    """The column but for every n-th page, which has ``other``."""
    return F.when(C("page_id") % n == 0, F.lit(other)).otherwise(column)


def _every_sql(n: int, column: str, other: str = "NULL") -> str:
    return f"CASE WHEN page_id % {n} = 0 THEN {other} ELSE {column} END"


# -- provider payloads


def s02(s, d):
    hour = F.lpad((C("page_id") % 24).cast("string"), 2, "0")
    one = F.struct(
        _every(5, C("url"), " ").alias("url"), _every(7, F.concat(F.lit("Page "), "page_id"), "").alias("title"), F.concat(F.lit("202401"), _day(), F.lit("T"), hour, F.lit("3000Z")).alias("seendate"),
        _every(3, F.lit("Wire.example"), "").alias("domain"), F.lit("English").alias("language"),
    )
    payload = _every(11, F.to_json(F.struct(F.array(one, one.withField("title", F.concat(F.lit("Again "), "page_id")).withField("seendate", F.lit("soon"))).alias("articles"))), "")
    found = landing.gdelt_articles(read(s, d, "pages").select(payload.alias("payload")))
    return found.select("title", "url", "source_domain", F.date_format("published_at", SHOWN).alias("seen"), "language", "description")


_S02_ROWS = "(SELECT page_id, " + _every_sql(5, "url", "' '") + f""" AS url, unnest([{_every_sql(7, "'Page ' || page_id", "''")}, 'Again ' || page_id]) AS title, unnest(['2024-01-' || {_DAY_SQL} || ' ' || lpad((page_id % 24)::VARCHAR, 2, '0') || ':30:00', NULL]) AS seen,
 {_every_sql(3, "'Wire.example'", HOST)} AS source_domain FROM pages WHERE page_id % 11 <> 0)"""
S02 = f"SELECT title, url, source_domain, seen, 'English' AS language, NULL AS description FROM {_S02_ROWS} WHERE trim(url) <> '' AND title <> ''"


def s03(s, d):
    kind = F.when(C("page_id") % 2 == 0, "text").otherwise("news")
    body = F.concat(F.lit("Body "), "page_id")
    one = F.struct(
        F.when(kind == "text", _every(6, C("url"))).alias("href"), F.when(kind == "news", _every(9, C("url"))).alias("url"), _every(10, F.concat(F.lit(" Page "), "page_id"), " ").alias("title"), _every(4, body, "").alias("body"),
        F.lit("snippet").alias("snippet"), F.lit("excerpt").alias("excerpt"), F.lit("Agency").alias("source"), F.concat(F.lit("2024/01/"), _day()).alias("date"),
    )
    good, bad = payloads.ddgs_articles(read(s, d, "pages").select("page_id", kind.alias("k"), F.to_json(F.array(one)).alias("payload")), C("k"))
    rows = good.withColumn("state", F.lit("ARTICLE")).unionByName(bad.withColumn("state", F.lit("REJECT")))
    return rows.select("state", "kind", "title", "url", "description", "source_name", F.date_format("published_at", SHOWN).alias("published"))


S03 = f"""SELECT CASE WHEN url IS NULL OR title IS NULL THEN 'REJECT' ELSE 'ARTICLE' END AS state, kind, title, url, description, source_name, published FROM (SELECT CASE WHEN page_id % 2 = 0 THEN 'text' ELSE 'news' END AS kind,
 {_every_sql(10, "'Page ' || page_id")} AS title, CASE WHEN page_id % 2 = 0 THEN {_every_sql(6, "url")} ELSE {_every_sql(9, "url")} END AS url, {_every_sql(4, "'Body ' || page_id", "'snippet'")} AS description,
 CASE WHEN page_id % 2 = 1 THEN 'Agency' END AS source_name, CASE WHEN page_id % 2 = 1 THEN '2024-01-' || {_DAY_SQL} || ' 00:00:00' END AS published FROM pages)"""


def _tavily(s, d):
    one = F.struct(
        _every(8, C("url"), " ").alias("url"), _every(3, F.concat(F.lit("Page "), "page_id"), "").alias("title"), F.concat(F.lit("Short "), "page_id").alias("content"),
        _every(4, F.concat(F.lit("Long "), "page_id")).alias("raw_content"), (C("page_id") % 10 / 16).alias("score"), F.concat(F.lit("2024-01-"), _day()).alias("published_date"),
    )
    return read(s, d, "pages").select(F.to_json(F.struct(F.array(one).alias("results"))).alias("payload"))


def s04(s, d):
    return payloads.tavily_articles(_tavily(s, d)).select("title", "url", "canonical_url", "description", "snippet", "content", "score", "published_date")


def s05(s, d):
    return payloads.tavily_articles(_tavily(s, d), extract=True).select("title", "url", "content")


_TITLE = _every_sql(3, "'Page ' || page_id", "url")
S04 = f"SELECT {_TITLE} AS title, url, {CANONICAL} AS canonical_url, 'Short ' || page_id AS description, 'Short ' || page_id AS snippet, {_every_sql(4, chr(39) + 'Long ' + chr(39) + ' || page_id')} AS content, (page_id % 10) / 16.0::DOUBLE AS score, '2024-01-' || {_DAY_SQL} AS published_date FROM pages WHERE page_id % 8 <> 0"
S05 = f"SELECT {_TITLE} AS title, url, CASE WHEN page_id % 4 = 0 THEN 'Short ' || page_id ELSE 'Long ' || page_id END AS content FROM pages WHERE page_id % 8 <> 0"


def s07(s, d):
    key = C("s_suppkey")
    feeds = read(s, d, "supplier").select(
        F.when(key % 13 == 0, "same").when(key % 17 == 0, " ").otherwise(C("s_name")).alias("id"), F.concat(F.when(key % 5 == 0, "http").otherwise("https"), F.lit("://feeds.example/"), key).alias("url"),
        F.when(key % 7 == 0, "GOSSIP").otherwise("WORLD").alias("category"), (key % 6).alias("priority"), F.when(key % 11 != 0, key % 4 != 0).alias("active"), F.when(key % 19 == 0, "").otherwise("wire.example").alias("publisher_domain"),
    )
    active, rejects = landing.feed_registry(feeds, ["WORLD", "HEALTH"])
    shown = active.select("url", F.lit("ACTIVE").alias("state"), F.lit("").alias("reasons"))
    return shown.unionByName(rejects.select("url", F.lit("REJECT").alias("state"), F.array_join("reasons", ",").alias("reasons")))


S07 = """WITH f AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 13 = 0 THEN 'same' WHEN s_suppkey % 17 = 0 THEN ' ' ELSE s_name END AS id FROM supplier),
 r AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'http' ELSE 'https' END || '://feeds.example/' || k AS url, concat_ws(',', CASE WHEN id = ' ' THEN 'id' END, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'repeated id' END, CASE WHEN k % 5 = 0 THEN 'url' END,
 CASE WHEN k % 7 = 0 THEN 'category' END, CASE WHEN k % 6 = 0 THEN 'priority' END, CASE WHEN k % 11 = 0 THEN 'active' END, CASE WHEN k % 19 = 0 THEN 'publisher' END) AS reasons FROM f)
SELECT url, CASE WHEN reasons = '' THEN 'ACTIVE' ELSE 'REJECT' END AS state, reasons FROM r WHERE reasons <> '' OR k % 4 <> 0"""


# -- pages


def h02(s, d):
    """Pages with the metadata elements that the given ones lack."""
    metas = F.concat(
        F.when(C("page_id") % 4 == 0, F.concat(F.lit('<meta property="og:title" content="Shared '), "page_id", F.lit('">'))).otherwise(""), F.when(C("page_id") % 6 == 0, F.concat(F.lit('<meta name="twitter:title" content="Short '), "page_id", F.lit('">'))).otherwise(""),
        F.when(C("page_id") % 3 == 0, '<meta name="author" content="A. Writer">').when(C("page_id") % 3 == 1, '<meta property="article:author" content="The Desk">').otherwise(""),
        F.when(C("page_id") % 5 == 0, '<meta property="article:published_time" content="2024-01-05"><meta name="date" content="2023-12-31">').when(C("page_id") % 5 == 1, '<meta name="pubdate" content="2024-01-06">').when(C("page_id") % 5 == 2, '<meta name="publishdate" content="2024-01-07">').when(C("page_id") % 5 == 3, '<meta name="date" content="2024-01-08">').otherwise(""),
        F.when(C("page_id") % 7 == 0, F.concat(F.lit('<link rel="canonical" href="https://news.example/'), "page_id", F.lit('">'))).otherwise(""),
    )
    return articles.page_metadata(read(s, d, "pages").select("page_id", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), metas)).alias("html")))


_PLAIN_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _PLAIN_TITLE = f"replace({_PLAIN_TITLE}, '{_entity}', '{_sign}')"
H02 = f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Shared ' || page_id WHEN page_id % 6 = 0 THEN 'Short ' || page_id ELSE nullif(trim({_PLAIN_TITLE}), '') END AS title,
 CASE page_id % 3 WHEN 0 THEN 'A. Writer' WHEN 1 THEN 'The Desk' END AS author, CASE page_id % 5 WHEN 0 THEN '2024-01-05' WHEN 1 THEN '2024-01-06' WHEN 2 THEN '2024-01-07' WHEN 3 THEN '2024-01-08' END AS published,
 CASE WHEN page_id % 7 = 0 THEN 'https://news.example/' || page_id END AS canonical, nullif(regexp_extract(html, '(?i)<html[^>]*\\blang="([^"]*)"', 1), '') AS language FROM pages"""


def k08(s, d):
    """Every turn said twice, the second time behind another word."""
    said = read(s, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(". Also "), "text").alias("body"))
    return posts.repetitive_sentences(said, ["conv_id", "turn"])


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(trim(text || '. Also ' || text, ' ' || chr(10)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')"
_SHARED, _UNION = "len(list_intersect(a.t, b.t))", "len(list_distinct(list_concat(a.t, b.t)))"
K08 = f"""WITH s AS (SELECT conv_id, turn, unnest({_SENTENCES}) AS sentence, generate_subscripts({_SENTENCES}, 1) - 1 AS i FROM conversations), w AS (SELECT conv_id, turn, i, {claim_tokens_sql('sentence')} AS t FROM s)
SELECT a.conv_id, a.turn, a.i::INT AS first, b.i::INT AS second FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.i < b.i WHERE least(len(a.t), len(b.t)) > 0 AND {_SHARED} >= 0.7 * least(len(a.t), len(b.t)) AND {_SHARED} >= 0.4 * {_UNION}"""


# -- outcomes


def a19(s, d):
    third = C("user_id") % 3
    return outcomes.model_sets(read(s, d, "events").select("user_id", (F.when(third == 0, True).when(third == 2, C("event_id") % 2 == 0)).alias("ok")), "user_id", C("ok"))


_OK = "coalesce(CASE user_id % 3 WHEN 0 THEN true WHEN 2 THEN event_id % 2 = 0 END, false)"
A19 = f"SELECT user_id, successes, failures, CASE WHEN failures = 0 THEN 'SUCCESS' WHEN successes = 0 THEN 'FAILED' ELSE 'BOTH' END AS state FROM (SELECT user_id, count(*) FILTER ({_OK}) AS successes, count(*) FILTER (NOT {_OK}) AS failures FROM events WHERE user_id IS NOT NULL GROUP BY 1)"


def r17(s, d):
    e = read(s, d, "events")
    bad = F.when(C("event_id") % 3 == 0, F.concat(F.lit("timeout "), "event_id"))
    asked = e.select((C("user_id") * 100 + C("event_id") % 40).alias("query"), "event_id", C("event_type").alias("provider"), F.when(bad.isNull(), F.concat(F.lit("r"), "event_id")).alias("result"), bad.alias("error"))
    return outcomes.first_answers(asked, "query", "event_id", ["purchase", "click", "view"])


R17 = """WITH f AS (SELECT user_id * 100 + event_id % 40 AS query, event_type AS p, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS rank, min(event_id) AS e FROM events WHERE event_type IN ('purchase', 'click', 'view') GROUP BY ALL),
 w AS (SELECT query, min(rank) FILTER (e % 3 <> 0) AS won FROM f GROUP BY 1)
SELECT query, max(p) FILTER (rank = won) AS provider, max('r' || e) FILTER (rank = won) AS result, coalesce(string_agg(p || ': timeout ' || e, '; ' ORDER BY rank) FILTER (e % 3 = 0 AND rank < coalesce(won, 3)), '') AS errors, CASE WHEN won IS NULL THEN 'FAILED' ELSE 'ANSWERED' END AS state FROM f JOIN w USING (query) GROUP BY query, won"""


def j05(s, d):
    """Turns as posts, a third of them with one and the same text; every turn was reserved at a time near its own."""
    c = read(s, d, "conversations").select("conv_id", "turn", F.when(C("conv_id") % 3 == 0, F.concat(F.lit("same "), C("turn") % 4)).otherwise(C("text")).alias("text"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    made = c.select(F.when((C("conv_id") + C("turn")) % 9 != 0, F.concat("conv_id", F.lit(":"), "turn")).alias("external_id"), F.concat(F.lit("https://social.example/"), "conv_id").alias("url"), "text", (start + F.make_dt_interval(mins=(C("conv_id") * 7 + C("turn")).cast("int"))).alias("created_at"))
    asked = c.select("conv_id", "turn", "text", F.when(C("turn") % 5 != 4, start + F.make_dt_interval(mins=(C("conv_id") * 7 + C("turn") * (1 + C("conv_id") % 2)).cast("int"))).alias("started_at"))
    return outcomes.reconciled(asked, made, ["conv_id", "turn"]).select("conv_id", "turn", "state", "external_id", "url", F.date_format("published_at", SHOWN).alias("published"))


J05 = """WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'same ' || turn % 4 ELSE text END AS text FROM conversations),
 p AS (SELECT conv_id || ':' || turn AS external_id, 'https://social.example/' || conv_id AS url, text, conv_id * 7 + turn AS moment FROM c WHERE (conv_id + turn) % 9 <> 0),
 a AS (SELECT conv_id, turn, text, CASE WHEN turn % 5 <> 4 THEN conv_id * 7 + turn * (1 + conv_id % 2) END AS moment FROM c),
 m AS (SELECT a.conv_id, a.turn, a.moment, count(p.external_id) AS n, max(p.external_id) AS external_id, max(p.url) AS url, max(p.moment) AS published FROM a LEFT JOIN p ON a.text = p.text AND p.moment >= a.moment GROUP BY a.conv_id, a.turn, a.moment)
SELECT conv_id, turn, CASE WHEN moment IS NULL THEN 'INVALID' WHEN n > 1 THEN 'AMBIGUOUS' WHEN n = 1 THEN 'MATCH' ELSE 'NONE' END AS state, CASE WHEN n = 1 THEN external_id END AS external_id, CASE WHEN n = 1 THEN url END AS url,
 CASE WHEN n = 1 THEN strftime(TIMESTAMP '2024-01-01' + to_minutes(published), '%Y-%m-%d %H:%M:%S') END AS published FROM m"""


def r13(s, d):
    return outcomes.paged(read(s, d, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], page_size=5, limit=12, max_pages=2).select("event_id", "pos", "page")


R13 = "SELECT event_id, pos::INT AS pos, (pos - 1) // 5 AS page FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) WHERE pos <= least(12, 2 * 5)"


def _publications(s, d):
    return read(s, d, "events").select(C("event_type").alias("platform"), C("ts").alias("published_at"), F.element_at(F.array(F.lit("PUBLISHED"), F.lit("published"), F.lit("FAILED")), (C("event_id") % 3 + 1).cast("int")).alias("status"))


def a04(s, d):
    return outcomes.last_published(_publications(s, d), ["platform"])


def d10(s, d):
    return outcomes.published_since_day(_publications(s, d), ["platform"], F.lit("2024-01-20 17:45:00").cast("timestamp"))


A04 = "SELECT event_type AS platform, max(ts) AS last_published_at FROM events WHERE event_id % 3 <> 2 GROUP BY 1"
D10 = "SELECT event_type AS platform, count(*) AS published_today FROM events WHERE event_id % 3 <> 2 AND ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1"


def u02(s, d):
    links = read(s, d, "lineitem").filter("l_returnflag = 'R'").select(C("l_orderkey").alias("o_orderkey"))
    return outcomes.unlinked(read(s, d, "orders").select("o_orderkey"), links, "o_orderkey")


def _lists(s, d):
    flag = F.collect_list
    return read(s, d, "lineitem").groupBy("l_orderkey").agg(flag(F.when(C("l_linenumber") % 2 == 0, C("l_returnflag"))).alias("mapped"), flag(F.when(C("l_linenumber") % 2 == 1, C("l_returnflag"))).alias("posted"), F.max(F.when(C("l_linenumber") == 7, F.array(F.lit(""), F.lit("Z")))).alias("more"))


def u05(s, d):
    return _lists(s, d).select("l_orderkey", outcomes.same_members(C("mapped"), C("posted")).alias("equal"), outcomes.same_members(C("more"), F.array(F.lit("Z"), F.lit(""), F.lit("Z"))).alias("seven"))


def u06(s, d):
    return _lists(s, d).select("l_orderkey", F.array_join(outcomes.all_members(C("mapped"), C("posted"), C("more")), ",").alias("members"))


U02 = "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'"
_SIDE = "coalesce(list_sort(list(DISTINCT l_returnflag) FILTER (l_linenumber % 2 = {k})), [])"
U05 = f"SELECT l_orderkey, {_SIDE.format(k=0)} = {_SIDE.format(k=1)} AS equal, bool_or(l_linenumber = 7) AS seven FROM lineitem GROUP BY 1"
U06 = "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) || CASE WHEN bool_or(l_linenumber = 7) THEN ',Z' ELSE '' END AS members FROM lineitem GROUP BY 1"

def j02(s, d):
    """Lines with the whole nation table as sources; most name none of them."""
    known = read(s, d, "nation").select(C("n_nationkey").cast("long").alias("l_suppkey"), "n_name")
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(known, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "n_name")


QUERIES = {
    "s02_gdelt_landing": (s02, S02),
    "s03_ddgs_landing": (s03, S03),
    "s04_tavily_search": (s04, S04),
    "s05_tavily_extract": (s05, S05),
    "s07_feed_registry": (s07, S07),
    "h02_full_metadata": (h02, H02),
    "k08_repetitive_pairs": (k08, K08),
    "a19_model_sets": (a19, A19),
    "r17_first_answers": (r17, R17),
    "j05_reconciled": (j05, J05),
    "r13_page_caps": (r13, R13),
    "a04_last_published": (a04, A04),
    "d10_day_start": (d10, D10),
    "j02_item_with_source": (j02, "SELECT l_orderkey, l_linenumber, n_name FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey"),
    "u02_unlinked": (u02, U02),
    "u05_same_members": (u05, U05),
    "u06_all_members": (u06, U06),
}
