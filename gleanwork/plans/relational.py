"""Queries over gates, joins, dedup, roll-ups, ranking, sets and maintenance.

The star schema stands in for the newsroom's tables: orders are stories,
lineitem links them to part (articles) and supplier (sources), events are
publications and logs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, taxonomy, text, urls
from ..operators import clustering, dedup, gates, html, search, similar, tables
from . import derived
from .scalars import CANONICAL, CLEAN, HOST, SIGNALS, SIGNATURE, TITLED, as_of, categories_sql, read, titled

C = F.col
MOMENT = "TIMESTAMP '2024-01-20 00:00:00'"


def articles(s, d):
    """documents joined to pages by id as articles; publication times come from events of the same id."""
    doc = titled(s, d).select(C("doc_id").alias("id"), "title", "text", "lang", "source")
    page = read(s, d, "pages").select(C("page_id").alias("id"), "url")
    event = read(s, d, "events").select(C("event_id").alias("id"), C("ts").alias("published_at"))
    return doc.join(page, "id").join(event, "id", "left")


ARTICLES = f"(SELECT t.doc_id AS id, t.title, t.text, t.lang, t.source, p.url, e.ts AS published_at FROM {TITLED} t JOIN pages p ON p.page_id = t.doc_id LEFT JOIN events e ON e.event_id = t.doc_id)"


def f01(s, d):
    return articles(s, d).filter(gates.valid_article(C("url"), C("title"))).select("id")


def f02(s, d):
    reason = gates.reject_reason(C("url"), C("title"), C("text"), C("published_at"), as_of(), signals=SIGNALS, max_age_days=15)
    return articles(s, d).select("id", reason.alias("reason"))


_NEWS = "(?:^|[^\\p{L}\\p{N}_])(?:opinion|guide|interview|explainer|editorial)(?:$|[^\\p{L}\\p{N}_])"
_EVENT = "(?:^|[^\\p{L}\\p{N}_])" + taxonomy.DEVELOPMENT[2:-2] + "(?:$|[^\\p{L}\\p{N}_])"
F02 = f"""SELECT id, CASE WHEN trim(url) = '' OR trim(title) = '' THEN 'INSUFFICIENT_METADATA'
 WHEN regexp_matches(lower(url), 'download') THEN 'PORTAL_PAGE'
 WHEN length(trim(title)) < 15 THEN 'INSUFFICIENT_METADATA'
 WHEN regexp_matches(lower(title), '{_NEWS}') THEN 'OPINION_CONTENT'
 WHEN length(trim(text)) < 40 THEN 'INSUFFICIENT_METADATA'
 WHEN len({categories_sql("trim(title) || ' ' || trim(text)")}) = 0 THEN 'OUT_OF_SCOPE'
 WHEN NOT regexp_matches(lower(trim(title) || ' ' || trim(text)), '{_EVENT}') THEN 'NOT_NEWSWORTHY'
 WHEN published_at IS NULL OR published_at > {MOMENT} + INTERVAL 1 DAY THEN 'INSUFFICIENT_METADATA'
 WHEN published_at < {MOMENT} - INTERVAL 15 DAY THEN 'STALE_ARTICLE' END AS reason FROM {ARTICLES}"""


def f04(s, d):
    return read(s, d, "orders").filter(F.lower("o_orderstatus").isin("o", "p")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def f05(s, d):
    return read(s, d, "events").filter(C("ts").isNull() | (C("ts") >= as_of() - F.expr("interval 48 hours"))).select("event_id")


def f06(s, d):
    return read(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("sources")).filter("sources >= 5")


def f07(s, d):
    return titled(s, d).filter(F.arrays_overlap(F.split(F.lower("title"), r"\s+"), F.array(F.lit("the"), F.lit("les")))).select("doc_id")


def f08(s, d):
    links = read(s, d, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_suppkey").alias("publishers"))
    return read(s, d, "orders").join(links, "o_orderkey").filter("o_orderstatus <> 'F' and publishers >= 3 and o_orderdate >= '1996-01-01'").select("o_orderkey", "publishers")


def f09(s, d):
    return gates.complete_groups(read(s, d, "lineitem"), "l_orderkey", C("l_discount") < 0.09)


def f17(s, d):
    turns = read(s, d, "conversations")
    first = turns.filter("turn = 0").select("conv_id", C("text").alias("seed"))
    return turns.filter("turn > 0").join(first, "conv_id").select("conv_id", "turn", gates.subject_survives(C("seed"), C("text")).alias("survives"))


def f26(s, d):
    return read(s, d, "documents").filter((C("lang") == "fr") & C("n_chars").between(500, 3000)).select("doc_id")


def f27(s, d):
    return read(s, d, "pages").filter(urls.host(C("url")).rlike(r"(^|\.)example\.org$") & ~urls.host(C("url")).startswith("blog.")).select("page_id")


def f28(s, d):
    hits = read(s, d, "conversations").filter((C("role") == "user") & C("text").contains("the "))
    return hits.orderBy(F.desc("conv_id"), F.desc("turn")).limit(50).select("conv_id", "turn")


def f20(s, d):
    l = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("domains"), F.bool_and(C("l_discount") <= 0.1).alias("supported"), F.max("l_shipdate").alias("seen"))
    rules = {"domains": C("domains") >= 2, "supported": C("supported"), "fresh": C("seen") >= F.to_timestamp(F.lit("1998-01-01"))}
    failed = F.filter(F.array(*[F.when(~ok, name) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return l.select("l_orderkey", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("eligible"))


def j01(s, d):
    link = read(s, d, "lineitem").select(C("l_orderkey").alias("o_orderkey"), C("l_partkey").alias("p_partkey"))
    joined = read(s, d, "orders").select("o_orderkey", "o_orderpriority").join(link, "o_orderkey").join(read(s, d, "part").select("p_partkey", "p_type"), "p_partkey")
    return joined.groupBy("o_orderpriority", "p_type").agg(F.count("*").alias("items"))


def j02(s, d):
    known = read(s, d, "supplier").filter("s_nationkey < 20").select(C("s_suppkey").alias("l_suppkey"), "s_name")
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(known, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "s_name")


def j04(s, d):
    live = read(s, d, "lineitem").withColumn("rank", F.when(C("l_returnflag") == "A", 0).when(C("l_returnflag") == "R", 1).otherwise(2))
    best = live.groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_returnflag", F.struct("rank", "l_linenumber")).alias("best"))
    return read(s, d, "orders").join(best.filter("best = 'A'"), "o_orderkey", "left_anti").select("o_orderkey")


def j05(s, d):
    c = read(s, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    ask, answer = c.filter("turn % 2 = 0"), c.select("h", C("conv_id").alias("other"), C("turn").alias("at"))
    found = ask.join(answer, (ask["h"] == answer["h"]) & (answer["at"] >= ask["turn"]) & ((answer["other"] != ask["conv_id"]) | (answer["at"] != ask["turn"])), "left")
    n = F.count("other")
    return found.groupBy("conv_id", "turn").agg(F.when(n == 0, "NONE").when(n == 1, "MATCH").otherwise("AMBIGUOUS").alias("state"))


def _alike(s, d, top=None):
    """Every row whose id 100 divides against all other rows."""
    t = titled(s, d)
    return similar.similar_titles(t.filter("doc_id % 100 = 0"), t, "doc_id", "doc_id", C("title"), C("title"), 0.20, top=top).filter("query_id <> recent_id")


def j06(s, d):
    return _alike(s, d)


_SW = "list_distinct(list_transform(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: length(w) > 2), lambda w: trim(lower(w), '.,;:!?\"''()[]{}—–-')))"
J06 = f"""WITH t AS (SELECT doc_id, {_SW} AS w FROM {TITLED}), q AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM t WHERE doc_id % 100 = 0), r AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM t),
 x AS (SELECT q.doc_id AS query_id, r.doc_id AS recent_id, count(*)::DOUBLE / (any_value(q.n) + any_value(r.n) - count(*)) AS score FROM q JOIN r ON q.word = r.word AND q.doc_id <> r.doc_id GROUP BY ALL)"""


def r10(s, d):
    # A row is among its own most similar ones, so one more than the five is asked for.
    return similar.top_similar(_alike(s, d, 6)).select("query_id", "recent_id", "rank")


def j09(s, d):
    claims = read(s, d, "benchmark").select(C("item_id").alias("claim_id"), C("text").alias("claim"))
    parts = claims.select("claim_id", F.posexplode(text.sentences(C("claim"))).alias("pos", "sentence"))
    return similar.grounded(parts.select(F.concat_ws("-", "claim_id", "pos").alias("sentence_id"), "sentence"), claims)


def j10(s, d):
    docs, items = read(s, d, "documents").select("doc_id", "text"), read(s, d, "benchmark")
    return similar.share_ngram(docs, items, C("text"), 6, C("text")).select("doc_id")


def j11(s, d):
    return read(s, d, "nation").join(read(s, d, "region"), C("n_regionkey") == C("r_regionkey"), "left").select("n_name", "r_name")


def j13(s, d):
    return read(s, d, "orders").join(read(s, d, "lineitem").select(C("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


def j14(s, d):
    junk = read(s, d, "part").filter("p_size <= 5").select(C("p_partkey").alias("l_partkey"))
    return read(s, d, "lineitem").join(junk, "l_partkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("links"))


def j12(s, d):
    return read(s, d, "orders").join(read(s, d, "customer").select(C("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left").groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))


def j19(s, d):
    c = read(s, d, "conversations")
    replies = c.filter("turn > 0")
    return c.filter("turn = 0").select("conv_id").join(replies, "conv_id", "left").groupBy("conv_id").agg(F.count("turn").alias("replies"), F.count_if(C("turn") == 1).alias("direct"))


def k01(s, d):
    a = articles(s, d).select("id", urls.canonicalize_url(C("url")).alias("canonical_url"), text.content_hash(C("text")).alias("content_hash"), text.title_signature(C("title")).alias("signature"))
    return dedup.greedy_first_seen(a, ["canonical_url", "content_hash", "signature"], "id").select("id")


def k02(s, d):
    p = read(s, d, "pages").select("page_id", urls.host(C("url")).alias("host"), urls.canonicalize_url(C("url")).alias("c"))
    return dedup.first_seen(p, ["host", "c"], ["page_id"]).select("page_id")


def k03(s, d):
    p = read(s, d, "pages").select("page_id", (C("page_id") % 3).alias("provider"), urls.path(C("url")).alias("key"))
    return dedup.first_seen(p, ["key"], ["provider", "page_id"]).select("page_id")


def k04(s, d):
    return dedup.first_seen(read(s, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


def k05(s, d):
    p = read(s, d, "pages").select("page_id", urls.host(C("url")).alias("host"))
    return dedup.capped(p, ["host"], ["page_id"], 5).select("page_id", "pos")


def k06(s, d):
    a = titled(s, d).select(C("doc_id").alias("item_id"), "title", "lang", F.array("lang").alias("categories"), C("source").alias("publisher"))
    dated = a.join(read(s, d, "events").select(C("event_id").alias("item_id"), C("ts").alias("published_at")), "item_id", "left")
    return clustering.cluster_stories(dated, ["lang"])


def a05(s, d):
    a = titled(s, d).select(C("doc_id").alias("item_id"), C("source").alias("story_id"), "title", F.array("lang").alias("categories"), C("lang").alias("publisher"))
    r = clustering.roll_up(a.join(read(s, d, "events").select(C("event_id").alias("item_id"), C("ts").alias("published_at")), "item_id"))
    return r.select("story_id", "title", "first_seen_at", "last_seen_at", F.array_join("publishers", ",").alias("publishers"), F.array_join("categories", ",").alias("categories"), "item_count")


def k07(s, d):
    return articles(s, d).select("id", clustering.story_key(C("title"), C("published_at"), F.array("lang")).alias("story_key"))


def h02(s, d):
    return read(s, d, "pages").select("page_id", html.title(C("html")).alias("title"), html.language(C("html")).alias("language"))


def h05(s, d):
    return html.extract_text(read(s, d, "pages").select("page_id", "html"))


def h09(s, d):
    return h05(s, d).groupBy("method").agg(F.count("*").alias("pages"))


def a01(s, d):
    return read(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("sources"), F.countDistinct("l_suppkey").alias("publishers"))


def a02(s, d):
    return read(s, d, "documents").select(F.explode(F.array("lang", "source")).alias("c")).groupBy(F.upper(F.trim("c")).alias("category")).agg(F.count("*").alias("n"))


def a03(s, d):
    return read(s, d, "events").filter(F.date_trunc("day", "ts") == F.to_timestamp(F.lit("2024-01-03"))).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def a07(s, d):
    return f02(s, d).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def a08(s, d):
    judged = f02(s, d).join(articles(s, d).select("id", "lang"), "id")
    return judged.groupBy(F.coalesce("lang", F.lit("UNCATEGORIZED")).alias("category")).agg(F.count_if(C("reason").isNull()).alias("accepted"), F.count_if(C("reason").isNotNull()).alias("rejected"))


def a10(s, d):
    return read(s, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.count(F.lit(1))).na.fill(0).select("user_id", C("click").alias("clicks"), C("purchase").alias("purchases"), C("view").alias("views"))


def a11(s, d):
    names = ["customer", "documents", "events", "lineitem", "orders", "pages"]
    out = None
    for name in names:
        part = read(s, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.union(part)
    return out


def a14(s, d):
    # A supplier counts where it comes first, so what a story collects is its distinct suppliers.
    one = read(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("place"), F.min("l_shipdate").alias("first"), F.count("*").alias("n"))
    suppliers = F.transform(F.array_sort(F.collect_list(F.struct("place", "l_suppkey"))), lambda x: x["l_suppkey"])
    return one.groupBy("l_orderkey").agg(F.array_join(suppliers, ",").alias("suppliers"), F.min("first").alias("first"), F.sum("n").alias("n"))


def dated_documents(s, d):
    """documents as articles with times of events of the same id; those without an event have none."""
    event = read(s, d, "events").select(C("event_id").alias("doc_id"), C("ts").alias("published_at"))
    return titled(s, d).select("doc_id", "title", "text", "lang", "source").join(event, "doc_id", "left")


DATED = f"(SELECT t.doc_id, t.title, t.text, t.lang, t.source, e.ts AS published_at FROM {TITLED} t LEFT JOIN events e ON e.event_id = t.doc_id)"
_NAMES = {"id": "doc_id", "language": "lang"}


def f26_span(s, d):
    return search.Search(language="en", span="36h", as_of="2024-01-03 12:00:00", columns=_NAMES).run(dated_documents(s, d)).select("doc_id")


def f27_search(s, d):
    wanted = search.Search(include_domains=("example.org", "example.com"), exclude_domains=("blog.example.org", "shop.example.com"), columns={"id": "page_id", "text": "html", "title": "url", "published_at": "page_id"})
    return wanted.run(read(s, d, "pages")).select("page_id")


def f28_top(s, d):
    return search.Search(text='the "of the" is', order="TOP", limit=40, columns=_NAMES).run(dated_documents(s, d)).select("doc_id", "score")


def f28_tag(s, d):
    tagged = dated_documents(s, d).withColumn("tags", F.array("source", F.concat(F.lit("lang "), "lang")))
    return search.Search(tag="#SRC3", since="2024-01-01 06:00:00", until="2024-01-02 18:00:00", columns=_NAMES).run(tagged).select("doc_id")


def _has(term):
    return lambda c: f"regexp_matches(lower({c}), '(?:^|[^\\p{{L}}\\p{{N}}_]){term}(?:[^\\p{{L}}\\p{{N}}_]|$)')"


_TERMS = [_has("the"), _has("of\\s+the"), _has("is")]
_SCORE = " + ".join(f"CASE WHEN {t('title')} THEN 2 ELSE 0 END + CASE WHEN {t('text')} THEN 1 ELSE 0 END" for t in _TERMS)
_BOTH = " AND ".join(t("concat_ws(chr(10), title, text)") for t in _TERMS)
F28_TOP = f"SELECT doc_id, ({_SCORE})::INT AS score FROM {DATED} WHERE {_BOTH} ORDER BY score DESC, published_at DESC NULLS LAST, doc_id LIMIT 40"


def a18(s, d):
    return read(s, d, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("characters"), F.count("*").alias("n"))


def a19(s, d):
    return read(s, d, "labels").groupBy("quality").agg(F.bool_or(C("toxic") == 1).alias("failed"), F.bool_or(C("toxic") == 0).alias("succeeded"))


def r01(s, d):
    return read(s, d, "events").orderBy(F.desc_nulls_last("ts"), F.coalesce("user_id", F.lit(1000)), "event_id").limit(50).select("event_id")


def r02(s, d):
    stories = read(s, d, "orders").join(a01(s, d).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    return stories.orderBy(F.desc("sources"), F.asc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "sources")


def r04(s, d):
    return read(s, d, "orders").join(a01(s, d).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").orderBy(F.desc("publishers"), F.desc("sources"), F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey", "publishers", "sources")


def r05(s, d):
    recent = read(s, d, "orders").filter("o_orderdate >= '1998-01-01'").join(read(s, d, "customer").select(C("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("recent"))
    per = a01(s, d).withColumnRenamed("l_orderkey", "o_orderkey")
    stories = read(s, d, "orders").join(read(s, d, "customer").select(C("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").join(recent, "c_mktsegment", "left").join(per, "o_orderkey")
    return stories.orderBy(F.desc("publishers"), F.coalesce("recent", F.lit(0)), F.desc("sources"), "o_orderkey").limit(30).select("o_orderkey", "c_mktsegment", "publishers")


def r06(s, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), F.desc("l_extendedprice"), "l_linenumber", "l_partkey")
    return read(s, d, "lineitem").withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("l_orderkey", "l_partkey", "l_linenumber")


def r11(s, d):
    best = F.max_by("l_partkey", F.struct("l_quantity", "l_shipdate", "l_partkey"))
    return read(s, d, "lineitem").groupBy("l_suppkey").agg(best.alias("best"))


def r13(s, d):
    return dedup.capped(read(s, d, "events"), ["user_id"], ["ts", "event_id"], 12).withColumn("page", F.floor((C("pos") - 1) / 5)).select("event_id", "page")


def r16(s, d):
    before = F.max(F.when(C("event_type") == "purchase", 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return read(s, d, "events").select("event_id", F.when(F.coalesce(before, F.lit(0)) == 1, "SKIPPED").otherwise("ATTEMPTED").alias("state"))


def r17(s, d):
    ok = C("event_type") != "view"
    rank = F.when(C("event_type") == "click", 0).when(C("event_type") == "purchase", 1).otherwise(2)
    return read(s, d, "events").filter(ok).groupBy("user_id").agg(F.min_by("event_type", F.struct(rank, "event_id")).alias("provider"))


def u01(s, d):
    a = read(s, d, "pages").select(C("page_id").alias("id"), C("url").alias("value"), F.lit(0).alias("provider_rank"))
    b = read(s, d, "documents").select(C("doc_id").alias("id"), C("source").alias("value"), F.lit(1).alias("provider_rank"))
    return a.unionByName(b)


def u04(s, d):
    sets = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("all"), F.collect_set(F.when(C("l_quantity") > 25, C("l_returnflag"))).alias("large"))
    return sets.select("l_orderkey", (F.size(F.array_except("all", "large")) == 0).alias("covered"), (F.array_sort("all") == F.array_sort("large")).alias("equal"), F.array_join(F.array_sort(F.array_union("all", "large")), "").alias("either"), F.array_join(F.array_sort(F.when(F.size("large") > 0, F.array_intersect("all", "large")).otherwise(C("all"))), "").alias("both"))


def m01(s, d):
    """Pages with a query come again with another one, and a copy of every page is new under a negative id."""
    p = read(s, d, "pages").select("page_id", "url")
    new = p.filter(C("url").contains("?")).withColumn("url", F.concat("url", F.lit("&v=2"))).union(p.select((-C("page_id") - 1).alias("page_id"), "url"))
    return tables.upsert(p, new, ["page_id"])


def m02(s, d):
    names = read(s, d, "supplier").select(C("s_name").alias("name"))
    known = read(s, d, "supplier").filter("s_acctbal > 0").select(C("s_name").alias("name"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return tables.get_or_create(names, known, "name", "src_")


def m04(s, d):
    """Links of returned and accepted lines are there; those of all lines come.

    Both are dealt by their keys into as many parts as the lines ask for, and meet where they are dealt.
    """
    l, key, parts = read(s, d, "lineitem"), ["l_orderkey", "l_partkey"], derived.parts_of_lines(s, d)
    return tables.insert_if_absent(l.filter("l_returnflag <> 'N'").select(*key).repartition(parts, *key).distinct(), l.select(*key).repartition(parts, *key), key)


def m06(s, d):
    return tables.update_where(read(s, d, "orders").select("o_orderkey", "o_orderstatus"), C("o_orderkey") % 5 == 0, o_orderstatus=F.lit("X"))


def m07(s, d):
    e = read(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    return tables.latest_state(e, "user_id", ["ts", "event_id"], {"new": ["view"], "view": ["click"], "click": ["purchase"], "purchase": ["view"]}, "event_type", "new")


def m08(s, d):
    return tables.delete_where(read(s, d, "customer"), C("c_acctbal") < 0).select("c_custkey")


def m09(s, d):
    part = read(s, d, "part").select(C("p_partkey").alias("item"), "p_size")
    link = read(s, d, "lineitem").select(C("l_partkey").alias("item"), C("l_orderkey").alias("story"))
    story = read(s, d, "orders").select(C("o_orderkey").alias("story"))
    return tables.cascade(part, link, story, C("p_size") <= 40, "item", "story")[2]


def m11(s, d):
    c = urls.canonicalize_url(C("url"))
    return articles(s, d).select(urls.item_id(F.lit(None).cast("string"), c, C("url")).alias("item"), c.alias("canonical_url"), text.content_hash(C("text")).alias("content_hash"))


def p01(s, d):
    per = a01(s, d).withColumnRenamed("l_orderkey", "o_orderkey")
    age = dates.age_minutes(C("o_orderdate"), F.to_timestamp(F.lit("1999-01-01")))
    score = F.round(0.5 * C("publishers") + 0.3 * C("sources") - 0.000001 * age, 4)
    return read(s, d, "orders").join(per, "o_orderkey").select("o_orderkey", score.alias("score"))


def p02(s, d):
    daily = read(s, d, "events").groupBy("event_type", F.window("ts", "1 day")["start"].alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("n", 1, 0).over(Window.partitionBy("event_type").orderBy("day"))
    return daily.select("event_type", "day", (C("n") - before).alias("velocity"))


def x04(s, d):
    return read(s, d, "events").groupBy("event_type", F.window("ts", "48 hours", "24 hours")["start"].alias("start")).agg(F.count("*").alias("n"))


def x06(s, d):
    g = read(s, d, "events").groupBy("user_id", F.session_window("ts", "36 hours").alias("w")).agg(F.count("*").alias("items"))
    return g.select("user_id", C("w.start").alias("first_seen"), "items")


_TOPIC = "(SELECT l_orderkey, count(*) AS sources, count(DISTINCT l_suppkey) AS publishers FROM lineitem GROUP BY 1)"
QUERIES = {
    "f01_valid_article": (f01, f"SELECT id FROM {ARTICLES} WHERE length(trim(title)) >= 15 AND NOT regexp_matches(lower(url), 'download')"),
    "f02_reject_reason": (f02, F02),
    "f04_status_set": (f04, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE lower(o_orderstatus) IN ('o', 'p') GROUP BY 1"),
    "f05_freshness": (f05, f"SELECT event_id FROM events WHERE ts IS NULL OR ts >= {MOMENT} - INTERVAL 48 HOUR"),
    "f06_source_floor": (f06, "SELECT l_orderkey, count(*) AS sources FROM lineitem GROUP BY 1 HAVING count(*) >= 5"),
    "f07_title_words": (f07, f"SELECT doc_id FROM {TITLED} WHERE list_has_any(regexp_split_to_array(lower(title), '\\s+'), ['the', 'les'])"),
    "f08_candidates": (f08, "SELECT o_orderkey, count(DISTINCT l_suppkey) AS publishers FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND o_orderdate >= '1996-01-01' GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3"),
    "f09_complete_groups": (f09, "SELECT l_orderkey, count(*) AS linked FROM lineitem GROUP BY 1 HAVING bool_and(l_discount < 0.09)"),
    "f17_subject_survival": (f17, None),
    "f20_eligibility": (f20, "SELECT l_orderkey, concat_ws(',', CASE WHEN NOT count(DISTINCT l_suppkey) >= 2 THEN 'domains' END, CASE WHEN NOT bool_and(l_discount <= 0.1) THEN 'supported' END, CASE WHEN max(l_shipdate) < '1998-01-01' THEN 'fresh' END) AS failed, count(DISTINCT l_suppkey) >= 2 AND bool_and(l_discount <= 0.1) AND max(l_shipdate) >= '1998-01-01' AS eligible FROM lineitem GROUP BY 1"),
    "f26_search_predicates": (f26, "SELECT doc_id FROM documents WHERE lang = 'fr' AND n_chars BETWEEN 500 AND 3000"),
    "f26_search_span": (f26_span, f"SELECT doc_id FROM {DATED} WHERE lang = 'en' AND published_at BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-03 12:00:00'"),
    "f27_search_domains": (f27_search, f"SELECT page_id FROM pages WHERE regexp_matches({HOST}, '(^|\\.)example\\.(org|com)$') AND NOT regexp_matches({HOST}, '(^|\\.)(blog\\.example\\.org|shop\\.example\\.com)$')"),
    "f28_search_top": (f28_top, F28_TOP),
    "f28_search_tag": (f28_tag, f"SELECT doc_id FROM {DATED} WHERE source = 'src3' AND published_at >= TIMESTAMP '2024-01-01 06:00:00' AND published_at < TIMESTAMP '2024-01-02 18:00:00'"),
    "f27_domains": (f27, f"SELECT page_id FROM pages WHERE regexp_matches({HOST}, '(^|\\.)example\\.org$') AND NOT starts_with({HOST}, 'blog.')"),
    "f28_keyword_search": (f28, "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(text, 'the ') ORDER BY conv_id DESC, turn DESC LIMIT 50"),
    "j01_story_items": (j01, "SELECT o_orderpriority, p_type, count(*) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"),
    "j02_item_source": (j02, "SELECT l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 20) ON s_suppkey = l_suppkey"),
    "j04_unpublished": (j04, "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')"),
    "j05_reconciliation": (j05, "SELECT a.conv_id, a.turn, CASE count(b.conv_id) WHEN 0 THEN 'NONE' WHEN 1 THEN 'MATCH' ELSE 'AMBIGUOUS' END AS state FROM conversations a LEFT JOIN conversations b ON a.text = b.text AND b.turn >= a.turn AND (b.conv_id <> a.conv_id OR b.turn <> a.turn) WHERE a.turn % 2 = 0 GROUP BY 1, 2"),
    "j06_similar_titles": (j06, J06 + " SELECT query_id, recent_id, round(score, 6) AS score, CASE WHEN score > 0.7 THEN 'DUPLICATE' WHEN score >= 0.35 THEN 'REPETITIVE' WHEN score >= 0.2 THEN 'MATERIAL_UPDATE' END AS relationship FROM x WHERE score >= 0.2"),
    "j09_grounding": (j09, None),
    "j10_verbatim_support": (j10, None),
    "j11_dimension": (j11, "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"),
    "j12_enrichment": (j12, "SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"),
    "j13_orphans": (j13, "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "j14_junk_links": (j14, "SELECT l_orderkey, count(*) AS links FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5) GROUP BY 1"),
    "j19_replies": (j19, "SELECT r.conv_id, count(c.turn) AS replies, count(c.turn) FILTER (c.turn = 1) AS direct FROM (SELECT conv_id FROM conversations WHERE turn = 0) r LEFT JOIN (SELECT * FROM conversations WHERE turn > 0) c USING (conv_id) GROUP BY 1"),
    "k01_greedy_first_seen": (k01, None),
    "k02_feed_dedup": (k02, f"SELECT min(page_id) AS page_id FROM (SELECT page_id, {HOST} AS h, {CANONICAL} AS c FROM pages) GROUP BY h, c"),
    "k03_cross_feed_dedup": (k03, "SELECT arg_min(page_id, (page_id % 3) * 1000000000 + page_id) AS page_id FROM pages GROUP BY regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"),
    "k04_ordered_distinct": (k04, "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"),
    "k05_evidence_cap": (k05, f"SELECT page_id, pos::INT AS pos FROM (SELECT page_id, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) AS pos FROM pages) WHERE pos <= 5"),
    "k06_story_clusters": (k06, None),
    "k07_story_key": (k07, f"SELECT id, left(sha256({SIGNATURE} || '|' || coalesce(strftime(published_at, '%Y%m%d'), 'unknown') || '|' || lang), 16) AS story_key FROM {ARTICLES}"),
    "h02_page_metadata": (h02, "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '(?i)<html[^>]*\\blang=\"([^\"]*)\"', 1), '') AS language FROM pages"),
    "h05_article_text": (h05, None),
    "h09_extraction_methods": (h09, None),
    "a01_source_count": (a01, _TOPIC[1:-1]),
    "a02_category_distribution": (a02, "SELECT upper(trim(c)) AS category, count(*) AS n FROM (SELECT lang AS c FROM documents UNION ALL SELECT source FROM documents) GROUP BY 1"),
    "a03_published_day": (a03, "SELECT event_type, count(*) AS n, max(ts) AS last FROM events WHERE ts::DATE = '2024-01-03' GROUP BY 1"),
    "a05_cluster_roll_up": (a05, f"SELECT source AS story_id, arg_min(title, doc_id) AS title, min(ts) AS first_seen_at, max(ts) AS last_seen_at, string_agg(DISTINCT lang, ',' ORDER BY lang) AS publishers, string_agg(DISTINCT lang, ',' ORDER BY lang) AS categories, count(*) AS item_count FROM {TITLED} JOIN events ON event_id = doc_id GROUP BY 1"),
    "a07_reject_totals": (a07, f"SELECT reason, count(*) AS n FROM ({F02}) WHERE reason IS NOT NULL GROUP BY 1"),
    "a08_by_category": (a08, f"SELECT coalesce(lang, 'UNCATEGORIZED') AS category, count(*) FILTER (reason IS NULL) AS accepted, count(reason) AS rejected FROM {ARTICLES} JOIN ({F02}) USING (id) GROUP BY 1"),
    "a10_log_summary": (a10, "SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY 1"),
    "a11_row_counts": (a11, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ["customer", "documents", "events", "lineitem", "orders", "pages"])),
    "a14_story_audit": (a14, None),
    "a18_evidence_characters": (a18, "SELECT lang, sum(length(text))::BIGINT AS characters, count(*) AS n FROM documents GROUP BY 1"),
    "a19_success_failure": (a19, "SELECT quality, bool_or(toxic = 1) AS failed, bool_or(toxic = 0) AS succeeded FROM labels GROUP BY 1"),
    "r01_extraction_budget": (r01, "SELECT event_id FROM events ORDER BY ts DESC NULLS LAST, user_id, event_id LIMIT 50"),
    "r02_unpublished_candidates": (r02, f"SELECT o_orderkey, sources FROM orders JOIN {_TOPIC} ON l_orderkey = o_orderkey ORDER BY sources DESC, o_orderdate, o_orderkey LIMIT 100"),
    "r04_breaking_rank": (r04, f"SELECT o_orderkey, publishers, sources FROM orders JOIN {_TOPIC} ON l_orderkey = o_orderkey ORDER BY publishers DESC, sources DESC, o_orderdate DESC, o_orderkey LIMIT 1"),
    "r05_diversity_rank": (r05, f"SELECT o_orderkey, c_mktsegment, publishers FROM orders JOIN customer ON c_custkey = o_custkey JOIN {_TOPIC} ON l_orderkey = o_orderkey LEFT JOIN (SELECT c_mktsegment, count(*) AS recent FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= '1998-01-01' GROUP BY 1) USING (c_mktsegment) ORDER BY publishers DESC, coalesce(recent, 0), sources DESC, o_orderkey LIMIT 30"),
    "r06_strongest_claim": (r06, "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1"),
    "r10_top_similar": (r10, J06 + " SELECT query_id, recent_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, recent_id) AS rank FROM x WHERE score >= 0.2) WHERE rank <= 5"),
    "r11_best_source": (r11, "SELECT l_suppkey, l_partkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_shipdate DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1"),
    "r13_paging": (r13, "SELECT event_id, (pos - 1) // 5 AS page FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) WHERE pos <= 12"),
    "r16_attempts": (r16, "SELECT event_id, CASE WHEN coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'SKIPPED' ELSE 'ATTEMPTED' END AS state FROM events"),
    "r17_provider_fallback": (r17, "SELECT user_id, event_type AS provider FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id) AS r FROM events WHERE event_type <> 'view') WHERE r = 1"),
    "u01_union_providers": (u01, "SELECT page_id AS id, url AS value, 0 AS provider_rank FROM pages UNION ALL SELECT doc_id, source, 1 FROM documents"),
    "u04_set_algebra": (u04, "SELECT l_orderkey, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS covered, a = b AS equal, array_to_string(a, '') AS either, array_to_string(CASE WHEN len(b) > 0 THEN b ELSE a END, '') AS both FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS a, coalesce(list_sort(list(DISTINCT l_returnflag) FILTER (l_quantity > 25)), []) AS b FROM lineitem GROUP BY 1)"),
    "m01_upsert": (m01, "SELECT page_id, CASE WHEN contains(url, '?') THEN url || '&v=2' ELSE url END AS url, CASE WHEN contains(url, '?') THEN 'updated' ELSE 'kept' END AS change FROM pages UNION ALL SELECT -page_id - 1, url, 'inserted' FROM pages"),
    "m02_get_or_create": (m02, "SELECT s_name AS name, CASE WHEN s_acctbal > 0 THEN 's' || s_suppkey ELSE 'src_' || left(sha256(s_name), 20) END AS id, NOT s_acctbal > 0 AS created FROM supplier"),
    "m04_insert_if_absent": (m04, "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem"),
    "m06_status_update": (m06, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"),
    "m07_publication_state": (m07, None),
    "m08_delete": (m08, "SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0"),
    "m09_cleanup_cascade": (m09, "SELECT o_orderkey AS story FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40)"),
    "m11_etl_transform": (m11, f"SELECT left(sha256({CANONICAL}), 16) AS item, {CANONICAL} AS canonical_url, CASE WHEN {CLEAN} <> '' THEN sha256({CLEAN}) END AS content_hash FROM {ARTICLES}"),
    "p01_selection_score": (p01, f"SELECT o_orderkey, round(0.5 * publishers + 0.3 * sources - 0.000001 * floor((epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate)) / 60), 4)::DOUBLE AS score FROM orders JOIN {_TOPIC} ON l_orderkey = o_orderkey"),
    "p02_trend_velocity": (p02, "SELECT event_type, day, n - lag(n, 1, 0) OVER (PARTITION BY event_type ORDER BY day) AS velocity FROM (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)"),
    "x04_sliding_counts": (x04, "SELECT event_type, date_trunc('day', ts) - to_days(k::INT) AS start, count(*) AS n FROM events, range(2) r(k) GROUP BY 1, 2"),
    "x06_inactivity_groups": (x06, "SELECT user_id, min(ts) AS first_seen, count(*) AS items FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 36 HOUR THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY user_id, g"),
}
