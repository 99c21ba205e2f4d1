"""Queries of the newsroom's rules over derived articles, claims and posts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, publishers, taxonomy, text, urls
from ..operators import articles, dedup, gates, stories, tables
from ..sources import payloads
from . import derived
from .derived import pick
from .scalars import CANONICAL, HOST, as_of, read

C = F.col
W = derived.sql("wire")
MOMENT = "TIMESTAMP '2024-01-20 00:00:00'"


def wire(s, d):
    return derived.table(s, d, "wire")


def lit(v):
    return F.lit(v).cast("string")


# -- URLs and publishers


def n03(s, d):
    p = read(s, d, "pages").select("page_id", urls.canonicalize_url(C("url")).alias("c")).filter("c is not null")
    return dedup.first_seen(p, ["c"], ["page_id"]).select("page_id", C("c").alias("canonical_url"))


def n04(s, d):
    return wire(s, d).select("id", publishers.article_key(C("url")).alias("key"))


def n08(s, d):
    given = F.when(C("page_id") % 3 == 0, F.concat(F.lit("g"), "page_id")).when(C("page_id") % 3 == 1, "")
    return read(s, d, "pages").select("page_id", urls.item_id(given, urls.canonicalize_url(C("url")), C("url")).alias("item_id"))


def n14(s, d):
    return wire(s, d).select("id", publishers.is_wrapper(C("url")).alias("wrapper"), publishers.wrapped_id(C("url")).alias("wrapped_id"))


def n15(s, d):
    """Links as the aggregator makes them: some bytes, the address, more bytes, in the web alphabet without padding."""
    raw = F.concat(F.unhex(F.lit("08132216")), F.concat(F.lit("https://www.pub.org/a/"), "id").cast("binary"), F.unhex(F.lit("d20100")))
    code = F.regexp_replace(F.translate(F.base64(raw), "+/", "-_"), "[=\r\n]", "")
    own = F.when(C("id") % 4 == 0, "https://paper.net/x").otherwise(F.concat(F.lit("https://news.google.com/rss/articles/"), code, F.when(C("id") % 3 == 0, "?oc=5").otherwise("")))
    return wire(s, d).select("id", publishers.unwrapped(own).alias("publisher_url"))


def _landing(duck):
    paths = ["", "/", *[f"/{x}" for x in urls.SECTIONS], "/World/", "/world/story", "/index.html", "/sport"]
    return f"'https://a.org' || {pick(paths, 'p_partkey', duck)}"


def n18(s, d):
    p = read(s, d, "part").selectExpr("p_partkey", f"{_landing(False)} AS url")
    return p.select("p_partkey", urls.is_portal(C("url")).alias("portal"))


def n19(s, d):
    return wire(s, d).select("id", publishers.is_cleanup_portal(C("url"), C("title")).alias("portal"))


def n22(s, d):
    a = (C("publisher"), lit(None), C("source_name"), C("url"))
    return wire(s, d).select("id", publishers.publisher_name(*a, C("provider")).alias("publisher_name"), publishers.publisher_domain(C("source_domain"), lit(None), lit(None), C("url")).alias("publisher_domain"))


def n23(s, d):
    canonical = F.when(C("id") % 3 == 0, C("url")).when(C("id") % 3 == 1, F.concat(F.lit("https://own.org/"), "id"))
    return wire(s, d).select("id", publishers.canonical_or_article(canonical, F.concat(F.lit("https://final.org/"), "id")).alias("canonical_url"))


def n24(s, d):
    return wire(s, d).select("id", publishers.documented_source_type(C("source_name"), C("source_domain")).alias("source_type"))


_ANYHOST = "coalesce(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[^:/?#]+://([^/?#:]*)', 1)), '^www\\.', ''), '')"
_ANYPATH = "regexp_extract(coalesce(trim(url), ''), '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
_SECTION = "(" + "|".join(urls.SECTIONS) + ")"
_NAME = "coalesce(nullif(trim(publisher), ''), nullif(trim(source_name), ''), h)"
_PORTALS = " OR ".join(f"contains(title, '{t}')" for t in publishers.PORTAL_TITLES)


# -- dates


def d03(s, d):
    kinds = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy"]
    shown = F.lit("soon")
    for k, p in enumerate(kinds):
        shown = F.when(C("event_id") % 7 == k, F.date_format("ts", p)).otherwise(shown)
    return read(s, d, "events").select("event_id", dates.shown_date(shown).alias("shown"))


def d04(s, d):
    raw = F.when(C("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(C("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "d.M.yyyy"))
    zoned = F.when(C("event_id") % 2 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return read(s, d, "events").select("event_id", dates.iso_date(raw).alias("iso"), dates.as_utc(zoned).alias("utc"), dates.within_bucket(C("ts").cast("timestamp"), as_of(), "w").alias("last_week"))


def d08(s, d):
    seen = read(s, d, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("published"))
    rows = read(s, d, "orders").join(seen, "o_orderkey", "left").withColumn("published", F.coalesce("published", F.array().cast("array<string>")))
    first = F.when(C("o_orderkey") % 5 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rows.select("o_orderkey", dates.story_date(C("published"), first).alias("story_date"))


# -- texts


def t07(s, d):
    return read(s, d, "documents").select("doc_id", F.size(text.plain_sentences(C("text"))).alias("n_sentences"))


def t10(s, d):
    a, b = text.similarity_words(C("title")), text.similarity_words(F.coalesce("body", F.lit("")))
    return wire(s, d).select("id", F.round(text.jaccard(a, b), 6).alias("score"))


def t12(s, d):
    return wire(s, d).select("id", text.sentence_score(C("title"), C("id") % 3).alias("score"))


def t13(s, d):
    return read(s, d, "documents").select("doc_id", text.compress_to_limit(C("text"), 500).alias("post"))


def t14(s, d):
    return wire(s, d).select("id", text.finished(C("title"), 24).alias("finished"), text.ended(F.concat("title", F.lit(" - ..."))).alias("ended"))


def t16(s, d):
    return derived.table(s, d, "posts").select("story_id", text.with_source(C("post"), F.lit("https://www.pub1.org/a/1"), 60).alias("post"))


def t17(s, d):
    urls_known = F.array(F.lit("https://www.pub1.org/a/1"))
    last = F.element_at(F.split(C("post"), " "), -1)
    return derived.table(s, d, "posts").select("story_id", text.is_source_reference(last, urls_known).alias("reference"), text.bare_url(last).alias("url"))


def t18(s, d):
    return wire(s, d).select("id", text.topic_label(C("raw_category"), C("title")).alias("topic"), text.is_sensitive(C("title")).alias("sensitive"), F.array_join(text.allowed_styles(C("title")), ",").alias("styles"))


def t22(s, d):
    given = F.when(C("id") % 3 == 0, C("title")).when(C("id") % 3 == 1, " ")
    return wire(s, d).select("id", text.derived_headline(given, C("body")).alias("headline"))


def t23(s, d):
    e = derived.table(s, d, "evidence")
    line = F.concat(F.lit("- evidence_id="), "evidence_id", F.lit(" source_id="), "source_id", F.lit(" url="), F.coalesce("url", F.lit("None")))
    return e.groupBy("story_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


def t24(s, d):
    post = F.concat_ws("\n", F.lit("Said."), F.concat(F.when(C("story_id") % 2 == 0, "Source: ").otherwise("source:  "), F.when(C("story_id") % 3 == 0, "https://a.org/x.").otherwise("https://b.org/y")))
    return derived.table(s, d, "posts").select("story_id", text.bare_source_line(post, F.lit("https://a.org/x")).alias("post"))


def t25(s, d):
    wrap = F.when(C("id") % 4 == 0, F.concat(F.lit("<thought>hm {</thought>```json\n{\"a\": "), "id", F.lit("}\n```"))).when(C("id") % 4 == 1, F.concat(F.lit("So it is {\"a\": "), "id", F.lit("} then."))).when(C("id") % 4 == 2, F.concat(F.lit("{\"a\": "), "id", F.lit("}")))
    return wire(s, d).select("id", F.try_variant_get(text.first_json(F.coalesce(wrap, F.lit("no json {"))), "$.a", "long").alias("a"))


# -- taxonomy


def full_categories(column: str) -> str:
    low = f"regexp_replace(lower(coalesce({column}, '')), '\\s+', ' ', 'g')"
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({low}, '{p}') THEN '{c}' END" for c, p in sorted(taxonomy.SIGNALS.items())) + "], lambda c: c IS NOT NULL)"


_ALL = full_categories("title || ' ' || coalesce(body, '')")
_OF_TITLE, _OF_BODY = full_categories("title"), full_categories("body")
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_PRIMARY = f"list_filter({_LIST(taxonomy.PRIORITY)}, lambda c: list_contains(CASE WHEN len({_OF_TITLE}) > 0 THEN {_OF_TITLE} ELSE {_OF_BODY} END, c))[1]"
_NEWSY = f"(NOT regexp_matches(lower(title), '{taxonomy.NOT_NEWS}') AND regexp_matches(lower(concat_ws(' ', title, body)), '{taxonomy.DEVELOPMENT}'))"


def c01_sql(column: str, partial: bool) -> str:
    plain, key = f"replace(lower(trim({column})), '_', ' ')", f"replace(replace(upper(trim({column})), ' ', '_'), '-', '_')"
    names, values = _LIST(taxonomy.SYNONYMS), _LIST(taxonomy.SYNONYMS.values())
    near = f"list_filter(range(1, {len(taxonomy.SYNONYMS) + 1}), lambda i: contains({plain}, {names}[i]) OR contains({names}[i], {plain}))[1]"
    found = f"{values}[list_position({names}, {plain})]"
    rejected = f"(list_contains({_LIST(taxonomy.REJECTED)}, {key}) OR list_contains({_LIST(r.lower().replace('_', ' ') for r in taxonomy.REJECTED)}, {plain}))"
    both = f"coalesce({found}, {values}[{near}])" if partial else found
    return f"(CASE WHEN {column} IS NULL OR {plain} = '' OR {rejected} THEN NULL WHEN list_contains({_LIST(taxonomy.CATEGORIES)}, {key}) THEN {key} ELSE {both} END)"


def c01(s, d):
    return wire(s, d).select("id", taxonomy.synonym(C("raw_category")).alias("strict"), taxonomy.synonym(C("raw_category"), True).alias("partial"))


def c02(s, d):
    two = F.array("raw_category", "other_category")
    return wire(s, d).select("id", F.array_join(taxonomy.normalize_categories(two), ",").alias("loose"), F.array_join(taxonomy.normalize_categories(two, False), ",").alias("strict"), F.array_join(taxonomy.allowed_only(taxonomy.normalize_categories(two, False)), ",").alias("allowed"))


def c07(s, d):
    rows = wire(s, d).select("id", taxonomy.classify(C("title"), C("body")).alias("k"))
    return rows.select("id", F.array_join("k.categories", ",").alias("categories"), "k.primary_category", "k.topic_fit", "k.newsworthiness")


def c09(s, d):
    own = F.when(C("id") % 4 == 0, F.array("raw_category")).otherwise(F.array().cast("array<string>"))
    meta = F.when(C("id") % 4 == 1, '{"categories": ["A", "B"]}').when(C("id") % 4 == 2, '{"categories": "C"}').otherwise("{}")
    return wire(s, d).select("id", F.array_join(taxonomy.categories_at_read(own, meta), ",").alias("categories"))


def c10(s, d):
    f = taxonomy.assessed(C("topic_fit"), C("newsworthiness"), C("title"), C("body"))
    return wire(s, d).select("id", f["topic_fit"].alias("topic_fit"), f["newsworthiness"].alias("newsworthiness"))


def c11(s, d):
    return wire(s, d).select("id", taxonomy.publication_status(C("status")).alias("status"))


# -- gates


def f01(s, d):
    return wire(s, d).filter(gates.valid_article(C("url"), C("title"))).select("id")


def f02(s, d):
    return wire(s, d).select("id", gates.reject_reason(C("url"), C("title"), C("body"), C("published_at"), as_of(), C("provider")).alias("reason"))


_ALLOWED = f"list_filter({_ALL}, lambda c: c <> 'SPORTS')"
_STORE = "regexp_matches(lower(coalesce(url, '')), 'apps\\.apple\\.com|play\\.google\\.com|microsoft\\.com/store|chrome\\.google\\.com/webstore|download')"
_LAND = f"regexp_matches(CASE WHEN lower({_ANYPATH}) = '' THEN '/' ELSE lower({_ANYPATH}) END, '^/*$|^/{_SECTION}/?$|^/index\\.html?$')"
_PT = "regexp_matches(trim(title), '" + gates.PORTAL_TITLE.replace("'", "''") + "')"
F02 = f"""SELECT id, CASE WHEN coalesce(trim(url), '') = '' OR trim(title) = '' THEN 'INSUFFICIENT_METADATA'
 WHEN NOT regexp_matches(lower(trim(url)), '^https?://[^/?#]+') THEN 'INSUFFICIENT_METADATA'
 WHEN {_STORE} OR {_LAND} OR {_PT} THEN 'PORTAL_PAGE'
 WHEN length(trim(title)) < 15 THEN 'INSUFFICIENT_METADATA'
 WHEN regexp_matches(lower(title), '{taxonomy.OPINION}') THEN 'OPINION_CONTENT'
 WHEN regexp_matches(lower(title), '{taxonomy.PROMOTION}') THEN 'PROMOTIONAL_CONTENT'
 WHEN provider = 'google_news' AND ({_ANYHOST} = 'news.google.com' OR {_ANYHOST} = 'google.com' OR suffix({_ANYHOST}, '.google.com')) THEN 'UNRESOLVED_PUBLISHER'
 WHEN length(trim(coalesce(body, ''))) < 40 THEN 'INSUFFICIENT_METADATA'
 WHEN len({_ALLOWED}) = 0 THEN 'OUT_OF_SCOPE'
 WHEN NOT {_NEWSY} THEN 'NOT_NEWSWORTHY'
 WHEN published_at IS NULL OR published_at > {MOMENT} + INTERVAL 1 DAY THEN 'INSUFFICIENT_METADATA'
 WHEN published_at < {MOMENT} - INTERVAL 30 DAY THEN 'STALE_ARTICLE' END AS reason FROM {W}"""


def f03(s, d):
    found = taxonomy.infer_categories(F.concat_ws(" ", "title", "body"))
    news = taxonomy.is_newsworthy(C("title"), C("body"))
    return wire(s, d).select("id", text.let(found, lambda k: stories.build_gate(k, F.size(k) > 0, news)).alias("reason"))


def f08(s, d):
    w = wire(s, d).select("id", "title", C("body").alias("summary"), F.array_compact(F.array("raw_category", "other_category")).alias("categories"), "published_at", "topic_fit", "newsworthiness", (C("id") % 9).alias("source_count"))
    return stories.candidates(w, as_of()).select("id", F.array_join("categories", ",").alias("categories"))


def f25(s, d):
    w = wire(s, d)
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("PASS", "BLOCKED", "ESCALATE", "PUBLISHED", "CANDIDATE_REJECTED", "SYSTEM_ERROR")]), (C("id") % 6 + 1).cast("int"))
    status = F.when(C("id") % 4 == 0, "SKIPPED_DRY_RUN").when(C("id") % 4 == 1, "RECOVERY_REQUIRED").when(C("id") % 4 == 2, "PUBLISHED")
    return w.select("id", stories.run_outcome(outcome, status).alias("outcome"))


def f29(s, d):
    e = read(s, d, "events").withColumn("t", C("ts").cast("timestamp"))
    return e.groupBy("event_type").agg(*[F.count_if(dates.within_bucket(C("t"), as_of(), b)).alias(f"last_{b}") for b in "dwmy"])


def h04(s, d):
    return articles.chosen_containers(articles.containers(read(s, d, "pages").select("page_id", "html"))).select("page_id", "tag", "length", "paragraphs", "linked", F.round("score", 4).alias("score"))


def h06(s, d):
    return articles.cascade(read(s, d, "pages").select("page_id", "html"))


def h07(s, d):
    p = read(s, d, "pages")
    items = p.select("page_id", F.when(C("page_id") % 3 == 0, "google_news").otherwise("rss").alias("provider"), F.when(C("page_id") % 4 != 0, "Wire title").alias("title"), "url", C("url").alias("canonical_url"), F.lit("short").alias("content"), lit(None).alias("author"), lit(None).alias("published_at"), F.when(C("page_id") % 5 == 0, "xx").alias("language"), F.when(C("page_id") % 2 == 0, "Google News").alias("publisher_name"), lit(None).alias("publisher_domain"))
    found = h06(s, d).filter("page_id % 7 <> 0").withColumn("final_url", F.concat(F.lit("https://www.final.org/"), "page_id"))
    return articles.enriched(items, found, "page_id").select("page_id", "url", "canonical_url", "publisher_name", "publisher_domain", "language")


def h08(s, d):
    doc = read(s, d, "documents")
    return doc.select("doc_id", articles.needs_extraction(F.when(C("doc_id") % 9 == 0, "google_news").otherwise("rss"), F.when(C("doc_id") % 2 == 0, C("text")), F.lit("about"), C("source")).alias("needed"))


_LONG = "CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE '' END"


# -- rankings and reports over articles


def r01(s, d):
    w = wire(s, d).select("provider", C("id").alias("pos"), "title", C("body").alias("description"), F.lit("").alias("snippet"), F.when(C("id") % 2 == 0, F.repeat("body", 8)).alias("content"), "published_at", F.when(C("id") % 3 == 0, (C("id") % 4).cast("int")).alias("feed_priority"))
    return stories.ranked_for_extraction(w, 50).select("provider", "pos", "thin", "useful")


_CONTENT = "coalesce(CASE WHEN id % 2 = 0 THEN repeat(body, 8) END, '')"


def r03(s, d):
    n = read(s, d, "lineitem").groupBy(C("l_orderkey").alias("id")).agg(F.count("*").alias("source_count"))
    o = read(s, d, "orders").select(C("o_orderkey").alias("id"), F.when(C("o_orderkey") % 7 != 0, C("o_orderdate")).alias("first_seen_at")).join(n, "id")
    return stories.reporting_candidates(o, 30).select("id", "source_count")


def r05(s, d):
    l = read(s, d, "lineitem").groupBy(C("l_orderkey").alias("id")).agg(F.collect_set(F.concat(F.lit("WWW.Pub"), C("l_suppkey") % 7, F.lit(".org"))).alias("domains"), F.count("*").alias("source_count"))
    o = read(s, d, "orders").join(read(s, d, "customer").select(C("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select(C("o_orderkey").alias("id"), F.when(C("o_orderkey") % 3 != 0, C("o_orderkey") % 2 == 0).alias("topic_fit"), (C("o_orderkey") % 5 == 0).alias("newsworthiness"), F.array("c_mktsegment", "o_orderpriority").alias("categories"), "o_orderdate", "c_mktsegment")
    recent = o.filter("o_orderdate >= '1998-01-01'").groupBy(C("c_mktsegment").alias("category")).agg(F.count("*").alias("n"))
    return stories.diverse_candidates(o.join(l, "id"), recent, 40).select("id", "quality", "publishers", "covered")


def _publications(s, d):
    e = read(s, d, "events")
    return e.select(C("event_id").alias("id"), (C("user_id")).alias("story_id"), F.when(C("event_id") % 5 == 0, "other").otherwise("threads").alias("platform"), F.when(C("event_type") == "click", "PUBLISHED").when(C("event_type") == "view", "published").otherwise("draft").alias("status"), C("ts").alias("published_at"))


_PUBS = "(SELECT event_id AS id, user_id AS story_id, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE 'threads' END AS platform, CASE event_type WHEN 'click' THEN 'PUBLISHED' WHEN 'view' THEN 'published' ELSE 'draft' END AS status, ts AS published_at FROM events)"


def r08(s, d):
    return stories.recent_publications(_publications(s, d), "threads", 30, as_of(), 24).select("id", "story_id")


def r09(s, d):
    o = read(s, d, "orders").select(C("o_orderkey").alias("id"), F.when(C("o_orderkey") % 6 != 0, C("o_orderdate")).alias("last_seen_at"), F.when(C("o_orderkey") % 4 == 0, C("o_orderdate")).alias("first_seen_at"))
    return stories.recent_stories(o, F.to_timestamp(F.lit("1999-01-01")), 48, 60).select("id")


def r14(s, d):
    return stories.newest(_publications(s, d), "published_at", "id").select("id", "status")


def r15(s, d):
    p = read(s, d, "pages").select("page_id", urls.host(C("url")).alias("host"), urls.canonicalize_url(C("url")).alias("c"))
    once = dedup.first_seen(p, ["host", "c"], ["page_id"])
    return dedup.capped(once, ["host"], ["page_id"], 3).select("host", "page_id", "pos")


def r18(s, d):
    o = read(s, d, "orders").select(C("o_orderkey").alias("id"), C("o_orderdate").alias("first_seen_at"), F.when(C("o_orderkey") % 2 == 0, "news").otherwise(F.lower("o_orderpriority")).alias("topic"), F.concat_ws(" ", F.lit("Order"), C("o_orderkey").cast("string"), F.lit("shipped")).alias("title"))
    return stories.latest_topic(o, _publications(s, d))


def a06(s, d):
    return stories.metrics(read(s, d, "events").withColumn("provider", C("user_id") % 7), "provider", "event_type", ["click", "error", "purchase", "view"])


def a09(s, d):
    w = wire(s, d).select("id", F.when(C("id") % 10 != 0, F.coalesce(publishers.article_key(C("url")), C("url"))).alias("key"))
    rows = w.withColumn("key", F.nullif(F.regexp_replace("key", r"\d+$", ""), F.lit("")))
    kept = dedup.first_seen(rows.filter("key is not null"), ["key"], ["id"])
    stored = rows.filter("id % 24 < 3 and key is not null").select("key").distinct().filter("key like '%story%' or key like '%CBM%'")
    return stories.ingest_summary(rows, kept, stored, "key")


def a12(s, d):
    v = derived.table(s, d, "verifications")
    return v.groupBy(F.upper("status").alias("status")).agg(F.count("*").alias("n"))


def a13(s, d):
    l = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.when(C("l_suppkey") % 2 == 0, "www.").otherwise(" "), F.lit("Pub"), C("l_suppkey") % 5, F.lit(".ORG"))).alias("domains"))
    return l.select("l_orderkey", stories.publisher_count(C("domains")).alias("publishers"))


def _social(s, d):
    c = read(s, d, "conversations")
    root = F.concat_ws("-", "conv_id", F.lit("0"))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.concat(F.lit("u"), C("conv_id") % 20 + C("turn") % 3).alias("username"), F.concat(F.lit("https://t.org/"), "conv_id").alias("permalink"), F.lit("2024-01-02T03:04:05Z").alias("timestamp"), F.when(C("turn") % 2 == 0, "IMAGE").alias("media_type"), F.when(C("turn") % 3 == 0, "https://t.org/i.png").alias("media_url"), lit(None).alias("thumbnail_url"), F.when(C("turn") > 0, F.concat_ws("-", "conv_id", C("turn") - 1)).alias("replied_to"), F.when(C("turn") > 0, root).alias("root_post"))


def m12(s, d):
    r = stories.social_rows(_social(s, d))
    return r.select("id", "author_username", "created_at", F.size("media").alias("media"), F.get("media", F.lit(0))["type"].alias("media_type"), "reply_to_id", "conversation_id", "is_reply")


def a20(s, d):
    return stories.social_counts(stories.social_rows(_social(s, d)))


def a23(s, d):
    w = wire(s, d).select("url", F.concat_ws(" ", "title", F.when(C("id") % 6 == 0, "on news.google.com")).alias("title"))
    return stories.restricted_coverage(w, "news.google.com")


def a14_audit(s, d):
    """Orders as stories, their lines as links to wire articles."""
    links = read(s, d, "lineitem").select(C("l_orderkey").alias("story_id"), C("l_partkey").alias("item_id"), "l_linenumber", "l_suppkey")
    items = wire(s, d).select(C("id").alias("item_id"), C("source_domain").alias("publisher_domain"), C("source_name").alias("publisher_name"), "provider", F.when(C("id") % 3 != 0, C("raw_category")).alias("query"), "published_at").filter("item_id % 17 <> 0")
    a = stories.audit(links, items, ["l_linenumber", "l_suppkey"], derived.parts_of_lines(s, d))
    return a.select("story_id", *[F.array_join(k, ",").alias(k) for k in ("publishers", "providers", "queries")], "published_at", "sources")


def _first_seen_list(value: str, name: str) -> str:
    return f"(SELECT story_id, string_agg(v, ',' ORDER BY place) AS {name} FROM (SELECT story_id, {value} AS v, min(row(l_linenumber, l_suppkey, item_id)) AS place FROM x WHERE {value} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"


_A14 = f"""WITH i AS (SELECT id AS item_id, coalesce(nullif(source_domain, ''), nullif(source_name, '')) AS publisher, nullif(provider, '') AS provider, nullif(CASE WHEN id % 3 <> 0 THEN raw_category END, '') AS query, published_at FROM {derived.sql('wire')} WHERE id % 17 <> 0),
 x AS (SELECT l_orderkey AS story_id, l_partkey AS item_id, l_linenumber, l_suppkey, publisher, provider, query, published_at FROM lineitem LEFT JOIN i ON i.item_id = l_partkey)
SELECT f.story_id, coalesce(publishers, '') AS publishers, coalesce(providers, '') AS providers, coalesce(queries, '') AS queries, published_at, sources FROM
 (SELECT story_id, arg_min(published_at, row(l_linenumber, l_suppkey, item_id)) FILTER (published_at IS NOT NULL) AS published_at, count(*) AS sources FROM x GROUP BY 1) f
 LEFT JOIN {_first_seen_list('publisher', 'publishers')} p USING (story_id) LEFT JOIN {_first_seen_list('provider', 'providers')} q USING (story_id) LEFT JOIN {_first_seen_list('query', 'queries')} r USING (story_id)"""


def r16(s, d):
    e = read(s, d, "events").select("event_id", "user_id", "ts", F.when(C("event_type") == "click", "CANDIDATE_REJECTED").when(C("event_type") == "view", "PUBLISHED").otherwise("SYSTEM_ERROR").alias("outcome"))
    return stories.replay_attempts(e, "user_id", ["ts", "event_id"], 2).select("event_id", "state")


_BEFORE = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def p01(s, d):
    w = wire(s, d)
    parts = {n: ((C("id") + k * 7) % 11 / 10) if k != 3 else F.lit(None).cast("double") for k, n in enumerate(stories.WEIGHTS)}
    return w.select("id", F.round(stories.selection_score(parts, {"recency": 3.0, "uniqueness": 2.0}), 6).alias("score"))


_P01 = " + ".join(f"coalesce({'NULL' if k == 3 else f'((id + {k * 7}) % 11) / 10.0'}, 0.0) * ({ {'recency': 3.0, 'uniqueness': 2.0}.get(n, 1.0)} / 12.0)" for k, n in enumerate(stories.WEIGHTS))


# -- sources


def s06(s, d):
    return payloads.first_per_query(read(s, d, "events").select("event_id", "user_id"), "user_id", "event_id", 3)


def s08(s, d):
    keys = F.element_at(F.array(*[F.lit(k) for k in ("items", "results", "articles", "data", "other")]), (C("id") % 5 + 1).cast("int"))
    raw = F.when(C("id") % 7 == 0, "[{\"n\": 1}, {\"n\": 2}]").when(C("id") % 11 == 0, F.concat(F.lit("{'data': [{'n': "), "id", F.lit("}], 'x': None}"))).when(C("id") % 13 == 0, "plain words").otherwise(F.concat(F.lit("{\""), keys, F.lit("\": [{\"n\": "), "id", F.lit("}, {\"n\": 3}, {\"n\": 4}]}")))
    items = payloads.listed_items(payloads.lenient(raw))
    return wire(s, d).select("id", F.size(items).alias("items"), F.try_variant_get(F.get(items, F.lit(0)), "$.n", "long").alias("first"))


def s12(s, d):
    kind = F.element_at(F.array(F.lit("text/html; charset=utf-8"), F.lit("application/PDF"), F.lit("application/xhtml+xml"), F.lit("image/png"), lit(None), F.lit("text/plain"), F.lit("")), (C("id") % 7 + 1).cast("int"))
    return wire(s, d).filter(payloads.readable(kind)).select("id")


def s13(s, d):
    return payloads.equal_to(read(s, d, "orders"), o_orderstatus="O", o_orderpriority="5-LOW").select("o_orderkey")


def s17(s, d):
    known = read(s, d, "supplier").filter("s_nationkey < 12").select(C("s_name").alias("model"), (C("s_nationkey") % 4).alias("provider"))
    rows = read(s, d, "supplier").select(C("s_name").alias("model"), (C("s_nationkey") % 4).alias("provider"), "s_acctbal")
    primary = rows.filter("s_acctbal < -100000")
    return payloads.with_fallback(primary, rows, known, ["provider", "model"]).select("model", "provider")


def j16(s, d):
    known = read(s, d, "supplier").select(C("s_name").alias("model"), (C("s_nationkey") % 4).alias("provider"))
    rows = read(s, d, "supplier").filter("s_suppkey % 3 = 0").select(C("s_name").alias("model"), F.lit(1).alias("provider"), "s_acctbal")
    return payloads.matched_capabilities(rows, known).select("model", "provider", "s_acctbal")


# -- maintenance


def u07(s, d):
    old = F.create_map(F.lit("a"), C("title"), F.lit("b"), C("provider"))
    new = F.when(C("id") % 3 != 0, F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.coalesce("source_name", F.lit("-"))))
    return wire(s, d).select("id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(stories.merged(old, new))))).alias("merged"))


def _stories(s, d):
    o = read(s, d, "orders")
    return o.select(C("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Story "), "o_orderkey").alias("title"), F.lit("old").alias("summary"), C("o_orderstatus").alias("status"), C("o_orderdate").alias("first_seen_at"), C("o_orderdate").alias("last_seen_at"), F.when(C("o_orderkey") % 3 == 0, F.concat(F.lit("sig"), "o_orderkey")).alias("cluster_signature"), F.concat(F.lit("leg"), F.floor(C("o_orderkey") / 2)).alias("legacy_cluster_signature"), F.create_map(F.lit("v"), F.lit("1")).alias("metadata"))


def _incoming(s, d):
    p = read(s, d, "part")
    return p.select(F.concat(F.when(C("p_partkey") % 2 == 0, "sig").otherwise("new"), "p_partkey").alias("signature"), F.when(C("p_partkey") % 4 != 0, F.concat(F.lit("leg"), C("p_partkey") * 5)).alias("legacy"), F.concat(F.lit("Part "), "p_partkey").alias("title"), C("p_name").alias("summary"), F.create_map(F.lit("v"), F.lit("2"), F.lit("w"), C("p_type")).alias("metadata"), F.to_timestamp(F.lit("2001-01-01 00:00:00")).alias("seen_at"))


_ST = "(SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, o_orderdate AS first_seen_at, CASE WHEN o_orderkey % 3 = 0 THEN 'sig' || o_orderkey END AS cs, 'leg' || (o_orderkey // 2) AS ls, 'Story ' || o_orderkey AS title FROM orders)"
_IN = "(SELECT (CASE WHEN p_partkey % 2 = 0 THEN 'sig' ELSE 'new' END) || p_partkey AS signature, CASE WHEN p_partkey % 4 <> 0 THEN 'leg' || (p_partkey * 5) END AS legacy, 'Part ' || p_partkey AS title FROM part)"
J08 = f"SELECT i.signature, i.legacy, i.title, coalesce((SELECT min(id) FROM {_ST} t WHERE t.cs = i.signature), (SELECT min(id) FROM {_ST} t WHERE t.ls = i.signature), (SELECT min(id) FROM {_ST} t WHERE t.cs = i.legacy), (SELECT min(id) FROM {_ST} t WHERE t.ls = i.legacy)) AS story_id FROM {_IN} i"


def j08(s, d):
    return stories.by_signature(_incoming(s, d), _stories(s, d)).select("signature", "story_id")


def m05(s, d):
    return stories.upsert_by_signature(_stories(s, d), _incoming(s, d)).select("id", "title", "status", "first_seen_at", F.element_at("metadata", "v").alias("v"), F.element_at("metadata", "w").isNotNull().alias("typed"))


def m10(s, d):
    pubs = read(s, d, "lineitem").select(C("l_orderkey").alias("story_id"), "l_linenumber")
    st, left = stories.reset(read(s, d, "orders").select(C("o_orderkey").alias("id"), C("o_orderstatus").alias("status")), pubs, read(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(C("o_orderkey").alias("id")))
    n = left.groupBy(C("story_id").alias("id")).agg(F.count("*").alias("publications"))
    return st.join(n, "id", "left").select("id", "status", F.coalesce("publications", F.lit(0)).alias("publications"))


def m01(s, d):
    """Every second page comes again with its canonical address only, some of them twice, and as many pages are new."""
    p = read(s, d, "pages").select("page_id", "url", F.length("html").alias("size"))
    again = p.filter("page_id % 2 = 0").select("page_id", F.concat("url", F.lit("#1")).alias("url"))
    twice = p.filter("page_id % 6 = 0").select("page_id", F.concat("url", F.lit("#2")).alias("url"))
    fresh = p.select((-C("page_id") - 1).alias("page_id"), "url")
    return tables.upsert(p, again.union(twice).union(fresh), ["page_id"])


def m02(s, d):
    kind = F.when(C("s_suppkey") % 2 == 0, "rss").otherwise("api")
    rows = read(s, d, "supplier").select(F.concat(F.lit("Source "), C("s_nationkey")).alias("name"), kind.alias("source_type"))
    known = read(s, d, "supplier").filter("s_acctbal > 0").groupBy(F.concat(F.lit("Source "), C("s_nationkey")).alias("name"), kind.alias("source_type")).agg(F.concat(F.lit("id"), F.min("s_suppkey")).alias("id"))
    return tables.get_or_create(rows, known, ["name", "source_type"], "src_")


def m07(s, d):
    """Reservations for stories without live publications, and what posting them gives."""
    pubs = read(s, d, "lineitem").groupBy(C("l_orderkey").alias("story_id")).agg(F.min("l_linenumber").alias("id"), F.max(F.when(C("l_returnflag") == "A", "PUBLISHED").when(C("l_returnflag") == "R", "publishing").otherwise("draft")).alias("status"), F.max("l_shipdate").cast("timestamp").alias("started_at"))
    live = stories.live_publications(pubs, F.to_timestamp(F.lit("2001-06-01")), 30, with_stale=False)
    own = read(s, d, "orders").select(C("o_orderkey").alias("id"), F.concat(F.lit("Post "), "o_orderkey").alias("content"))
    made = tables.reserved(own, live, as_of())
    results = read(s, d, "orders").filter("o_orderkey % 5 <> 0").select(C("o_orderkey").alias("story_id"), F.when(C("o_orderkey") % 3 == 0, "PUBLISHED").when(C("o_orderkey") % 3 == 1, "unknown").otherwise("FAILED").alias("status"), F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit("x"), "o_orderkey")).alias("external_id"))
    return tables.finalized(made, results, as_of()).select("story_id", "status", "idempotency_key", "content_sha256", "external_post_id", "published_at")


_LIVE = "(SELECT l_orderkey AS story_id, max(CASE l_returnflag WHEN 'A' THEN 'PUBLISHED' WHEN 'R' THEN 'publishing' ELSE 'draft' END) AS status, max(l_shipdate) AS seen FROM lineitem GROUP BY 1)"
_BLOCK = f"(SELECT story_id FROM {_LIVE} WHERE lower(status) = 'published' OR (status = 'publishing' AND NOT seen <= TIMESTAMP '2001-06-01' - INTERVAL 30 MINUTE))"


QUERIES = {
    "n03_dedupe_urls": (n03, f"SELECT min(page_id) AS page_id, c AS canonical_url FROM (SELECT page_id, {CANONICAL} AS c FROM pages) GROUP BY c"),
    "n04_article_key": (n04, f"SELECT id, CASE WHEN coalesce(trim(url), '') = '' THEN '' WHEN regexp_matches(lower(url), '^https?://') THEN {CANONICAL} END AS key FROM {W}"),
    "n08_item_id": (n08, f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'g' || page_id ELSE left(sha256({CANONICAL}), 16) END AS item_id FROM pages"),
    "n14_wrappers": (n14, f"SELECT id, coalesce(regexp_matches(url, '^https?://news\\.google\\.com/rss/articles/'), false) AS wrapper, nullif(regexp_extract(url, '^https?://news\\.google\\.com/rss/articles/([^/?#]*)', 1), '') AS wrapped_id FROM {W}"),
    "n15_unwrapped": (n15, f"SELECT id, CASE WHEN id % 4 <> 0 THEN 'https://www.pub.org/a/' || id END AS publisher_url FROM {W}"),
    "n18_portal_sections": (n18, f"SELECT p_partkey, regexp_matches(lower({_ANYPATH}), '^/?$|^/{_SECTION}/?$|^/index\\.html$') AS portal FROM (SELECT p_partkey, {_landing(True)} AS url FROM part)"),
    "n19_cleanup_portal": (n19, f"SELECT id, {_PORTALS} OR regexp_matches(lower({_ANYPATH}), '^/*$|^/+{_SECTION}/*$') AS portal FROM {W}"),
    "n22_publisher": (n22, f"SELECT id, CASE WHEN suffix(CASE WHEN contains(n, '://') THEN regexp_extract(n, '://([^/?#:]*)', 1) ELSE lower(n) END, 'google.com') OR (provider = 'google_news' AND lower(n) IN ('google news', 'google news rss')) THEN h ELSE n END AS publisher_name, CASE WHEN suffix(dm, 'google.com') THEN h ELSE dm END AS publisher_domain FROM (SELECT *, {_NAME} AS n, regexp_replace(lower(coalesce(source_domain, h)), '^www\\.', '') AS dm FROM (SELECT *, {_ANYHOST} AS h FROM {W}))"),
    "n23_canonical_fallback": (n23, f"SELECT id, CASE WHEN id % 3 = 1 THEN 'https://own.org/' || id WHEN id % 3 = 0 AND {_ANYHOST} <> '' AND {_ANYHOST} <> 'news.google.com' THEN url ELSE 'https://final.org/' || id END AS canonical_url FROM {W}"),
    "n24_source_type": (n24, f"SELECT id, CASE WHEN lower(source_name) IN ('google news', 'gdelt') OR source_domain = 'news.google.com' THEN 'AGGREGATOR' ELSE 'UNKNOWN' END AS source_type FROM {W}"),
    "d03_date_formats": (d03, "SELECT event_id, CASE event_id % 7 WHEN 0 THEN date_trunc('second', ts) WHEN 6 THEN NULL ELSE date_trunc('day', ts) END AS shown FROM events"),
    "d04_iso_and_utc": (d04, f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('second', ts) END AS iso, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END AS utc, ts <= {MOMENT} AND ts >= {MOMENT} - INTERVAL 7 DAY AS last_week FROM events"),
    "d08_story_date": (d08, "SELECT o_orderkey, greatest(max(l_shipdate::DATE), CASE WHEN o_orderkey % 5 <> 0 THEN any_value(o_orderdate::DATE) END) AS story_date FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"),
    "t07_plain_sentences": (t07, "SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(text, E' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))::INT AS n_sentences FROM documents"),
    "t10_jaccard": (t10, None),
    "t12_sentence_score": (t12, None),
    "t13_compress_to_limit": (t13, None),
    "t14_finished_sentence": (t14, None),
    "t16_source_appended": (t16, f"SELECT story_id, CASE WHEN NOT contains(post, 'https://') AND length(trim(post)) + 25 <= 60 THEN trim(post) || chr(10) || 'https://www.pub1.org/a/1' ELSE post END AS post FROM {derived.sql('posts')}"),
    "t17_source_reference": (t17, f"SELECT story_id, w = 'https://www.pub1.org/a/1' AS reference, CASE WHEN starts_with(w, 'https://') THEN w END AS url FROM (SELECT *, regexp_extract(post, '([^ ]*)$', 1) AS w FROM {derived.sql('posts')})"),
    "t18_topic_and_style": (t18, f"SELECT id, CASE WHEN coalesce(lower(trim(raw_category)), '') NOT IN ('', 'news', 'general') THEN trim(raw_category) ELSE regexp_extract(title, '^([^ ]+ [^ ]+)', 1) END AS topic, regexp_matches(lower(title), 'died|death|war|disaster|killed|shooting|attack|victim|election|referendum') AS sensitive, CASE WHEN regexp_matches(lower(title), 'died|death|war|disaster|killed|shooting|attack|victim|election|referendum') THEN 'ANALYTICAL,INFORMATIVE,SERIOUS' ELSE 'ANALYTICAL,CONVERSATIONAL,ENTHUSIASTIC,HUMOROUS,INFORMATIVE,SARCASTIC' END AS styles FROM {W}"),
    "t22_headline": (t22, f"SELECT id, CASE WHEN id % 3 = 0 THEN title ELSE nullif(regexp_extract(coalesce(body, ''), '^(.*?[.!?])(?:\\s|$)', 1), '') END AS headline FROM {W}"),
    "t23_evidence_block": (t23, f"SELECT story_id, string_agg('- evidence_id=' || evidence_id || ' source_id=' || source_id || ' url=' || coalesce(url, 'None'), chr(10) ORDER BY pos) AS block FROM {derived.sql('evidence')} GROUP BY 1"),
    "t24_source_line": (t24, f"SELECT story_id, 'Said.' || chr(10) || CASE WHEN story_id % 3 = 0 THEN 'https://a.org/x.' ELSE (CASE WHEN story_id % 2 = 0 THEN 'Source: ' ELSE 'source:  ' END) || 'https://b.org/y' END AS post FROM {derived.sql('posts')}"),
    "t25_first_json": (t25, f"SELECT id, CASE WHEN id % 4 <> 3 THEN id END AS a FROM {W}"),
    "c01_synonyms": (c01, f"SELECT id, {c01_sql('raw_category', False)} AS strict, {c01_sql('raw_category', True)} AS partial FROM {W}"),
    "c02_category_lists": (c02, f"SELECT id, array_to_string(l, ',') AS loose, array_to_string(t, ',') AS strict, array_to_string(list_filter(t, lambda c: c <> 'SPORTS'), ',') AS allowed FROM (SELECT id, list_sort(list_distinct(list_filter([{c01_sql('raw_category', True)}, {c01_sql('other_category', True)}], lambda c: c IS NOT NULL))) AS l, list_sort(list_distinct(list_filter([{c01_sql('raw_category', False)}, {c01_sql('other_category', False)}], lambda c: c IS NOT NULL))) AS t FROM {W})"),
    "c07_full_taxonomy": (c07, f"SELECT id, array_to_string({_ALL}, ',') AS categories, coalesce({_PRIMARY}, ({_ALL})[1]) AS primary_category, len({_ALL}) > 0 AS topic_fit, {_NEWSY} AS newsworthiness FROM {W}"),
    "c09_categories_at_read": (c09, f"SELECT id, CASE id % 4 WHEN 0 THEN coalesce(raw_category, '') WHEN 1 THEN 'A,B' WHEN 2 THEN 'C' ELSE '' END AS categories FROM {W}"),
    "c10_assessed_flags": (c10, f"SELECT id, CASE WHEN topic_fit IS NOT NULL AND newsworthiness IS NOT NULL THEN topic_fit ELSE len({_ALL}) > 0 END AS topic_fit, CASE WHEN topic_fit IS NOT NULL AND newsworthiness IS NOT NULL THEN newsworthiness ELSE {_NEWSY} END AS newsworthiness FROM {W}"),
    "c11_publication_status": (c11, f"SELECT id, CASE WHEN v IN ('draft', 'publishing', 'published', 'failed', 'recovery_required') THEN v END AS status FROM (SELECT id, CASE lower(trim(status)) WHEN 'approved' THEN 'recovery_required' WHEN 'blocked' THEN 'failed' WHEN 'dry_run' THEN 'draft' WHEN 'skipped_dry_run' THEN 'draft' WHEN 'unknown' THEN 'recovery_required' ELSE lower(trim(status)) END AS v FROM {W})"),
    "f01_valid_wire": (f01, f"SELECT id FROM {W} WHERE url <> '' AND length(trim(title)) >= 15 AND NOT {_STORE} AND NOT {_LAND} AND NOT {_PT}"),
    "f02_wire_reject_reason": (f02, F02),
    "f03_build_gate": (f03, f"SELECT id, CASE WHEN len({_ALLOWED}) = 0 THEN 'NO_VALID_CATEGORY' WHEN NOT {_NEWSY} THEN 'NOT_NEWSWORTHY' END AS reason FROM {W}"),
    "f08_qualified_candidates": (f08, f"SELECT id, array_to_string(list_filter(t, lambda c: c <> 'SPORTS'), ',') AS categories FROM (SELECT *, list_sort(list_distinct(list_filter([{c01_sql('raw_category', False)}, {c01_sql('other_category', False)}], lambda c: c IS NOT NULL))) AS t FROM {W}) WHERE len(list_filter(t, lambda c: c <> 'SPORTS')) > 0 AND id % 9 > 0 AND published_at <= {MOMENT} + INTERVAL 1 DAY AND published_at >= {MOMENT} - INTERVAL 30 DAY AND CASE WHEN topic_fit IS NOT NULL AND newsworthiness IS NOT NULL THEN topic_fit AND newsworthiness ELSE len({_ALL}) > 0 AND {_NEWSY} END AND NOT list_has_any(list_transform(string_split(title, ' '), lambda w: upper(w)), {_LIST(taxonomy.REJECTED)}) AND NOT list_has_any(list_transform([coalesce(raw_category, ''), coalesce(other_category, '')], lambda w: replace(replace(upper(trim(w)), ' ', '_'), '-', '_')), {_LIST(taxonomy.REJECTED)})"),
    "f25_run_outcome": (f25, f"SELECT id, CASE o WHEN 'PASS' THEN CASE WHEN id % 4 = 0 THEN 'DRY_RUN' ELSE 'SYSTEM_ERROR' END WHEN 'BLOCKED' THEN CASE WHEN id % 4 = 1 THEN 'RECOVERY_REQUIRED' ELSE 'SYSTEM_ERROR' END WHEN 'ESCALATE' THEN 'SYSTEM_ERROR' ELSE o END AS outcome FROM (SELECT id, (['PASS', 'BLOCKED', 'ESCALATE', 'PUBLISHED', 'CANDIDATE_REJECTED', 'SYSTEM_ERROR'])[(id % 6 + 1)::INT] AS o FROM {W})"),
    "f29_recency_buckets": (f29, "SELECT event_type, " + ", ".join(f"count(*) FILTER (ts <= {MOMENT} AND ts >= {MOMENT} - INTERVAL {n} DAY) AS last_{b}" for b, n in (("d", 1), ("w", 7), ("m", 30), ("y", 365))) + " FROM events GROUP BY 1"),
    "a14_ingest_audit": (a14_audit, _A14),
    "h04_containers": (h04, None),
    "h06_cascade": (h06, None),
    "h07_enriched_items": (h07, None),
    "h08_extraction_need": (h08, f"SELECT doc_id, doc_id % 9 = 0 OR length({_LONG}) < 500 OR length(trim('about ' || coalesce(source, '') || ' ' || {_LONG})) < 500 AS needed FROM documents"),
    "r01_extraction_ranking": (r01, f"SELECT provider, id AS pos, length(trim({_CONTENT})) < 500 AND length(trim(coalesce(body, ''))) < 500 AS thin, len({full_categories(f'''title || ' ' || coalesce(body, '') || ' ' || {_CONTENT}''')}) > 0 AND NOT regexp_matches(lower(title), '{taxonomy.NOT_NEWS}') AND regexp_matches(lower(title || ' ' || coalesce(body, '') || ' ' || {_CONTENT}), '{taxonomy.DEVELOPMENT}') AS useful FROM {W} ORDER BY published_at DESC NULLS LAST, CASE WHEN id % 3 = 0 THEN id % 4 ELSE 1000 END, thin DESC, useful DESC, provider, pos LIMIT 50"),
    "r03_reporting_candidates": (r03, "SELECT o_orderkey AS id, count(*) AS source_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey ORDER BY any_value(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END) DESC NULLS LAST, source_count DESC, id LIMIT 30"),
    "r05_diverse_candidates": (r05, "WITH o AS (SELECT o_orderkey AS id, c_mktsegment AS m, o_orderpriority AS p, o_orderdate, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 2 = 0)::INT END, 0) + (o_orderkey % 5 = 0)::INT AS quality FROM orders JOIN customer ON c_custkey = o_custkey), n AS (SELECT m, count(*) AS n FROM o WHERE o_orderdate >= '1998-01-01' GROUP BY m), l AS (SELECT l_orderkey AS id, count(DISTINCT l_suppkey % 7)::INT AS publishers, count(*) AS sources FROM lineitem GROUP BY 1) SELECT id, quality, publishers, coalesce(n, 0) AS covered FROM o JOIN l USING (id) LEFT JOIN n USING (m) ORDER BY quality DESC, publishers DESC, covered, sources DESC, id LIMIT 40"),
    "r08_recent_publications": (r08, f"SELECT id, story_id FROM {_PUBS} WHERE platform = 'threads' AND lower(status) = 'published' AND published_at >= {MOMENT} - INTERVAL 24 HOUR ORDER BY published_at DESC, id LIMIT 30"),
    "r09_recent_stories": (r09, "SELECT id FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 <> 0 OR o_orderkey % 4 = 0 THEN o_orderdate END AS t FROM orders) WHERE t IS NULL OR t >= TIMESTAMP '1998-12-30' ORDER BY t DESC NULLS LAST, id LIMIT 60"),
    "r14_newest": (r14, f"SELECT id, status FROM {_PUBS} ORDER BY published_at DESC, id LIMIT 10"),
    "r15_evidence_order": (r15, f"SELECT h AS host, page_id, pos::INT AS pos FROM (SELECT h, page_id, row_number() OVER (PARTITION BY h ORDER BY page_id) AS pos FROM (SELECT h, min(page_id) AS page_id FROM (SELECT page_id, {HOST} AS h, {CANONICAL} AS c FROM pages) GROUP BY h, c)) WHERE pos <= 3"),
    "r16_bounded_attempts": (r16, f"SELECT event_id, CASE WHEN coalesce(max((event_type NOT IN ('click', 'view'))::INT) {_BEFORE}, 0) = 1 OR coalesce(sum((event_type = 'view')::INT) {_BEFORE}, 0) >= 2 THEN 'SKIPPED' ELSE 'ATTEMPTED' END AS state FROM events"),
    "r18_latest_topic": (r18, f"SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' || o_orderkey ELSE lower(o_orderpriority) END AS topic FROM orders WHERE o_orderkey IN (SELECT story_id FROM {_PUBS} WHERE lower(status) = 'published') ORDER BY o_orderdate DESC, o_orderkey LIMIT 1"),
    "a06_ingest_metrics": (a06, "SELECT user_id % 7 AS provider, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in ("click", "error", "purchase", "view")) + " FROM events GROUP BY 1"),
    "a09_ingest_summary": (a09, None),
    "a12_verification_counts": (a12, "SELECT CASE f WHEN 'A' THEN 'SUPPORTED' WHEN 'R' THEN 'SUPPORTED_AS_ATTRIBUTED' ELSE 'CONTRADICTED' END AS status, count(*) AS n FROM (SELECT min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1"),
    "a13_publisher_count": (a13, "SELECT l_orderkey, count(DISTINCT l_suppkey % 5)::INT AS publishers FROM lineitem GROUP BY 1"),
    "a20_social_counts": (a20, "SELECT count(*) FILTER (turn = 0) AS posts, count(DISTINCT conv_id % 20 + turn % 3) AS profiles, count(*) FILTER (turn = 1) AS replies, count(*) FILTER (turn > 1) AS conversation_entries, count(DISTINCT conv_id) AS conversations FROM conversations"),
    "a23_restricted_coverage": (a23, f"SELECT count(*) FILTER ({_ANYHOST} = 'news.google.com' OR suffix({_ANYHOST}, '.news.google.com')) AS direct, count(*) FILTER (id % 6 = 0) AS mentions FROM {W}"),
    "m12_social_rows": (m12, "SELECT conv_id || '-' || turn AS id, 'u' || (conv_id % 20 + turn % 3) AS author_username, TIMESTAMP '2024-01-02 03:04:05' AS created_at, (turn % 3 = 0)::INT AS media, CASE WHEN turn % 3 = 0 THEN CASE WHEN turn % 2 = 0 THEN 'IMAGE' ELSE 'unknown' END END AS media_type, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS reply_to_id, CASE WHEN turn > 0 THEN conv_id || '-0' END AS conversation_id, turn > 0 AS is_reply FROM conversations"),
    "p01_weighted_score": (p01, f"SELECT id, round({_P01}, 6)::DOUBLE AS score FROM {W}"),
    "s06_first_per_query": (s06, "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 3"),
    "s08_tolerant_payloads": (s08, f"SELECT id, CASE WHEN id % 7 = 0 THEN 2 WHEN id % 11 = 0 THEN 1 WHEN id % 13 = 0 OR id % 5 = 4 THEN 0 ELSE 3 END AS items, CASE WHEN id % 7 = 0 THEN 1 WHEN id % 11 = 0 THEN id WHEN id % 13 = 0 OR id % 5 = 4 THEN NULL ELSE id END AS first FROM {W}"),
    "s12_content_types": (s12, f"SELECT id FROM {W} WHERE id % 7 NOT IN (1, 3)"),
    "s13_equality_scan": (s13, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW'"),
    "s17_capability_fallback": (s17, "SELECT s_name AS model, s_nationkey % 4 AS provider FROM supplier WHERE s_nationkey < 12"),
    "j16_capability_match": (j16, "SELECT s_name AS model, 1 AS provider, s_acctbal FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey % 4 = 1"),
    "u07_merged_metadata": (u07, None),
    "j08_story_by_signature": (j08, f"SELECT signature, story_id FROM ({J08})"),
    "m05_story_upsert": (m05, f"WITH f AS ({J08}), n AS (SELECT story_id, arg_max(title, signature) AS title FROM f WHERE story_id IS NOT NULL GROUP BY 1) SELECT s.id, coalesce(n.title, s.title) AS title, s.status, s.first_seen_at, CASE WHEN n.story_id IS NULL THEN '1' ELSE '2' END AS v, n.story_id IS NOT NULL AS typed FROM {_ST} s LEFT JOIN n ON n.story_id = s.id UNION ALL SELECT 'st_' || left(signature, 20), title, 'candidate', TIMESTAMP '2001-01-01', '2', true FROM f WHERE story_id IS NULL"),
    "m10_reset_stories": (m10, "SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'candidate' ELSE o_orderstatus END AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE count(l_orderkey) END AS publications FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus"),
    "m01_partial_upsert": (m01, "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN url || '#2' WHEN page_id % 2 = 0 THEN url || '#1' ELSE url END AS url, length(html) AS size, CASE WHEN page_id % 2 = 0 THEN 'updated' ELSE 'kept' END AS change FROM pages UNION ALL SELECT -page_id - 1, url, NULL, 'inserted' FROM pages"),
    "m02_typed_sources": (m02, "WITH r AS (SELECT DISTINCT 'Source ' || s_nationkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'rss' ELSE 'api' END AS source_type FROM supplier), k AS (SELECT 'Source ' || s_nationkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'rss' ELSE 'api' END AS source_type, 'id' || min(s_suppkey) AS id FROM supplier WHERE s_acctbal > 0 GROUP BY 1, 2) SELECT name, source_type, coalesce(id, 'src_' || left(sha256(name || chr(0) || source_type), 20)) AS id, id IS NULL AS created FROM r LEFT JOIN k USING (name, source_type)"),
    "m07_reservations": (m07, f"SELECT o_orderkey AS story_id, CASE WHEN o_orderkey % 5 = 0 THEN 'publishing' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'published' ELSE 'recovery_required' END WHEN o_orderkey % 3 = 1 THEN 'recovery_required' ELSE 'failed' END AS status, sha256('threads' || chr(0) || o_orderkey || chr(0) || 'Post ' || o_orderkey) AS idempotency_key, sha256('Post ' || o_orderkey) AS content_sha256, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN 'x' || o_orderkey END AS external_post_id, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 6 = 0 THEN {MOMENT} END AS published_at FROM orders WHERE o_orderkey NOT IN {_BLOCK}"),
}
