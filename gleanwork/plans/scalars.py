"""Queries over the column functions: URLs, text, dates, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, taxonomy, text, urls

C = F.col
AS_OF = "2024-01-20 00:00:00"
#: A signal table in the words of the test corpus.
SIGNALS = {"FINANCE": r"\b(?:with|from)\b", "HEALTH": r"\b(?:der|die)\b", "SCIENCE": r"\b(?:that|this)\b", "WORLD_EVENTS": r"\b(?:les|des)\b"}
PRIORITY = ["SCIENCE", "HEALTH", "FINANCE", "WORLD_EVENTS"]
STOP = "[" + ",".join(f"'{w}'" for w in text.TITLE_STOPWORDS) + "]"
CLAIM_STOP = "[" + ",".join(f"'{w}'" for w in text.CLAIM_STOPWORDS) + "]"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def titled(spark: SparkSession, d: str) -> DataFrame:
    """documents with their first line, at most 80 characters of it, as title."""
    return read(spark, d, "documents").withColumn("title", F.left(F.regexp_extract("text", r"^([^\n]*)", 1), F.lit(80)))


TITLED = "(SELECT *, left(regexp_extract(text, '^([^\\n]*)', 1), 80) AS title FROM documents)"
HOST = "regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)), '^www\\.', '')"
PATH = "(CASE WHEN regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) END)"
_PAIRS = "list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(regexp_extract(p, '^([^=]*)', 1)), '" + "^(?:(?:utm_|ga_|mc_|pk_).*|(?:fbclid|gclid|dclid|msclkid|yclid|_openstat|igshid|ref|ref_src|ref_url|spm|cmpid|ncid))$" + "')))"
_CPATH = f"(CASE WHEN regexp_replace({PATH}, '/+', '/', 'g') = '/' THEN '/' ELSE regexp_replace(regexp_replace({PATH}, '/+', '/', 'g'), '/$', '') END)"
_QUERY = f"array_to_string(list_transform({_PAIRS}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&')"
CANONICAL = f"(lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) || {_CPATH} || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END)"
CLEAN = "regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '[ \\t\\x{00a0}]+', ' ', 'g'), chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
NORMAL = "trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_WORDS = f"list_filter(string_split({NORMAL}, ' '), lambda w: w <> '')"
_TELLING = f"list_slice(list_sort(list_filter({_WORDS}, lambda w: length(w) > 2 AND NOT list_contains({STOP}, w))), 1, 8)"
SIGNATURE = f"array_to_string(CASE WHEN len({_TELLING}) > 0 THEN {_TELLING} ELSE list_slice({_WORDS}, 1, 4) END, ' ')"


def claim_tokens_sql(column: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda w: NOT list_contains({CLAIM_STOP}, w))"
    return f"list_distinct(list_transform({kept}, lambda w: CASE WHEN w = 'fell' THEN 'fall' WHEN suffix(w, 'ies') AND length(w) > 4 THEN left(w, -3) || 'y' WHEN suffix(w, 'ed') AND length(w) > 4 THEN left(w, -2) WHEN suffix(w, 's') AND length(w) > 3 THEN left(w, -1) ELSE w END))"


def _unicode_edges(pattern: str) -> str:
    """RE2's word boundary knows ASCII only."""
    return pattern.replace(r"\b(", r"(?:^|[^\p{L}\p{N}_])(", 1).replace(r")\b", r")(?:$|[^\p{L}\p{N}_])", 1)


def categories_sql(column: str) -> str:
    low = f"regexp_replace(lower({column}), '\\s+', ' ', 'g')"
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({low}, '{_unicode_edges(p)}') THEN '{c}' END" for c, p in sorted(SIGNALS.items())) + "], lambda c: c IS NOT NULL)"


def n01(s, d):
    return read(s, d, "pages").select("page_id", urls.canonicalize_url(C("url")).alias("canonical_url"))


def n02(s, d):
    return read(s, d, "pages").select("page_id", urls.strip_tracking(urls.query_string(C("url"))).alias("query"))


def n06(s, d):
    return read(s, d, "documents").select("doc_id", text.content_hash(C("text")).alias("content_hash"))


def n07(s, d):
    c = urls.canonicalize_url(C("url"))
    return read(s, d, "pages").select("page_id", F.sha2(c, 256).alias("canonical_hash"), urls.short_hash(c, 16).alias("item_id"), urls.short_hash(C("url"), 24, "ni_").alias("alternate_id"), urls.short_hash(C("url"), 20, "ev_").alias("evidence_id"))


def n12(s, d):
    key = F.sha2(F.concat_ws("\0", F.lit("threads"), C("doc_id").cast("string"), C("text")), 256)
    return read(s, d, "documents").select("doc_id", key.alias("idempotency_key"))


def n13(s, d):
    return read(s, d, "pages").select("page_id", urls.host(C("url")).alias("host"), urls.is_http_url(C("url")).alias("is_http"), urls.is_placeholder(C("url")).alias("placeholder"), urls.is_portal(C("url")).alias("portal"), urls.is_store(C("url")).alias("store"), urls.is_extractable(C("url")).alias("extractable"))


def n17(s, d):
    url = F.concat(F.lit("https://x.org/"), F.date_format("o_orderdate", "yyyy/MM/"), (C("o_orderkey") % 40).cast("string"), F.lit("/story"))
    return read(s, d, "orders").select("o_orderkey", urls.date_in_path(url).alias("url_date"))


def d01(s, d):
    e = read(s, d, "events")
    iso, mail = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.lit("Mon, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    compact, shown = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.date_format("ts", "MMMM d, yyyy")
    return e.select("event_id", dates.publication_time(iso).alias("iso"), dates.publication_time(mail).alias("mail"), dates.compact_time(compact).alias("compact"), dates.shown_date(shown).alias("shown"), dates.publication_time(C("event_type")).alias("none"))


def d06(s, d):
    return read(s, d, "events").select("event_id", dates.is_current(C("ts"), as_of(), 7).alias("current"), dates.age_minutes(C("ts"), as_of()).alias("age"), dates.is_stale(C("ts"), as_of(), 30).alias("stale"), F.date_trunc("day", "ts").alias("day"))


def t01(s, d):
    return read(s, d, "documents").select("doc_id", text.clean_text(C("text")).alias("cleaned"))


def t02(s, d):
    return titled(s, d).select("doc_id", text.normalize_title(C("title")).alias("normalized"), text.title_signature(C("title")).alias("signature"), urls.short_hash(text.title_signature(C("title")), 16).alias("signature_hash"))


def t04(s, d):
    return titled(s, d).select("doc_id", F.array_join(text.entities(C("title")), " ").alias("entities"))


def t05(s, d):
    return read(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(text.claim_tokens(C("text"))), " ").alias("tokens"))


def t08(s, d):
    return read(s, d, "benchmark").select("item_id", F.size(text.word_ngrams(C("text"))).alias("n_grams"), F.array_min(text.word_ngrams(C("text"))).alias("least"))


def t11(s, d):
    return titled(s, d).select("doc_id", text.truncate_words(C("title"), 40).alias("cut"), text.ensure_ending(C("title")).alias("ended"), text.summary(F.lit(""), C("text")).alias("summary"), text.quote_line(C("title"), C("source")).alias("quote"))


def t12(s, d):
    cues = ["said", "that", "die", "les"]
    return titled(s, d).select("doc_id", text.importance(C("title"), cues, F.lit(1)).alias("importance"))


def t13(s, d):
    short = text.compress(C("text"), 300, ["said", "that"])
    return read(s, d, "documents").select("doc_id", short.alias("compressed"), F.length(short).alias("n"))


def t06(s, d):
    return read(s, d, "documents").select("doc_id", F.size(text.sentences(C("text"))).alias("n_sentences"))


def c04(s, d):
    return read(s, d, "documents").select("doc_id", F.array_join(taxonomy.infer_categories(C("text"), SIGNALS), ",").alias("categories"))


def c05(s, d):
    rows = titled(s, d).select("doc_id", taxonomy.classify(C("title"), C("text"), SIGNALS, PRIORITY).alias("k"))
    return rows.select("doc_id", F.array_join("k.categories", ",").alias("categories"), "k.primary_category", "k.topic_fit", "k.article_quality")


def c01(s, d):
    synonyms = {"building": "BUSINESS", "machinery": "TECHNOLOGY"}
    return read(s, d, "customer").select("c_custkey", taxonomy.normalize_category(C("c_mktsegment"), synonyms).alias("category"), taxonomy.normalize_category(C("c_mktsegment"), {"house": "HEALTH"}, True).alias("partial"), taxonomy.is_rejected_category(F.when(C("c_nationkey") % 2 == 0, "Tv-Schedules")).alias("rejected"))


TRIM_EDGE = "trim(w, '.,;:!?\"''()[]{}—–-')"
_G = f"list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: {TRIM_EDGE}), lambda w: w <> '' AND NOT list_contains({CLAIM_STOP}, w))"
GRAMS = f"(CASE WHEN len({_G}) >= 3 THEN list_distinct(list_transform(range(1, len({_G}) - 1), lambda i: array_to_string(list_slice({_G}, i, i + 2), ' '))) ELSE [] END)"
_K = categories_sql("title || ' ' || text")
_KT, _KB = categories_sql("title"), categories_sql("text")
_PICK = f"(CASE WHEN len({_KT}) > 0 THEN {_KT} ELSE {_KB} END)"
_BARE = "regexp_replace(trim(title), '(?:\\.\\.\\.|…)+$', '')"

QUERIES = {
    "n01_canonicalize_url": (n01, f"SELECT page_id, {CANONICAL} AS canonical_url FROM pages"),
    "n02_strip_tracking": (n02, f"SELECT page_id, {_QUERY} AS query FROM pages"),
    "n06_content_hash": (n06, f"SELECT doc_id, CASE WHEN {CLEAN} <> '' THEN sha256({CLEAN}) END AS content_hash FROM documents"),
    "n07_url_ids": (n07, f"SELECT page_id, sha256({CANONICAL}) AS canonical_hash, left(sha256({CANONICAL}), 16) AS item_id, 'ni_' || left(sha256(url), 24) AS alternate_id, 'ev_' || left(sha256(url), 20) AS evidence_id FROM pages"),
    "n12_idempotency_key": (n12, "SELECT doc_id, sha256('threads' || chr(0) || doc_id::VARCHAR || chr(0) || text) AS idempotency_key FROM documents"),
    "n13_url_facts": (n13, f"SELECT page_id, {HOST} AS host, regexp_matches(url, '^https?://\\S+$') AS is_http, regexp_matches({HOST}, '(^|\\.)example\\.[a-z]+$') AS placeholder, regexp_matches(lower({PATH}), '^/*$|^/(news|world|us|politics|business|tech|technology|latest|home)/?$') AS portal, regexp_matches(lower(url), 'download|play\\.google\\.com') AS store, regexp_matches(url, '^https?://\\S+$') AND NOT regexp_matches(lower({PATH}), '\\.(?:pdf|jpe?g|png|gif|mp[34]|zip)$|/(?:video|videos|gallery|live)/') AS extractable FROM pages"),
    "n17_url_date": (n17, "SELECT o_orderkey, try_cast(strftime(o_orderdate, '%Y-%m-') || lpad((o_orderkey % 40)::VARCHAR, 2, '0') AS DATE) AS url_date FROM orders"),
    "d01_timestamps": (d01, "SELECT event_id, date_trunc('second', ts) AS iso, date_trunc('second', ts) - INTERVAL 2 HOUR AS mail, date_trunc('second', ts) AS compact, date_trunc('day', ts) AS shown, NULL::TIMESTAMP AS none FROM events"),
    "d06_currency": (d06, f"SELECT event_id, ts <= TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS current, floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 60)::BIGINT AS age, ts <= TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE AS stale, date_trunc('day', ts) AS day FROM events"),
    "t01_clean_text": (t01, f"SELECT doc_id, {CLEAN} AS cleaned FROM documents"),
    "t02_title_signature": (t02, f"SELECT doc_id, {NORMAL} AS normalized, {SIGNATURE} AS signature, left(sha256({SIGNATURE}), 16) AS signature_hash FROM {TITLED}"),
    "t04_entities": (t04, None),
    "t05_claim_tokens": (t05, f"SELECT item_id, array_to_string(list_sort({claim_tokens_sql('text')}), ' ') AS tokens FROM benchmark"),
    "t06_sentences": (t06, None),
    "t08_word_ngrams": (t08, f"SELECT item_id, len({GRAMS})::INT AS n_grams, list_min({GRAMS}) AS least FROM benchmark"),
    "t11_shortening": (t11, f"SELECT doc_id, CASE WHEN length(title) <= 40 THEN title ELSE regexp_replace(left(title, 39), ' [^ ]*$', '') || '…' END AS cut, CASE WHEN regexp_matches({_BARE}, '[.!?]$') OR {_BARE} = '' THEN {_BARE} ELSE {_BARE} || '.' END AS ended, left(text, 280) AS summary, concat_ws(' — ', nullif(trim(title), ''), nullif(trim(source), '')) AS quote FROM {TITLED}"),
    "t12_importance": (t12, f"SELECT doc_id, CASE WHEN regexp_matches(title, '[0-9]') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(title), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:said|that|die|les)(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(title, ' [A-Z][a-z]+') THEN 2 ELSE 0 END - CASE WHEN length(title) > 200 THEN 1 ELSE 0 END AS importance FROM {TITLED}"),
    "t13_compression": (t13, None),
    "c01_normalize_category": (c01, "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'BUSINESS' WHEN 'MACHINERY' THEN 'TECHNOLOGY' END AS category, CASE WHEN contains(lower(c_mktsegment), 'house') THEN 'HEALTH' END AS partial, c_nationkey % 2 = 0 AS rejected FROM customer"),
    "c04_infer_categories": (c04, f"SELECT doc_id, array_to_string({categories_sql('text')}, ',') AS categories FROM documents"),
    "c05_classify": (c05, f"SELECT doc_id, array_to_string({_K}, ',') AS categories, coalesce(CASE WHEN list_contains({_PICK}, 'SCIENCE') THEN 'SCIENCE' WHEN list_contains({_PICK}, 'HEALTH') THEN 'HEALTH' WHEN list_contains({_PICK}, 'FINANCE') THEN 'FINANCE' WHEN list_contains({_PICK}, 'WORLD_EVENTS') THEN 'WORLD_EVENTS' END, ({_K})[1]) AS primary_category, len({_K}) > 0 AS topic_fit, CASE WHEN length(trim(text)) >= 500 THEN 'article' ELSE 'snippet' END AS article_quality FROM {TITLED}"),
}
