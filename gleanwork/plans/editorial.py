"""Queries of what a story's claims, evidence and posts must fulfil, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import claims as c_ops
from ..operators import posts as p_ops
from ..operators import similar, stories
from . import derived
from .scalars import as_of, claim_tokens_sql, read

C = F.col
CL, EV, VE, AS, PO = (derived.sql(n) for n in ("claims", "evidence", "verifications", "assessments", "posts"))
OK = "upper(status) IN ('SUPPORTED', 'SUPPORTED_AS_ATTRIBUTED')"


def _all(s, d):
    return tuple(derived.table(s, d, n) for n in ("claims", "evidence", "verifications", "assessments"))


def f15(s, d):
    c, e, v, _ = _all(s, d)
    done = p_ops.validated(derived.table(s, d, "posts"), c, e, v, 150)
    return done.select("story_id", F.array_join("errors", ",").alias("errors"), F.array_join("mapped_claim_ids", ",").alias("mapped"), "state")


def _linked(s, d):
    p = derived.table(s, d, "posts").select("story_id")
    first = p.select("story_id", F.when(C("story_id") % 3 == 0, "https://www.pub3.org/a/3.").alias("canonical_url"), F.lit("https://other.org/x").alias("url"))
    return first.union(p.filter("story_id % 2 = 0").select("story_id", F.lit(""), F.when(C("story_id") % 4 == 0, "https://www.pub1.org/a/1")))


def f15_linked(s, d):
    """All rules, where addresses of a story's linked sources may be named as well."""
    c, e, v, _ = _all(s, d)
    done = p_ops.validated(derived.table(s, d, "posts"), c, e, v, 150, _linked(s, d))
    return done.select("story_id", F.array_join("errors", ",").alias("errors"), "state")


def _anchors(ids: str) -> str:
    """The longest word of forecasts' attributions, as the derived table has them."""
    return "CASE WHEN is_forecast AND attribution = 'the Finance Ministry' THEN 'ministry' WHEN is_forecast AND attribution = 'aides' THEN 'aides' END"


_EDGE = "'.,;:!?\"''()[]{}—–-'"
_STOP = "[" + ",".join(f"'{w}'" for w in text.POST_STOPWORDS) + "]"
_SUBJECT = f"list_transform(list_filter(regexp_split_to_array(concat_ws(' ', seed_title, seed_summary), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, lower(w))), lambda w: trim(lower(w), {_EDGE}))"
_SENTENCES = "list_filter(string_split(regexp_replace(trim(post), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"
_DOC = f"""WITH c AS (SELECT *, {claim_tokens_sql('claim_text')} AS tokens, {_anchors('')} AS anchor FROM {CL}),
 v AS (SELECT story_id, claim_id, bool_or({OK}) AS verified FROM {VE} GROUP BY 1, 2),
 b AS (SELECT x.story_id, claim_id, bool_and(coalesce(starts_with(url, 'http'), false)) AS backed FROM (SELECT story_id, claim_id, unnest(evidence_ids) AS evidence_id FROM {CL}) x LEFT JOIN {EV} e USING (story_id, evidence_id) GROUP BY 1, 2),
 k AS (SELECT c.*, coalesce(verified, false) AS verified, coalesce(backed, false) AS backed FROM c LEFT JOIN v USING (story_id, claim_id) LEFT JOIN b USING (story_id, claim_id)),
 g AS (SELECT story_id, list({{'id': claim_id, 't': tokens, 'a': anchor, 'v': verified, 'b': backed}} ORDER BY claim_id) AS claims FROM k GROUP BY 1),
 u AS (SELECT story_id, list(DISTINCT url) AS urls FROM {EV} WHERE url IS NOT NULL GROUP BY 1),
 p AS (SELECT *, list_filter({_SENTENCES}, lambda x: NOT (starts_with(x, 'http') AND NOT contains(x, ' ') AND coalesce(list_contains(urls, rtrim(x, '.,;:!?)]}}')), false))) AS parts, regexp_extract_all(post, 'https?://\\S+') AS links, {_SUBJECT} AS subject,
   list_filter(claims, lambda q: q.v AND list_contains(allowed_claim_ids, q.id)) AS approved FROM {PO} JOIN g USING (story_id) LEFT JOIN u USING (story_id)),
 s AS (SELECT story_id, i, {claim_tokens_sql('part')} AS t FROM (SELECT story_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p WHERE len(approved) > 0)),
 m AS (SELECT s.*, len(t) < 2 AS thin, list_transform(list_filter(approved, lambda q: len(t) > 0 AND len(list_filter(t, lambda w: NOT list_contains(q.t, w))) = 0), lambda q: q.id) AS ids FROM s JOIN p USING (story_id)),
 l AS (SELECT story_id, min(i) FILTER (NOT thin AND len(ids) = 0) AS stop FROM m GROUP BY 1),
 w AS (SELECT m.story_id, bool_or(thin AND (stop IS NULL OR i < stop)) AS thin, any_value(stop) IS NOT NULL AS loose, coalesce(list_sort(list_distinct(flatten(list(ids) FILTER (NOT thin AND (stop IS NULL OR i < stop))))), []) AS mapped FROM m JOIN l USING (story_id) GROUP BY 1),
 a AS (SELECT story_id, i, {claim_tokens_sql('part')} AS t FROM (SELECT story_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p)),
 r AS (SELECT DISTINCT x.story_id FROM a x JOIN a y ON x.story_id = y.story_id AND x.i < y.i WHERE least(len(x.t), len(y.t)) > 0 AND len(list_intersect(x.t, y.t)) >= 0.7 * least(len(x.t), len(y.t)) AND len(list_intersect(x.t, y.t)) >= 0.4 * len(list_distinct(x.t || y.t))),
 f AS (SELECT p.*, coalesce(w.thin, false) AS thin, coalesce(w.loose, false) AS loose, coalesce(w.mapped, CAST([] AS VARCHAR[])) AS mapped, r.story_id IS NOT NULL AS again FROM p LEFT JOIN w USING (story_id) LEFT JOIN r USING (story_id))"""


def _less(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda x: NOT list_contains({b}, x))) > 0"


_IDS_OF = "list_transform(list_filter(claims, lambda q: {}), lambda q: q.id)"
_RULES = {
    "EMPTY_TEXT": "trim(post) = ''", "NUL_CHARACTER": "contains(post, chr(0))", "SOURCE_LABEL": "regexp_matches(post, '(?i)\\bSource\\s*[:-]')", "INTERNAL_INSTRUCTIONS": "contains(lower(post), 'return json')",
    "EDITORIAL_UNVERIFIED": _less("allowed_claim_ids", _IDS_OF.format("q.v")), "UNAPPROVED_CLAIM": _less("claim_ids", "allowed_claim_ids"), "UNKNOWN_CLAIM": _less("claim_ids", _IDS_OF.format("true")),
    "CLAIM_WITHOUT_EVIDENCE": "len(list_filter(claims, lambda q: list_contains(claim_ids, q.id) AND NOT q.b)) > 0", "DRAFT_UNAPPROVED": _less("draft_claim_ids", "allowed_claim_ids"), "NO_CLAIMS": "trim(post) <> '' AND len(claim_ids) = 0",
    "THIN_SENTENCE": "thin", "UNGROUNDED_SENTENCE": "loose", "MAPPING_DIFFERS": f"{_less('mapped', 'claim_ids')} OR {_less('claim_ids', 'mapped')}", "DRAFT_OMITS": _less("mapped", "draft_claim_ids"), "REPETITIVE": "again",
    "SEVERAL_URLS": "len(links) > 1", "UNVERIFIED_URL": "len(list_filter(links, lambda x: NOT coalesce(list_contains(urls, rtrim(x, '.,;:!?)]}')), false))) > 0",
    "LOST_ATTRIBUTION": "len(list_filter(claims, lambda q: list_contains(allowed_claim_ids, q.id) AND q.a IS NOT NULL AND NOT contains(lower(post), q.a))) > 0", "LOST_SUBJECT": "len(subject) > 0 AND len(list_filter(subject, lambda x: contains(lower(post), x))) = 0", "TOO_LONG": "length(post) > {limit}",
}


def _errors(names: list[str], limit: int) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_RULES[n].replace('{limit}', str(limit))} THEN '{n}' END" for n in names) + ")"


_F15 = _errors(list(_RULES), 150)
_LINKED = f"SELECT story_id, CASE WHEN story_id % 3 = 0 THEN 'https://www.pub3.org/a/3' ELSE 'https://other.org/x' END AS url FROM {PO} UNION ALL SELECT story_id, 'https://www.pub1.org/a/1' FROM {PO} WHERE story_id % 4 = 0"
_DOC_LINKED = _DOC.replace(f"list(DISTINCT url) AS urls FROM {EV} WHERE url IS NOT NULL GROUP BY 1)", f"list(DISTINCT url) AS urls FROM (SELECT story_id, url FROM {EV} UNION ALL {_LINKED}) WHERE url IS NOT NULL GROUP BY 1)")


def f16(s, d):
    c, e, v, _ = _all(s, d)
    facts = p_ops.story_claims(c, e, v)
    rows = derived.table(s, d, "posts").join(facts, "story_id")
    anchors = F.transform(F.filter("claims", lambda q: F.array_contains("allowed_claim_ids", q["claim_id"])), lambda q: q["anchor"])
    count = F.length("post") + F.when(C("story_id") % 9 == 0, 1).otherwise(0)
    errors = p_ops.simple_errors(C("post"), count, C("claim_ids"), C("draft_claim_ids"), C("allowed_claim_ids"), text.distinctive(C("seed_title"), C("seed_summary")), anchors, 60)
    return rows.select("story_id", F.array_join(errors, ",").alias("errors"))


_F16 = _errors(["EMPTY_TEXT", "COUNT", "UNAPPROVED_CLAIM", "DRAFT_UNAPPROVED", "LOST_SUBJECT", "LOST_ATTRIBUTION", "TOO_LONG"], 60) if (_RULES := _RULES | {"COUNT": "story_id % 9 = 0"}) else ""
_F16 = _F16.replace("'COUNT'", "'COUNT_MISMATCH'")


def f18(s, d):
    c, _, _, _ = _all(s, d)
    return c.join(derived.table(s, d, "posts").select("story_id", "post"), "story_id").select("story_id", "claim_id", p_ops.attribution_survives(C("post"), C("attribution")).alias("survives"))


def f19(s, d):
    done = f15(s, d).select("story_id", F.split("errors", ",").alias("errors"))
    return done.select("story_id", p_ops.retry_target(C("errors"), C("story_id") % 4, C("story_id") % 2).alias("target"))


_WRITER = "|".join(p_ops.WRITER_ERRORS)


def a22(s, d):
    c, e, v, _ = _all(s, d)
    rows = derived.table(s, d, "posts").join(p_ops.story_claims(c, e, v), "story_id")
    own = F.filter("claims", lambda q: F.array_contains("draft_claim_ids", q["claim_id"]))
    return rows.select("story_id", F.array_join(p_ops.post_claim_ids(C("post"), own, F.coalesce("urls", F.array().cast("array<string>"))), ",").alias("claim_ids"))


def k08(s, d):
    b = read(s, d, "benchmark").select("item_id", F.transform(text.sentences(C("text")), text.claim_tokens).alias("t")).select("item_id", F.posexplode("t").alias("i", "t"))
    pairs = b.alias("a").join(b.alias("b"), (C("a.item_id") == C("b.item_id")) & (C("a.i") < C("b.i")))
    return pairs.filter(text.repetitive(C("a.t"), C("b.t"))).select(C("a.item_id").alias("item_id"), C("a.i").alias("first"), C("b.i").alias("second"))


# -- claims


def r06(s, d):
    return c_ops.strongest_claim(*_all(s, d)).select("story_id", "claim_id", "quality", "sources", "certainty", "specificity")


def r07(s, d):
    editorial = derived.table(s, d, "posts").select("story_id", "allowed_claim_ids", C("seed_title").alias("central_event"))
    return c_ops.fallback_claim(*_all(s, d), editorial, 38).select("story_id", "claim_id")


def r11(s, d):
    used = derived.table(s, d, "posts").select("story_id", F.explode("allowed_claim_ids").alias("claim_id"))
    return c_ops.best_source(*_all(s, d), used)


_USABLE = "regexp_matches(url, '^https?://[^/?#]+') AND NOT regexp_matches(lower(url), '^https?://(www\\.)?([^/]*\\.)?example\\.[a-z]+(/|$)')"
_RANK = "CASE upper(coalesce(source_type, 'UNKNOWN')) WHEN 'PRIMARY' THEN 4 WHEN 'OFFICIAL' THEN 4 WHEN 'SECONDARY' THEN 3 WHEN 'AGGREGATOR' THEN 1 WHEN 'OPINION' THEN -1 ELSE 0 END"
CITED = f"""v AS (SELECT story_id, claim_id, upper(status) AS status, evidence_ids AS vids FROM {VE} WHERE {OK}),
 x AS (SELECT DISTINCT story_id, claim_id, unnest(CASE WHEN len(vids) > 0 THEN list_intersect(evidence_ids, vids) ELSE evidence_ids END) AS evidence_id FROM {CL} JOIN v USING (story_id, claim_id)),
 a AS (SELECT story_id, source_id, max({_RANK}) AS rank FROM {AS} GROUP BY 1, 2),
 y AS (SELECT x.*, source_id, url, pos, coalesce(rank, 0) AS rank FROM x JOIN {EV} USING (story_id, evidence_id) LEFT JOIN a USING (story_id, source_id) WHERE url IS NOT NULL AND {_USABLE})"""
_WORDS = "len(regexp_extract_all(claim_text, '[A-Za-z0-9_''-]+'))"
RANKED = f"""z AS (SELECT story_id, claim_id, max(rank) AS quality, count(DISTINCT source_id) AS sources FROM y GROUP BY 1, 2),
 q AS (SELECT c.*, quality, sources, (trim(uncertainty) = '')::INT AS certainty, least({_WORDS}, 100) AS specificity, (v.status = 'SUPPORTED')::INT AS whole FROM {{claims}} c JOIN z USING (story_id, claim_id) JOIN v USING (story_id, claim_id) WHERE NOT (is_forecast OR is_allegation OR is_opinion)),
 o AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY quality DESC, sources DESC, certainty DESC, specificity DESC, whole DESC, claim_id) AS n FROM q)"""


def j03(s, d):
    c, e, _, _ = _all(s, d)
    asked = read(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(C("o_orderkey").alias("story_id"))
    return c_ops.evidence_of(c, e, asked).select("story_id", "evidence_id")


def j15(s, d):
    c, e, _, _ = _all(s, d)
    p = derived.table(s, d, "posts")
    return c_ops.traced(c, e, p.select("story_id", F.explode("allowed_claim_ids").alias("claim_id")), p.select("story_id", F.explode("claim_ids").alias("claim_id")))


def j17(s, d):
    c, e, v, _ = _all(s, d)
    return c_ops.supported_domains(c, e, v).select("story_id", F.array_join("domains", ",").alias("domains"))


def j18(s, d):
    c, e, _, _ = _all(s, d)
    stored = c.filter("story_id % 3 <> 0").select((C("story_id") % 50).alias("run_id"), F.concat_ws("-", "story_id", "claim_id").alias("claim_id"), F.sha2(F.concat_ws("-", "story_id", "claim_id"), 256).alias("stored_id"))
    found = c.select((C("story_id") % 50).alias("run_id"), F.concat_ws("-", "story_id", "claim_id").alias("claim_id"), F.explode("evidence_ids").alias("evidence_id"))
    return c_ops.remapped(found, stored).select("claim_id", "evidence_id")


def a17(s, d):
    return c_ops.claim_sets(derived.table(s, d, "verifications")).select("story_id", F.array_join("supported", ",").alias("supported"), F.array_join("unsupported", ",").alias("unsupported"))


def a21(s, d):
    c, _, v, _ = _all(s, d)
    return c_ops.all_supported(c, v.filter("story_id % 4 <> 0 or claim_id <> 'c1'"))


def p05(s, d):
    m = c_ops.support_measures(*_all(s, d), F.to_timestamp(F.lit("2002-01-01")))
    return m.select("story_id", "claim_id", F.round("strength", 6).alias("strength"), "agreement", "contradiction", "diversity", "recency_days")


def p03(s, d):
    c, _, _, _ = _all(s, d)
    claims = c.select(F.concat_ws("-", F.lit("x"), "claim_text").alias("claim_id"), C("claim_text").alias("claim")).distinct()
    asked = derived.table(s, d, "posts").select(C("story_id").alias("sentence_id"), C("post").alias("sentence"))
    return similar.coverage(asked, claims)


def p03_gate(s, d):
    """Sentences of all documents against the benchmark's texts as claims."""
    claims = read(s, d, "benchmark").select(C("item_id").alias("claim_id"), C("text").alias("claim"))
    parts = read(s, d, "documents").select("doc_id", F.posexplode(text.plain_sentences(C("text"))).alias("pos", "sentence"))
    return similar.gate(parts.select(F.concat_ws("-", "doc_id", "pos").alias("sentence_id"), "sentence"), claims)


_DISTINCT = "(SELECT DISTINCT claim_text FROM {})"


def _expected(s, d):
    a = derived.table(s, d, "assessments")
    return a.select("story_id", "source_id", F.concat(F.lit("https://x.org/"), "source_id").alias("source_url"), F.concat(F.lit("Name "), "source_id").alias("source_name"), F.coalesce(F.upper("source_type"), F.lit("UNKNOWN")).alias("source_type"), F.lit(None).cast("string").alias("authority"), F.when(C("story_id") % 2 == 0, "P").alias("publisher_name"))


def f23(s, d):
    e = _expected(s, d)
    got = e.filter("story_id % 11 <> 0 or source_id <> 's3'").select("story_id", "source_id", "source_url", F.when(C("story_id") % 7 == 0, "Other").otherwise(C("source_name")).alias("source_name"), F.when((C("story_id") % 5 == 0) & (C("source_type") == "UNKNOWN"), "PRIMARY").otherwise(C("source_type")).alias("source_type"), F.lit("").alias("authority"), F.when(C("story_id") % 3 == 0, "INDEPENDENT").otherwise("unknown ").alias("independence"))
    return c_ops.consistent_assessments(e, got)


_F23 = f"""SELECT story_id, (NOT bool_or(story_id % 11 = 0 AND source_id = 's3')) AND bool_and(coalesce(story_id % 7 <> 0 AND NOT (story_id % 5 = 0 AND kind = 'UNKNOWN' AND story_id % 2 = 1), true)) AND (count(*) >= 2 OR story_id % 3 <> 0 OR bool_and(story_id % 11 = 0 AND source_id = 's3')) AS consistent
 FROM (SELECT story_id, source_id, coalesce(upper(source_type), 'UNKNOWN') AS kind FROM {AS}) GROUP BY 1"""


def f24(s, d):
    a = derived.table(s, d, "assessments")
    doc = read(s, d, "supplier").filter("s_suppkey < 20 and s_suppkey % 2 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.concat(F.lit("https://d.org/"), "s_suppkey").alias("source_url"), F.when(C("s_suppkey") % 4 == 0, C("s_name")).alias("source_name"), F.when(C("s_suppkey") % 3 == 0, "PRIMARY").alias("source_type"), F.lit(None).cast("string").alias("authority"))
    none = F.lit(None).cast("string")
    got = a.select("story_id", "source_id", none.alias("source_url"), F.lit("Own").alias("source_name"), "source_type", F.lit("high").alias("authority"), none.alias("independence"), F.lit(None).cast("array<string>").alias("conflicts"), F.lit(None).cast("array<string>").alias("uncertainty"))
    return c_ops.repaired_assessments(got, doc).select("story_id", "source_id", "source_url", "source_name", "source_type", "authority", "independence", F.size("conflicts").alias("conflicts"))


def f20(s, d):
    c, e, v, _ = _all(s, d)
    domains = c_ops.supported_domains(c, e, v).withColumnRenamed("domains", "supported_domains")
    whole = c_ops.all_supported(c, v)
    own = e.groupBy("story_id").agg(F.array_sort(F.collect_set(urls.host(C("url")))).alias("domains"), F.count("*").alias("evidence_count"))
    none = F.array().cast("array<string>")
    rows = read(s, d, "orders").select(C("o_orderkey").alias("story_id"), C("o_orderdate").alias("first_seen_at"), F.when(C("o_orderkey") % 6 != 0, C("o_orderkey") % 5 != 0).alias("is_breaking"), F.when(C("o_orderkey") % 4 == 0, " ").otherwise("large").alias("rationale"), F.array(F.when(C("o_orderkey") % 7 == 0, "Weather").otherwise("SCIENCE")).alias("categories"), F.when(C("o_orderkey") % 3 == 0, True).alias("independent_reporting"), F.when(C("o_orderkey") % 8 != 0, False).alias("copying_detected"))
    facts = rows.join(own, "story_id", "left").join(domains, "story_id", "left").join(whole, "story_id", "left")
    facts = facts.withColumns({"domains": F.coalesce("domains", none), "supported_domains": F.coalesce("supported_domains", none), "independent_domains": F.when(C("story_id") % 2 == 0, F.coalesce("domains", none)).otherwise(none), "evidence_count": F.coalesce("evidence_count", F.lit(0))})
    return stories.breaking_failures(facts, F.to_timestamp(F.lit("1998-10-03 02:00:00"))).select("story_id", F.array_join("failed", ",").alias("failed"), "eligible")


_HOSTS = "regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)), '^www\\.', '')"
J17 = f"SELECT story_id, list_sort(list(DISTINCT h)) AS domains FROM (SELECT story_id, {_HOSTS} AS h FROM {EV} JOIN (SELECT DISTINCT story_id, unnest(evidence_ids) AS evidence_id FROM {CL} WHERE (story_id, claim_id) IN (SELECT (story_id, claim_id) FROM {VE} WHERE {OK})) USING (story_id, evidence_id) WHERE url IS NOT NULL) WHERE h <> 'news.google.com' GROUP BY 1"
F20 = f"""WITH k AS ({J17}), w AS (SELECT story_id, bool_and({OK}) AS ok FROM {VE} GROUP BY 1), e AS (SELECT story_id, list(DISTINCT {_HOSTS}) FILTER (url IS NOT NULL) AS own, count(*) AS n FROM {EV} GROUP BY 1),
 f AS (SELECT o_orderkey AS story_id, o_orderdate AS at, coalesce(own, []) AS own, coalesce(domains, []) AS sup, coalesce(n, 0) AS n, coalesce(ok, false) AS ok FROM orders LEFT JOIN e ON e.story_id = o_orderkey LEFT JOIN k ON k.story_id = o_orderkey LEFT JOIN w ON w.story_id = o_orderkey),
 r AS (SELECT story_id, concat_ws(',', CASE WHEN story_id % 6 = 0 OR story_id % 5 = 0 THEN 'not_breaking' END, CASE WHEN story_id % 4 = 0 THEN 'no_rationale' END, CASE WHEN NOT (epoch(TIMESTAMP '1998-10-03 02:00:00') - epoch(at)) / 60 BETWEEN 0 AND 180 THEN 'not_fresh' END, CASE WHEN story_id % 7 = 0 THEN 'category' END, CASE WHEN len(list_distinct(own || sup)) < 2 THEN 'domains' END, CASE WHEN len(list_distinct(CASE WHEN story_id % 2 = 0 THEN own || sup ELSE sup END)) < 2 THEN 'independent_domains' END, CASE WHEN story_id % 3 <> 0 AND len(sup) < 2 THEN 'not_corroborated' END, CASE WHEN story_id % 8 = 0 THEN 'copying' END, CASE WHEN n = 0 THEN 'no_evidence' END, CASE WHEN NOT ok THEN 'unsupported' END) AS failed FROM f)
 SELECT story_id, failed, failed = '' AS eligible FROM r"""


def f22(s, d):
    """A third of the stories has a publication; posts are the conversations' texts and the stories' own."""
    o = read(s, d, "orders").select(C("o_orderkey").alias("id"), F.concat(F.lit("Post "), C("o_orderkey") % 400).alias("content"))
    live = o.filter("id % 3 = 0").select(C("id").alias("story_id"), F.when(C("id") % 2 == 0, "publishing").otherwise("published").alias("status"), F.to_timestamp(F.lit("2024-01-10")).alias("started_at"))
    made = read(s, d, "events").filter("event_id < 800").select(F.concat(F.lit("Post "), F.when(C("event_id") < 400, C("event_id")).otherwise(C("event_id") * 2 % 400)).alias("text"), C("ts").alias("created_at"))
    made = made.withColumn("created_at", F.to_timestamp(F.lit("2024-01-12")))
    return stories.publication_step(live, made, o)


_F22 = "WITH h AS (SELECT CASE WHEN event_id < 400 THEN event_id ELSE event_id * 2 % 400 END AS t, count(*) AS n FROM events WHERE event_id < 800 GROUP BY 1) SELECT o_orderkey AS story_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'PUBLISH' WHEN o_orderkey % 2 = 1 THEN 'DUPLICATE' WHEN n = 1 THEN 'RECOVERED' ELSE 'RECOVERY_REQUIRED' END AS step FROM orders LEFT JOIN h ON t = o_orderkey % 400"


# -- memory


def f22_all(s, d):
    """As f22, over all orders and all events: posts that repeat an order's text once, twice or never."""
    o = read(s, d, "orders").select(C("o_orderkey").alias("id"), F.concat(F.lit("Post "), C("o_orderkey")).alias("content"), "o_orderstatus", "o_orderpriority")
    live = o.filter("o_orderstatus <> 'P'").select(C("id").alias("story_id"), F.when(C("o_orderstatus") == "O", "publishing").otherwise("published").alias("status"), F.to_timestamp(F.lit("2024-01-10")).alias("started_at"))
    made = read(s, d, "events").select(F.concat(F.lit("Post "), F.when(C("event_id") % 2 == 0, C("event_id")).otherwise(F.expr("event_id div 2"))).alias("text"), F.to_timestamp(F.lit("2024-01-12")).alias("created_at"))
    return stories.publication_step(live, made, o.select("id", "content"))


_F22_ALL = "WITH h AS (SELECT CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id // 2 END AS t, count(*) AS n FROM events GROUP BY 1) SELECT o_orderkey AS story_id, CASE o_orderstatus WHEN 'P' THEN 'PUBLISH' WHEN 'O' THEN CASE WHEN n = 1 THEN 'RECOVERED' ELSE 'RECOVERY_REQUIRED' END ELSE 'DUPLICATE' END AS step FROM orders LEFT JOIN h ON t = o_orderkey"


def f24_all(s, d):
    """As f24, with every supplier as a documented source."""
    key = F.concat(F.lit("s"), C("s_suppkey") * 2)
    doc = read(s, d, "supplier").select(key.alias("source_id"), F.concat(F.lit("https://d.org/"), C("s_suppkey") * 2).alias("source_url"), F.when(C("s_suppkey") % 2 == 0, C("s_name")).alias("source_name"), F.when(C("s_suppkey") % 3 == 0, "PRIMARY").alias("source_type"), F.lit(None).cast("string").alias("authority"))
    none = F.lit(None).cast("string")
    got = derived.table(s, d, "assessments").select("story_id", "source_id", none.alias("source_url"), F.lit("Own").alias("source_name"), "source_type", F.lit("high").alias("authority"), none.alias("independence"), F.lit(None).cast("array<string>").alias("conflicts"), F.lit(None).cast("array<string>").alias("uncertainty"))
    return c_ops.repaired_assessments(got, doc).select("story_id", "source_id", "source_url", "source_name", "source_type", "authority", "independence", F.size("conflicts").alias("conflicts"))


def _similar(s, d, only="id % 20 = 0"):
    asked = derived.table(s, d, "wire").filter(only).select("id", "title")
    known = read(s, d, "nation").select(C("n_nationkey").alias("id"), F.element_at(F.array(*[F.lit(t) for t in derived.TITLES]), (C("n_nationkey") % len(derived.TITLES) + 1).cast("int")).alias("title"))
    pairs = similar.similar_titles(asked, known, "id", "id", C("title"), C("title"), 0.10)
    return pairs.join(F.broadcast(known), C("recent_id") == C("id")).select("query_id", "id", "title", "relationship", "score")


def a16_all(s, d):
    return stories.warnings(_similar(s, d, "true")).select("query_id", F.size("warnings").alias("warnings"), "unresolved")


def a16(s, d):
    return stories.warnings(_similar(s, d)).select("query_id", F.size("warnings").alias("warnings"), "unresolved")


def a15(s, d, only="id % 20 = 0"):
    near = _similar(s, d, only)
    pubs = read(s, d, "events").select(C("event_id").alias("id"), C("user_id").alias("story_id"), F.lit("threads").alias("platform"), F.lit("published").alias("status"), C("ts").alias("published_at"))
    recent = read(s, d, "orders").select(C("o_orderkey").alias("id"), F.lit("t").alias("title"), C("o_orderdate").alias("last_seen_at"), C("o_orderdate").alias("first_seen_at"))
    counts = read(s, d, "documents").groupBy(F.upper("lang").alias("category")).agg(F.count("*").alias("n"))
    rows = stories.memory(derived.table(s, d, "wire").filter(only), near, stories.recent_publications(pubs, "threads", 10), stories.recent_stories(recent, as_of(), 48, 15), counts)
    return rows.select("id", F.coalesce(F.size("similar_stories"), F.lit(0)).alias("similar"), "unresolved", F.size("recent_publications").alias("publications"), F.size("recent_stories").alias("stories"), F.size("category_distribution").alias("categories"))


_TW = "list_distinct(list_transform(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: length(w) > 2), lambda w: trim(lower(w), '.,;:!?\"''()[]{}—–-')))"
_T = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in derived.TITLES) + "]"
SIM = f"""q AS (SELECT id AS query_id, {_TW} AS w FROM {derived.sql('wire')} WHERE id % 20 = 0), k AS (SELECT id, {_TW} AS w FROM (SELECT n_nationkey AS id, {_T}[(n_nationkey % {len(derived.TITLES)} + 1)::INT] AS title FROM nation)),
 x AS (SELECT query_id, id, len(list_intersect(q.w, k.w)) / len(list_distinct(q.w || k.w)) AS score FROM q, k)"""

_SIM_ALL = SIM.replace(" WHERE id % 20 = 0", "")
_A15 = "SELECT query_id AS id, count(*) FILTER (score >= 0.1)::INT AS similar, coalesce(bool_or(score >= 0.35), false) AS unresolved, 10 AS publications, (SELECT least(15, count(*))::INT FROM orders WHERE o_orderdate >= TIMESTAMP '2024-01-18') AS stories, (SELECT count(DISTINCT upper(lang))::INT FROM documents) AS categories FROM x GROUP BY 1"

QUERIES = {
    "f15_linked_sources": (f15_linked, f"{_DOC_LINKED} SELECT story_id, {_F15} AS errors, CASE WHEN {_F15} = '' THEN 'PASS' ELSE 'BLOCK' END AS state FROM f"),
    "f15_full_validation": (f15, f"{_DOC} SELECT story_id, {_F15} AS errors, array_to_string(mapped, ',') AS mapped, CASE WHEN {_F15} = '' THEN 'PASS' ELSE 'BLOCK' END AS state FROM f"),
    "f16_simple_validation": (f16, f"{_DOC} SELECT story_id, {_F16} AS errors FROM f"),
    "f18_attribution_survival": (f18, f"SELECT c.story_id, claim_id, CASE attribution WHEN 'the Finance Ministry' THEN contains(lower(post), 'ministry') WHEN 'aides' THEN contains(lower(post), 'aides') ELSE true END AS survives FROM {CL} c JOIN {PO} USING (story_id)"),
    "f19_retry_target": (f19, f"{_DOC} SELECT story_id, CASE WHEN regexp_matches(e, 'UNAPPROVED_CLAIM|DRAFT_UNAPPROVED') AND story_id % 2 < 1 THEN 'editorial' WHEN regexp_matches(e, '{_WRITER}') AND story_id % 4 < 2 THEN 'writer' END AS target FROM (SELECT story_id, {_F15} AS e FROM f)"),
    "f20_breaking_gate": (f20, F20.replace(" AS at,", " AS seen,").replace("epoch(at)", "epoch(seen)")),
    "f22_publication_step": (f22, _F22),
    "f23_assessment_check": (f23, None),
    "f24_assessment_repair": (f24, f"SELECT story_id, source_id, CASE WHEN k THEN 'https://d.org/' || n ELSE '' END AS source_url, CASE WHEN k THEN CASE WHEN n % 4 = 0 THEN s_name ELSE '' END ELSE 'Own' END AS source_name, CASE WHEN k AND n % 3 = 0 THEN 'PRIMARY' ELSE coalesce(source_type, 'UNKNOWN') END AS source_type, CASE WHEN k THEN '' ELSE 'high' END AS authority, 'UNKNOWN' AS independence, 0 AS conflicts FROM (SELECT a.*, substr(source_id, 2)::INT AS n, s_suppkey IS NOT NULL AS k, s_name FROM {AS} a LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey < 20 AND s_suppkey % 2 = 0) ON 's' || s_suppkey = source_id)"),
    "k08_repetitive_sentences": (k08, None),
    "r06_strongest_verified": (r06, f"WITH {CITED}, {RANKED.format(claims=CL)} SELECT story_id, claim_id, quality::INT AS quality, sources, certainty, specificity::INT AS specificity FROM o WHERE n = 1"),
    "r07_fallback_claim": (r07, f"WITH {CITED}, b AS (SELECT *, len(list_intersect(ct, et)) AS near FROM (SELECT c.*, {claim_tokens_sql('claim_text')} AS ct, {claim_tokens_sql('seed_title')} AS et FROM {CL} c JOIN {PO} p ON p.story_id = c.story_id AND list_contains(allowed_claim_ids, claim_id)) WHERE NOT (is_forecast OR is_allegation OR is_opinion) AND length(trim(claim_text)) BETWEEN 1 AND 38 AND regexp_matches(claim_text, '[.!?]$') AND NOT regexp_matches(claim_text, '[.!?]\\s')), t AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY story_id ORDER BY near DESC) AS central FROM b) WHERE central = 1), {RANKED.format(claims='t')} SELECT story_id, claim_id FROM o WHERE n = 1"),
    "r11_best_verified_source": (r11, f"WITH {CITED} SELECT story_id, url FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY rank DESC, pos, url DESC) AS n FROM y WHERE (story_id, claim_id) IN (SELECT (story_id, unnest(allowed_claim_ids)) FROM {PO})) WHERE n = 1"),
    "j03_story_evidence": (j03, f"SELECT DISTINCT story_id, evidence_id FROM (SELECT story_id, unnest(evidence_ids) AS evidence_id FROM {CL}) JOIN {EV} USING (story_id, evidence_id) JOIN orders ON o_orderkey = story_id WHERE o_orderpriority = '1-URGENT'"),
    "j15_traceability": (j15, f"SELECT c.story_id, c.claim_id, l.evidence_id, source_id, list_contains(allowed_claim_ids, c.claim_id) AS allowed, list_contains(claim_ids, c.claim_id) AS in_post FROM {CL} c JOIN {PO} p USING (story_id) LEFT JOIN (SELECT story_id, claim_id, unnest(evidence_ids) AS evidence_id FROM {CL}) l ON l.story_id = c.story_id AND l.claim_id = c.claim_id LEFT JOIN {EV} e ON e.story_id = c.story_id AND e.evidence_id = l.evidence_id"),
    "j17_supported_domains": (j17, f"SELECT story_id, array_to_string(domains, ',') AS domains FROM ({J17})"),
    "j18_claim_remap": (j18, f"SELECT sha256(story_id || '-' || claim_id) AS claim_id, unnest(evidence_ids) AS evidence_id FROM {CL} WHERE story_id % 3 <> 0"),
    "a15_editorial_memory": (a15, f"WITH {SIM} {_A15}"),
    "a15_memory_of_all": (lambda s, d: a15(s, d, "true"), f"WITH {_SIM_ALL} {_A15}"),
    "a16_warnings_of_all": (a16_all, f"WITH {_SIM_ALL} SELECT query_id, count(*) FILTER (score >= 0.35)::INT AS warnings, bool_or(score >= 0.35) AS unresolved FROM x WHERE score >= 0.1 GROUP BY 1"),
    "f22_step_of_all": (f22_all, _F22_ALL),
    "f24_repaired_by_all": (f24_all, f"SELECT story_id, source_id, CASE WHEN k THEN 'https://d.org/' || n ELSE '' END AS source_url, CASE WHEN k THEN CASE WHEN n % 4 = 0 THEN s_name ELSE '' END ELSE 'Own' END AS source_name, CASE WHEN k AND n // 2 % 3 = 0 THEN 'PRIMARY' ELSE coalesce(source_type, 'UNKNOWN') END AS source_type, CASE WHEN k THEN '' ELSE 'high' END AS authority, 'UNKNOWN' AS independence, 0 AS conflicts FROM (SELECT a.*, substr(source_id, 2)::INT AS n, s_suppkey IS NOT NULL AS k, s_name FROM {AS} a LEFT JOIN supplier ON 's' || (s_suppkey * 2) = source_id)"),
    "a16_repetition_warnings": (a16, f"WITH {SIM} SELECT query_id, count(*) FILTER (score >= 0.35)::INT AS warnings, bool_or(score >= 0.35) AS unresolved FROM x WHERE score >= 0.1 GROUP BY 1"),
    "a17_claim_sets": (a17, f"SELECT story_id, coalesce(string_agg(claim_id, ',' ORDER BY claim_id) FILTER ({OK}), '') AS supported, coalesce(string_agg(claim_id, ',' ORDER BY claim_id) FILTER (NOT {OK}), '') AS unsupported FROM {VE} GROUP BY 1"),
    "a21_all_claims_supported": (a21, f"SELECT story_id, coalesce(bool_and({OK}), false) AND NOT bool_or(story_id % 4 = 0 AND claim_id = 'c1') AS all_supported FROM {VE} GROUP BY 1"),
    "a22_post_claim_ids": (a22, f"{_DOC}, h AS (SELECT a.story_id, list_transform(list_filter(claims, lambda q: len(t) > 0 AND list_contains(draft_claim_ids, q.id) AND len(list_filter(t, lambda w: NOT list_contains(q.t, w))) = 0), lambda q: q.id) AS ids FROM a JOIN p USING (story_id)) SELECT p.story_id, coalesce(array_to_string(list_sort(list_distinct(flatten(x))), ','), '') AS claim_ids FROM p LEFT JOIN (SELECT story_id, list(ids) AS x FROM h GROUP BY 1) USING (story_id)"),
    "p03_gate": (p03_gate, None),
    "p03_similarity_gate": (p03, f"WITH c AS (SELECT {claim_tokens_sql('claim_text')} AS ct FROM {_DISTINCT.format(CL)}), s AS (SELECT story_id, {claim_tokens_sql('post')} AS t FROM {PO}) SELECT story_id AS sentence_id, round(max(len(list_intersect(t, ct)) / len(t)), 6) AS coverage, max(len(list_intersect(t, ct)) / len(t)) >= 0.85 AS passes FROM s, c WHERE len(t) > 0 GROUP BY 1"),
    "p05_claim_support": (p05, f"WITH a AS (SELECT story_id, source_id, max({_RANK}) AS rank FROM {AS} GROUP BY 1, 2), l AS (SELECT story_id, claim_id, unnest(evidence_ids) AS evidence_id FROM {CL}), m AS (SELECT c.story_id, c.claim_id, avg(coalesce(rank, 0) / 4) AS strength, count(DISTINCT e.source_id) AS diversity, date_diff('day', max(published_at)::DATE, DATE '2002-01-01') AS recency_days FROM {CL} c LEFT JOIN l ON l.story_id = c.story_id AND l.claim_id = c.claim_id LEFT JOIN {EV} e ON e.story_id = c.story_id AND e.evidence_id = l.evidence_id LEFT JOIN a ON a.story_id = e.story_id AND a.source_id = e.source_id GROUP BY 1, 2), v AS (SELECT story_id, claim_id, avg(({OK})::INT) AS agreement, avg((upper(status) = 'CONTRADICTED')::INT) AS contradiction FROM {VE} GROUP BY 1, 2) SELECT story_id, claim_id, round(strength, 6) AS strength, agreement, contradiction, diversity, recency_days::INT AS recency_days FROM m JOIN v USING (story_id, claim_id)"),
}
