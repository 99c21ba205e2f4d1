"""Text normalization, tokens and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no story.
TITLE_STOPWORDS = ["the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "by", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "it", "its", "as", "from", "will", "has", "have", "had", "not", "no", "breaking", "live", "updates", "just", "news", "today", "latest", "new", "says", "said", "update", "watch", "video", "photos", "photo"]
NO_ENTITY_WORDS = ["a", "an", "the", "after", "amid", "breaking", "major", "new", "official", "report", "reports", "says", "update", "what"]
CLAIM_STOPWORDS = ["a", "an", "the", "of", "to", "in", "on", "at", "for", "with", "by", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "that", "this", "these", "those", "it", "its"]
# Cues of attribution, words that name nobody, words on which no sentence ends, sensitive words, styles.
ATTRIBUTION_CUES = ["said", "says", "reported", "according", "announced", "expects", "forecast", "forecasted", "projects", "estimates", "confirmed", "revealed", "stated", "noted", "cited"]
PRONOUNS = ["the", "a", "an", "this", "that", "these", "those", "it", "he", "she", "they", "we", "you", "i", "his", "her", "their", "our", "your"]
DANGLING = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "that", "the", "to", "with"]
POST_STOPWORDS = ["the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "by", "is", "are", "was", "were", "be", "been", "being", "that", "this", "these", "those", "it", "its", "as", "from", "will", "has", "have", "had", "not", "no", "than", "then", "so", "such"]
SENSITIVE = ["died", "death", "war", "disaster", "killed", "shooting", "attack", "victim", "election", "referendum"]
SERIOUS_STYLES = ["ANALYTICAL", "INFORMATIVE", "SERIOUS"]
OTHER_STYLES = ["ANALYTICAL", "CONVERSATIONAL", "ENTHUSIASTIC", "HUMOROUS", "INFORMATIVE", "SARCASTIC"]
EDGE_PUNCTUATION = ".,;:!?\"'()[]{}—–-"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, use) -> Column:
    """``use(value)`` with value computed once: inside a lambda a plain expression is computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_text(text: Column) -> Column:
    """One blank for runs of blanks, lines trimmed, at most one empty line between lines."""
    lines = F.split(F.regexp_replace(text, "[ \\t\u00a0]+", " "), "\n")
    joined = F.array_join(F.transform(lines, lambda l: F.regexp_replace(l, r"^\s+|\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(joined, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    cleaned = clean_text(text)
    return F.when(cleaned != "", F.sha2(cleaned, 256))


def normalize_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9 ]+", " "), " +", " "))


def title_signature(title: Column) -> Column:
    """The first eight sorted telling words; without any, the first four words."""
    words = F.filter(F.split(normalize_title(title), " "), lambda w: w != "")
    telling = F.slice(F.array_sort(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(TITLE_STOPWORDS))), 1, 8)
    return F.array_join(F.when(F.size(telling) > 0, telling).otherwise(F.slice(words, 1, 4)), " ")


def entities(title: Column) -> Column:
    found = F.transform(F.regexp_extract_all(title, F.lit(r"\b([A-Z][A-Za-z0-9&'-]{2,})\b"), F.lit(1)), F.lower)
    return F.array_sort(F.array_except(found, _words(sorted({*TITLE_STOPWORDS, *NO_ENTITY_WORDS}))))


def claim_tokens(text: Column) -> Column:
    """Distinct lightly stemmed words without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(words, lambda w: ~w.isin(CLAIM_STOPWORDS))

    def stem(w: Column) -> Column:
        n = F.length(w)
        return (
            F.when(w == "fell", "fall")
            .when(w.endswith("ies") & (n > 4), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
            .when(w.endswith("ed") & (n > 4), F.substring(w, F.lit(1), n - 2))
            .when(w.endswith("s") & (n > 3), F.substring(w, F.lit(1), n - 1))
            .otherwise(w)
        )

    return F.array_distinct(F.transform(kept, stem))


def similarity_words(text: Column) -> Column:
    """Words longer than two characters as written, in lower case without edge punctuation, distinct."""
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(words, lambda w: F.trim(F.lower(w), F.lit(EDGE_PUNCTUATION))))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def word_ngrams(text: Column, n: int = 3) -> Column:
    words = F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.trim(w, F.lit(EDGE_PUNCTUATION))), lambda w: (w != "") & ~w.isin(CLAIM_STOPWORDS))
    def grams(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))

    return let(words, lambda ws: F.when(F.size(ws) >= n, F.array_distinct(grams(ws))).otherwise(F.array().cast("array<string>")))


def sentences(text: Column) -> Column:
    """Sentences; dots of common abbreviations do not end one."""
    guarded = F.regexp_replace(text, r"(?i)\b(U\.S|U\.K|Mr|Mrs|Ms|Dr|Prof|e\.g|i\.e)\.", "$1\u0001")
    parts = F.split(F.trim(guarded), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def truncate_words(text: Column, limit: int) -> Column:
    """Whole words up to a limit, then an ellipsis."""
    cut = F.regexp_replace(F.left(text, F.lit(limit - 1)), " [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def ensure_ending(text: Column) -> Column:
    bare = F.regexp_replace(F.trim(text), r"(?:\.\.\.|…)+$", "")
    return F.when(bare.rlike(r"[.!?]$") | (bare == ""), bare).otherwise(F.concat(bare, F.lit(".")))


def summary(description: Column, snippet: Column, limit: int = 280) -> Column:
    return F.left(F.coalesce(F.nullif(description, F.lit("")), snippet), F.lit(limit))


def quote_line(title: Column, description: Column) -> Column:
    return F.concat_ws(" — ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(description), F.lit("")))


def importance(sentence: Column, cues: list[str], position: Column) -> Column:
    """Numbers and attribution weigh 3, proper nouns 2, length over 200 costs 1, the lead gets 100."""
    return (
        F.when(sentence.rlike(r"[0-9]"), 3).otherwise(0)
        + F.when(F.lower(sentence).rlike(rf"\b(?:{'|'.join(cues)})\b"), 3).otherwise(0)
        + F.when(sentence.rlike(r" [A-Z][a-z]+"), 2).otherwise(0)
        - F.when(F.length(sentence) > 200, 1).otherwise(0)
        + F.when(position == 0, 100).otherwise(0)
    )


def compress(text: Column, limit: int, cues: list[str]) -> Column:
    """The most important whole sentences that fit the limit, in their order."""
    return let(sentences(text), lambda parts: _compressed(parts, limit, cues))


def _compressed(parts: Column, limit: int, cues: list[str]) -> Column:
    scored = F.transform(parts, lambda s, i: F.struct((-importance(s, cues, i)).alias("cost"), i.alias("i"), s.alias("s")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    chosen = F.aggregate(
        F.array_sort(scored),
        start,
        lambda acc, x: F.when(acc["used"] + F.length(x["s"]) + F.when(acc["used"] > 0, 1).otherwise(0) <= limit, F.struct((acc["used"] + F.length(x["s"]) + F.when(acc["used"] > 0, 1).otherwise(0)).alias("used"), F.array_append(acc["kept"], x["i"]).alias("kept"))).otherwise(acc),
    )
    return F.array_join(F.transform(F.array_sort(chosen["kept"]), lambda i: F.get(parts, i)), " ")


def plain_sentences(text: Column) -> Column:
    """Sentences by their end marks alone."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def sentence_score(sentence: Column, position: Column) -> Column:
    """Numbers and attribution weigh 3, proper nouns after the first word 2, claim marks 1; over 200 characters cost 1, the lead gets 100."""
    later = F.slice(F.split(F.trim(sentence), r"\s+"), 2, 1_000_000)
    cores = F.transform(later, lambda w: F.trim(w, F.lit(".,;:!?\"'()[]{}")))
    named = F.exists(cores, lambda w: w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(PRONOUNS))
    return (
        F.when(sentence.rlike(r"\b\d[\d,.]*\b|\bpercent\b"), 3).otherwise(0)
        + let(F.lower(sentence), lambda low: F.when(F.exists(_words(ATTRIBUTION_CUES), lambda c: low.contains(c)), 3).otherwise(0))
        + F.when(named, 2).otherwise(0)
        + F.when(sentence.rlike(r"\bclaim_\d+\b"), 1).otherwise(0)
        - F.when(F.length(sentence) > 200, 1).otherwise(0)
        + F.when(position == 0, 100).otherwise(0)
    )


_TRAILING = r"[ \t\r\n,;:\-…]+$"


def ended(text: Column) -> Column:
    """Trailing separators and ellipsis off, an end mark on; blank stays blank."""

    def without_dots(bare: Column) -> Column:
        return F.when(bare.endswith("..."), F.trim(F.regexp_replace(bare, r"[.…]+$", ""))).otherwise(bare)

    def marked(bare: Column) -> Column:
        return F.when((bare == "") | bare.rlike(r"[.!?]$"), bare).otherwise(F.concat(bare, F.lit(".")))

    return let(let(F.regexp_replace(F.trim(text), _TRAILING, ""), without_dots), marked)


def finished(text: Column, limit: int) -> Column:
    """One sentence cut to a limit: at its last end mark, else after a whole word on which a sentence can end."""
    if limit <= 0:
        return F.lit("")
    mark = r"[\"'()\[\]{}]*"

    def whole_words(bare: Column, fragment: Column) -> Column:
        cut = (F.length(bare) > F.length(fragment)) & ~F.substring(bare, F.length(fragment) + 1, F.lit(1)).rlike(r"\s")
        return F.when(~cut, fragment).when(fragment.contains(" "), F.regexp_replace(fragment, r" [^ ]*$", "")).otherwise("")

    def closed(kept: Column) -> Column:
        words = F.array_join(F.filter(F.split(kept, r"\s+"), lambda w: w != ""), " ")
        words = F.regexp_replace(words, rf"(?i)(?:(?:^| +){mark}(?:{'|'.join(DANGLING)}){mark})+$", "")
        out = let(words, lambda w: F.when(w.rlike(r"[.!?]$"), w).otherwise(F.concat(w, F.lit("."))))
        return let(out, lambda o: F.when((kept != "") & (F.length(o) <= limit), o).otherwise("."))

    def cut_at(bare: Column, fragment: Column) -> Column:
        last = let(F.regexp_replace(whole_words(bare, fragment), _TRAILING, ""), closed)
        return let(F.regexp_extract(fragment, r"(?s)^(.*[.!?])", 1), lambda complete: F.when(complete != "", complete).otherwise(last))

    def short(bare: Column) -> Column:
        return F.when(bare == "", ".").otherwise(let(F.rtrim(F.left(bare, F.lit(limit))), lambda fragment: cut_at(bare, fragment)))

    return let(F.regexp_replace(F.trim(text), _TRAILING, ""), short)


def compress_to_limit(text: Column, limit: int = 500) -> Column:
    """Whole sentences within a limit: the lead first, then by score while their own lengths fit, in their order, with an end mark.

    Lengths are summed without the blanks between sentences; where the result
    is too long for that, or has no end mark left, it is finished as one.
    """

    def over(whole: Column) -> Column:
        return let(plain_sentences(whole), lambda parts: _chosen(whole, parts, limit))

    def short(bare: Column) -> Column:
        return let(ended(bare), lambda done: F.when(F.length(done) <= limit, done).otherwise(finished(bare, limit)))

    return let(F.trim(text), lambda bare: F.when(F.length(bare) <= limit, short(bare)).otherwise(over(bare)))


def _chosen(whole: Column, parts: Column, limit: int) -> Column:
    scored = F.array_sort(F.transform(parts, lambda s, i: F.struct((-sentence_score(s, i)).alias("cost"), i.alias("i"), F.length(s).alias("n"))))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("count"), F.lit(False).alias("full"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = ~acc["full"] & (acc["used"] + x["n"] + F.when(acc["count"] > 0, 1).otherwise(0) <= limit)
        used, count = acc["used"] + x["n"], acc["count"] + 1
        return F.when(fits, F.struct(used.alias("used"), count.alias("count"), (used + count - 1 >= limit).alias("full"), F.array_append(acc["kept"], x["i"]).alias("kept"))).otherwise(acc)

    kept = F.aggregate(scored, start, step, lambda acc: F.array_sort(acc["kept"]))
    # Named once each: the tests and the cuts would each choose the sentences again.
    rebuilt = let(ended(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), " ")), lambda r: F.when(F.length(r) <= limit, r).otherwise(finished(r, limit)))
    lead = F.get(parts, F.lit(0))
    return F.when(F.size(parts) == 0, finished(whole, limit)).when(F.length(lead) > limit, finished(lead, limit)).otherwise(rebuilt)


def derived_headline(headline: Column, body: Column, limit: int = 120) -> Column:
    """The given headline, else the first sentence of the body, compressed if it is long."""
    first = F.get(plain_sentences(body), F.lit(0))
    made = F.when(F.length(first) > limit, compress_to_limit(first, limit)).otherwise(first)
    return F.coalesce(F.nullif(F.trim(headline), F.lit("")), made)


def with_source(text: Column, url: Column, limit: int) -> Column:
    """The text with a source address on its last line, if there is none yet and it fits."""
    usable = url.rlike(r"^https?://[^/?#\s]+") & ~F.regexp_extract(url, r"^https?://(?:www\.)?([^/?#:]*)", 1).rlike(r"(^|\.)example\.[a-z]+$|^localhost$|\.invalid$|\.test$")
    fits = F.length(F.trim(text)) + 1 + F.length(url) <= limit
    return F.when(F.coalesce(usable & fits & ~text.rlike(r"https?://\S+"), F.lit(False)), F.concat_ws("\n", F.trim(text), url)).otherwise(text)


def bare_url(sentence: Column) -> Column:
    """The address that a sentence is nothing but, without trailing marks; null for any other sentence."""
    return F.when(sentence.rlike(r"^https?://\S+$"), F.regexp_replace(sentence, r"[.,;:!?)\]}]+$", ""))


def is_source_reference(sentence: Column, allowed: Column) -> Column:
    return F.coalesce(F.array_contains(allowed, bare_url(sentence)), F.lit(False))


def bare_source_line(text: Column, url: Column) -> Column:
    """A line "Source: <url>" of the verified address becomes the address alone."""
    line = F.regexp_extract(text, r"(?im)^Source:\s*(https?://\S+)\s*$", 1)
    trimmed = r"[.,;:!?)\]}]+$"
    same = (line != "") & (F.regexp_replace(line, trimmed, "") == F.regexp_replace(url, trimmed, ""))
    return F.when(F.coalesce(same, F.lit(False)), F.regexp_replace(text, F.lit(r"(?im)^Source:\s*(https?://\S+)[^\S\n]*$"), F.lit("$1"))).otherwise(text)


def topic_label(topic: Column, title: Column) -> Column:
    """The topic unless it is a mere "news" or "general", else the first two words of the title."""
    named = F.when(~F.lower(F.trim(topic)).isin("", "news", "general"), F.trim(topic))
    return F.coalesce(named, F.array_join(F.slice(F.filter(F.split(F.trim(title), r"\s+"), lambda w: w != ""), 1, 2), " "))


def is_sensitive(subject: Column) -> Column:
    return F.exists(_words(SENSITIVE), lambda w: F.lower(F.coalesce(subject, F.lit(""))).contains(w))


def allowed_styles(subject: Column) -> Column:
    return F.when(is_sensitive(subject), _words(SERIOUS_STYLES)).otherwise(_words(OTHER_STYLES))


def without_wrapping(text: Column) -> Column:
    """Model output without thinking blocks and code fences."""
    bare = F.trim(F.regexp_replace(text, r"(?is)<thought>.*?</thought>", ""))
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(bare.rlike(r"(?s)```(?:json)?\s*.*?\s*```"), F.trim(fenced)).otherwise(bare)


def first_json(text: Column) -> Column:
    """The JSON value that a text is, else the one between its first and last brace, as a variant; null if there is none."""
    bare = without_wrapping(text)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))))


def distinctive(title: Column, summary: Column) -> Column:
    """Words of the subject that a post may be recognised by."""
    words = F.filter(F.split(F.concat_ws(" ", title, summary), r"\s+"), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(POST_STOPWORDS))
    return F.transform(words, lambda w: F.trim(F.lower(w), F.lit(EDGE_PUNCTUATION)))


def attribution_anchor(attribution: Column) -> Column:
    """The longest word of an attribution (the first of equals), in lower case; null without one."""
    words = F.filter(F.split(F.trim(attribution), r"\s+"), lambda w: w != "")
    longest = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
    return F.nullif(F.trim(F.lower(longest), F.lit(".,;:")), F.lit(""))


def repetitive(a: Column, b: Column) -> Column:
    """Whether two token lists say the same: 70 % of the smaller and 40 % of both are shared."""
    shared, low, both = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)), F.size(F.array_union(a, b))
    return (low > 0) & (shared >= 0.7 * low) & (shared >= 0.4 * both)
