"""Article extraction by scored containers, in a cascade, and its merge into landed items.

Pages become trees (``pagetree``), and every choice is one between nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import publishers, text, urls
from .pagetree import Node, measures, parsed

# Hints that a container holds the article, and how much text counts as enough.
HINTS = ["article", "main", "content", "post", "story", "entry", "body"]
SEMANTIC_LEAST, ENOUGH, THIN = 400, 200, 500
#: Pages whose trees and texts are held at a time.
SLICE = 64


def node_score(length: Column, paragraphs: Column, linked: Column) -> Column:
    """Length, a tenth more for each paragraph, less the share of linked text (0.9 at most)."""
    return length * (1 + 0.1 * paragraphs) * (1 - F.least(linked / F.greatest(length, F.lit(1)), F.lit(0.9)))


def _hinted(node: Node) -> bool:
    named = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
    return node.tag in ("article", "section", "div") and any(h in named for h in HINTS)


def _containers(root: Node) -> list[dict]:
    """Every container in the order of the page; ``leads``: the first article, main element or main role, which alone may stand for its kind."""
    out, seen, of = [], set(), measures(root)
    for node in root.walk():
        if isinstance(node, str) or not (node.tag in ("article", "main", "section", "div", "body") or node.attrs.get("role") == "main"):
            continue
        kinds = {node.tag} & {"article", "main"} | ({"role"} if node.attrs.get("role") == "main" else set())
        letters, pieces, paragraphs, linked = of[node]
        length = letters + max(0, pieces - 1)
        out.append({"node": node, "tag": node.tag, "hinted": _hinted(node), "length": length, "paragraphs": paragraphs, "linked": linked, "leads": next((k for k in ("article", "main", "role") if k in kinds - seen and letters > SEMANTIC_LEAST), None)})
        seen |= kinds
    return out


def containers(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, tag, hinted, leads, length, paragraphs, linked, score) of every container of every page."""
    kind = dict(pages.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names = ["tag", "hinted", "leads", "length", "paragraphs", "linked"]
            rows = [(k, n, *(c[x] for x in names)) for k, h in zip(frame[key], frame[html], strict=True) for n, c in enumerate(_containers(parsed(h)[0]))]
            yield pd.DataFrame(rows, columns=[key, "pos", *names])

    found = pages.select(key, html).mapInPandas(run, f"{key} {kind}, pos int, tag string, hinted boolean, leads string, length long, paragraphs long, linked long")
    return found.withColumn("score", node_score(F.col("length"), F.col("paragraphs"), F.col("linked")))


def chosen_containers(found: DataFrame, key: str = "page_id") -> DataFrame:
    """The container of each page: its first article, else its first main element, else its first main role, if of over 400 letters; else the best hinted one; else the best div, else the body.

    Only the first of a kind counts: a short first article does not pass its
    place to a longer second one.  Of equal scores the first counts.
    """
    tier = F.when(F.col("leads") == "article", 5).when(F.col("leads") == "main", 4).when(F.col("leads") == "role", 3).when(F.col("hinted"), 2).when(F.col("tag") == "div", 1).otherwise(0)
    # A section or short article without a hint is never chosen.
    able = (tier > 0) | (F.col("tag") == "body")
    rank = F.struct(tier.alias("tier"), F.when(tier >= 3, 0.0).otherwise(F.col("score")).alias("score"), (-F.col("pos")).alias("place"))
    return found.filter(able).groupBy(key).agg(F.max_by(F.struct("pos", "tag", "length", "paragraphs", "linked", "score"), rank).alias("c")).select(key, "c.*")


def _best(root: Node) -> Node:
    found = _containers(root)
    for kind in ("article", "main", "role"):
        for c in found:
            if c["leads"] == kind:
                return c["node"]

    def score(c: dict) -> float:
        return c["length"] * (1 + 0.1 * c["paragraphs"]) * (1 - min(c["linked"] / max(c["length"], 1), 0.9))

    pool = [c for c in found if c["hinted"]] or [c for c in found if c["tag"] == "div"] or [c for c in found if c["tag"] == "body"]
    return max(pool, key=score)["node"] if pool else root


def named(m: dict[str, str]) -> dict[str, str | None]:
    """A page's own metadata: the first name that says something counts."""
    return {
        "title": m.get("og:title") or m.get("twitter:title") or m.get("<title>") or None,
        "author": m.get("author") or m.get("article:author"),
        "published": m.get("article:published_time") or m.get("pubdate") or m.get("publishdate") or m.get("date"),
        "canonical": m.get("canonical"), "language": m.get("language"),
    }


def parsed_article(html: str | None) -> dict[str, str | None]:
    """Title, author, date, canonical address, language and text (paragraphs of the chosen container, else its raw text) of one page."""
    root, m = parsed(html)
    best = _best(root)
    own = "\n\n".join(said for p in best.all("p") if (said := p.text()))
    return {
        **named(m), "text": own or best.text("\n"), "paragraph_text": own, "whole": root.text("\n"),
    }


PARSED = ["title", "author", "published", "canonical", "language", "text", "paragraph_text", "whole"]


def cascade(pages: DataFrame, html: str = "html", enough: int = ENOUGH) -> DataFrame:
    """``pages`` without its HTML, plus extracted metadata, content and method.

    Three extractors in order: paragraphs of the chosen container, its text,
    all text of the page.  The next one counts only if what there is has fewer
    than ``enough`` characters, and only if it is longer.
    """
    kept = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(html)
            # A few pages at a time: their texts, three of each, leave before the next are read.
            for start in range(0, len(batch), SLICE):
                part = batch.slice(start, SLICE)
                found = [parsed_article(h) for h in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in kept] + [pa.array([f[n] for f in found], pa.string()) for n in PARSED], names=[*kept, *[f"x_{n}" for n in PARSED]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(kept).schema)
    raw = pages.mapInArrow(run, f"{fields}, " + ", ".join(f"x_{n} string" for n in PARSED))
    state = F.struct(F.lit("").alias("content"), F.lit("empty").alias("method"))
    for name, column in (("paragraphs", "x_paragraph_text"), ("container", "x_text"), ("page", "x_whole")):
        better, now = text.clean_text(F.coalesce(column, F.lit(""))), state
        take = (F.length(now["content"]) < enough) & (F.length(better) > F.length(now["content"]))
        state = F.when(take, F.struct(better.alias("content"), F.lit(name).alias("method"))).otherwise(now)
    done = raw.withColumn("x", state)
    return done.select(*kept, F.col("x_title").alias("title"), F.col("x_author").alias("author"), F.col("x_published").alias("published"), F.col("x_canonical").alias("canonical"), F.col("x_language").alias("language"), "x.content", "x.method")


def needs_extraction(provider: Column, content: Column, description: Column, snippet: Column) -> Column:
    """Wrapped links always; else items with little content or little text in all."""
    blank = F.lit("")
    every = F.concat_ws(" ", F.coalesce(description, blank), F.coalesce(snippet, blank), F.coalesce(content, blank))
    return F.coalesce(provider == "google_news", F.lit(False)) | (F.length(F.coalesce(content, blank)) < THIN) | (F.length(F.trim(every)) < THIN)


def enriched(items: DataFrame, extracted: DataFrame, key: str = "id", title_methods: list[str] | None = None) -> DataFrame:
    """Items after their pages were read: longer content wins, other fields fill gaps, the title only gives way to the named methods; the addresses follow the page.

    items: key, provider, title, url, canonical_url, content, author,
    published_at, language, publisher_name, publisher_domain; extracted: key,
    final_url, title, canonical, content, author, published, language, method.
    Items without a page stay as they are.
    """
    names = ["final_url", "title", "canonical", "content", "author", "published", "language", "method"]
    x = extracted.select(key, *[F.col(n).alias(f"x_{n}") for n in names])
    rows = items.join(x, key, "left")
    hit, c = F.col("x_method").isNotNull(), F.col

    def filled(old: str, new: str) -> Column:
        return F.coalesce(F.nullif(F.trim(old), F.lit("")), F.when(hit, c(new))).alias(old)

    final = F.coalesce(F.when(hit, c("x_final_url")), c("url"))
    host = F.coalesce(urls.host(final), F.lit(""))
    wrapped = c("provider") == "google_news"
    nameless = (F.trim(F.coalesce("publisher_name", F.lit(""))) == "") | F.lower(F.trim("publisher_name")).isin(publishers.WRAPPER_NAMES) | F.lower("publisher_name").contains(publishers.WRAPPER_HOST)
    title = F.when(hit & c("x_method").isin(title_methods or ["container"]) & (F.trim("x_title") != ""), c("x_title")).otherwise(F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.when(hit, c("x_title"))))
    return rows.select(
        key, "provider", title.alias("title"), final.alias("url"), F.when(hit, F.coalesce(F.nullif("x_canonical", F.lit("")), final)).otherwise(c("canonical_url")).alias("canonical_url"),
        F.when(hit & (F.length("x_content") > F.length(F.coalesce("content", F.lit("")))), c("x_content")).otherwise(c("content")).alias("content"), filled("author", "x_author"), filled("published_at", "x_published"), filled("language", "x_language"),
        F.when(hit & wrapped & nameless, host).otherwise(c("publisher_name")).alias("publisher_name"), F.when(hit & wrapped, host).otherwise(F.coalesce(F.nullif("publisher_domain", F.lit("")), F.when(hit, host))).alias("publisher_domain"),
    )


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its HTML, plus title, author, published, canonical address and language as the page names them.

    The first name that says something counts: og, twitter, then the title
    element; author by name, then by property; four names of the date.  What a
    page lacks is null, as everything of a null or empty page.  Names that
    ``pages`` has already are replaced.
    """
    names = ["title", "author", "published", "canonical", "language"]
    kept = [c for c in pages.columns if c != html and c.lower() not in names]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [named(parsed(h)[1]) for h in frame[html]]
            yield frame[kept].assign(**{n: [f[n] for f in found] for n in names})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(kept).schema)
    return pages.select(*kept, html).mapInPandas(run, f"{fields}, " + ", ".join(f"{n} string" for n in names))
