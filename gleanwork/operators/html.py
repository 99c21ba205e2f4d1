"""Article extraction from a table of raw HTML pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pagetree import Node, parsed

#: Tags that begin a line of their own.
LINES = ("p", "br", "div", "h1", "h2", "h3", "li", "article", "main")


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang=\"([^\"]*)\"", 1), F.lit(""))


def _lines(top: Node | None) -> str:
    """Text of a node, a line for each block."""
    blocks: list[list[str]] = [[]]
    for n in top.walk() if top is not None else ():
        if isinstance(n, str):
            blocks[-1].append(n)
        elif n.tag in LINES:
            blocks.append([])
    return "\n".join(s for s in (" ".join("".join(b).split()) for b in blocks) if s)


def extract_one(html: str | None) -> tuple[str, str, float]:
    """(text, method, share of linked text): the articles and main elements if they hold 400 characters, else all blocks."""
    root, _ = parsed(html)
    outer, waiting = Node("", {}, None), [root]
    while waiting:
        n = waiting.pop()
        if isinstance(n, Node):
            if n.tag in ("article", "main"):
                outer.children.append(n)
            else:
                waiting.extend(reversed(n.children))
    article, whole = _lines(outer), _lines(root)
    share = min(1.0, sum(len(n) for link in root.all("a") for n in link.walk() if isinstance(n, str)) / max(1, len(whole)))
    return (article, "container", share) if len(article) > 400 else (whole, "blocks" if whole else "none", share)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its HTML, plus body, method and link_share, page by page in Arrow batches."""
    kept = [c for c in pages.columns if c != html]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [extract_one(h) for h in frame[html]]
            yield frame[kept].assign(body=[f[0] for f in found], method=[f[1] for f in found], link_share=[f[2] for f in found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(kept).schema)
    return pages.mapInPandas(run, f"{fields}, body string, method string, link_share double")
