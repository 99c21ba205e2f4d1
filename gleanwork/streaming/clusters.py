"""Online clustering of a stream: the batch rule, with open clusters kept as state.

A block's state is a map of open clusters by number and a map from words to the
numbers of the clusters that hold them, so an article reads the clusters it
shares a word with and writes the one it joins; the rest of the block's state is
not touched.  A timer for the end of each cluster's window removes it and its
words.  An article comes to a cluster through a word of its signature, as a
signature that is equal or overlaps shares one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.clustering import OpenCluster, described, dump, load

SCHEMA = "item_id string, story_id string"


class _Clusters(StatefulProcessor):
    def __init__(self, hours: int):
        self.window = pd.Timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "n long")
        self.live = handle.getMapState("live", "n long", "cluster string")
        self.by_word = handle.getMapState("by_word", "word string", "ns array<long>")
        self.ends = handle.getMapState("ends", "ms long", "ns array<long>")

    def _end(self, cluster: OpenCluster) -> int:
        """First moment, in milliseconds, at which no article can join."""
        return int((cluster.at + self.window).timestamp() * 1000) + 1

    def _of(self, state, key) -> list[int]:
        return list(state.getValue((key,))[0]) if state.containsKey((key,)) else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names are Spark's
        # One micro-batch's articles of the block, in order of time.
        articles = pd.concat(list(rows)).sort_values(["published_at", "title_key", "item_id"], na_position="first")
        known: dict[int, OpenCluster] = {}
        changed: set[int] = set()
        words: dict[str, list[int]] = {}
        count = self.opened.get()[0] if self.opened.exists() else 0
        began, found = count, []
        for a in articles.itertuples():
            if pd.isna(a.published_at):
                found.append((a.item_id, a.item_id))
                continue
            own = list(dict.fromkeys(a.words))
            for w in own:
                if w not in words:
                    words[w] = self._of(self.by_word, w)
            near = sorted({n for w in own for n in words[w]})
            for n in near:
                if n not in known:
                    known[n] = load(self.live.getValue((n,))[0])
            n = next((n for n in near if known[n].takes(a, self.window)), None)
            if n is None:
                n, count = count, count + 1
                known[n] = OpenCluster(a)
            else:
                known[n].add(a)
            changed.add(n)
            for w in own:
                if n not in words[w]:
                    words[w].append(n)
            found.append((a.item_id, known[n].id))
        for n in sorted(changed):
            self.live.updateValue((n,), (dump(known[n]),))
            if n >= began:
                end = self._end(known[n])
                self.ends.updateValue((end,), ([*self._of(self.ends, end), n],))
                self.handle.registerTimer(end)
        for w, ns in words.items():
            if ns:
                self.by_word.updateValue((w,), (ns,))
        self.opened.update((count,))
        yield pd.DataFrame(found, columns=["item_id", "story_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs()
        for n in self._of(self.ends, end):
            for w in load(self.live.getValue((n,))[0]).words:
                left = [m for m in self._of(self.by_word, w) if m != n]
                if left:
                    self.by_word.updateValue((w,), (left,))
                else:
                    self.by_word.removeKey((w,))
            self.live.removeKey((n,))
        self.ends.removeKey((end,))
        yield pd.DataFrame({"item_id": [], "story_id": []}, dtype=object)

    def close(self) -> None:
        pass


def cluster_stream(articles: DataFrame, block: str, hours: int = 36, late: str = "1 hour") -> DataFrame:
    """(item_id, story_id) of each article as it arrives; clusters past the window and the watermark are forgotten.

    Within a micro-batch articles are taken in order of time, title and id;
    one that arrives after later ones joins what is open then.
    """
    ready = described(articles.withColumn("item_id", F.col("item_id").cast("string")).withWatermark("published_at", late), block)
    return ready.groupBy(block).transformWithStateInPandas(_Clusters(hours), outputStructType=SCHEMA, outputMode="append", timeMode="EventTime")
