"""Tables in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read again: its lineage ends here."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return df.checkpoint()
    path = f"{folder.rstrip('/')}/gleanwork-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.gleanwork_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what no plan reads any more."""
    for df in frames:
        if path := getattr(df, "gleanwork_path", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its least node.

    Every node points to its least neighbour if that is less, pointers are
    followed to their roots by doubling, and links are drawn between roots
    anew, until none is left.  What is left shrinks from round to round, and
    each round's doublings are as many as the logarithm of its longest chain.
    The minima are combined before they are shuffled, so a node with very many
    links is one row there.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        while True:
            further = root.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = written(root.join(further, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
            forget(root)
            root = jumped.select("node", "root")
            root.gleanwork_path = getattr(jumped, "gleanwork_path", None)
            if not jumped.filter("moved").limit(1).count():
                break
        rounds.append(root)
        ends = [root.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")) for end in ("a", "b")]
        drawn = edges.join(ends[0], "a").join(ends[1], "b").filter("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
        before, edges = edges, written(drawn, "links")
        forget(before)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0].select("node", F.col("root").alias("component"))
    for later in rounds[1:]:
        found = found.join(later.select(F.col("node").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    out = written(found, "components")
    forget(edges, *rounds)
    return out
