"""A table that streams upsert into: bucketed deltas, merged when read.

A batch is written once, as files of the buckets that its keys fall into, and
becomes part of the table with one small log file, whose number is the next
version and which is created only if it is not there yet.  The log names the
stream and the batch, so a batch that comes again changes nothing, while a
stream restarted with a new checkpoint is another stream and loses nothing.
Readers take, for every key and column, the value of the latest version that
supplied it.  ``compact`` rewrites only buckets with many deltas; ``vacuum``
deletes files that no kept version names.

Layout: ``data/part=<name>/bucket=<n>/*.parquet`` and ``log/<version>.json``.
Columns are wrapped in one-field structs, null where a batch did not supply
them, so a supplied null is told from a missing column.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


class Conflict(Exception):
    """Another writer committed this version first."""


class UpsertTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: list[str], buckets: int = 16):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema)
        self.rest = [c for c in self.schema.names if c not in key]
        keys = [self.schema[c] for c in key]
        wrapped = [T.StructField(c, T.StructType([T.StructField("v", self.schema[c].dataType)])) for c in self.rest]
        self.stored = T.StructType([*keys, *wrapped, T.StructField("version", T.LongType()), T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType())])

    # Files, through the file system that Spark itself uses.
    def _fs(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _log(self) -> list[dict]:
        """Log entries in order of version."""
        fs, path = self._fs("log")
        if not fs.exists(path):
            return []
        names = sorted(n for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(".json") and not n.startswith((".", "_")))
        out = []
        for name in names:
            stream = fs.open(self._fs("log", name)[1])
            try:
                out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": int(name[:-5])})
            finally:
                stream.close()
        return out

    def _commit(self, version: int, entry: dict) -> None:
        """The entry appears whole under its number, or not at all: written aside, then renamed to a name that is still free."""
        fs, aside = self._fs("log", f".{uuid.uuid4().hex}")
        _, path = self._fs("log", f"{version:012d}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(aside, path):
            fs.delete(aside, False)
            raise Conflict(f"version {version} exists")

    def _live(self, log: list[dict]) -> dict[int, list[tuple[str, int]]]:
        """For each bucket its data folders with their versions: the last base, if any, and what came after it."""
        live: dict[int, list[tuple[str, int]]] = {}
        for entry in log:
            for b in entry["buckets"]:
                if entry["kind"] == "base":
                    # What was committed while a base was being written is not in it and stays.
                    live[b] = [(entry["data"], entry["version"]), *(d for d in live.get(b, []) if d[1] > entry["upto"])]
                else:
                    live.setdefault(b, []).append((entry["data"], entry["version"]))
        return live

    def _rows(self, live: dict[int, list[tuple[str, int]]]) -> DataFrame:
        folders = [f"{self.root}/data/part={data}/bucket={b}" for b, parts in live.items() for data, _ in parts]
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).option("basePath", f"{self.root}/data").parquet(*folders)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """Keys with the latest supplied value of every column, still wrapped; the maxima are combined before the shuffle."""
        latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c) for c in self.rest]
        return rows.groupBy("bucket", *self.key).agg(*latest, F.max("version").alias("version"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, where: dict | None = None) -> DataFrame:
        """The table now or at a version; ``where`` gives the values of all key columns of one row, whose bucket alone is read."""
        live = self._live([e for e in self._log() if version is None or e["version"] <= version])
        if where is not None:
            one = self.spark.range(1).select(*[F.lit(where[k]).cast(self.schema[k].dataType).alias(k) for k in self.key])
            bucket = one.select(self._bucket()).first()[0]
            live = {bucket: live.get(bucket, [])}
        rows = self._rows(live)
        if where is not None:
            rows = rows.filter(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(where[k])) for k in self.key]))
        return self._merged(rows).select(*[F.col(c) if c in self.key else F.col(f"{c}.v").alias(c) for c in self.schema.names])

    def apply(self, batch: DataFrame, batch_id: int, stream: str = "", order: list[str] | None = None) -> bool:
        """Commit a batch of a stream; False if the log has it already.

        Columns that the batch lacks keep their values.  Of several rows of one
        key the last by ``order`` counts (by all columns if none is given).
        """
        supplied = [c for c in self.rest if c in batch.columns]
        last = F.max_by(F.struct(F.lit(True).alias("__row"), *supplied), F.struct(*(order or batch.columns)))
        once = batch.groupBy(*self.key).agg(last.alias("l"))
        values = [(F.struct(F.col(f"l.{c}").cast(self.schema[c].dataType).alias("v")) if c in supplied else F.lit(None).cast(self.stored[c].dataType)).alias(c) for c in self.rest]
        rows = once.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.key], *values)
        while True:
            log = self._log()
            if any(e["kind"] == "delta" and e["stream"] == stream and e["batch"] == batch_id for e in log):
                return False
            version = log[-1]["version"] + 1 if log else 0
            buckets, data = self._write(rows.withColumn("version", F.lit(version).cast("long")))
            try:
                self._commit(version, {"kind": "delta", "stream": stream, "batch": batch_id, "data": data, "buckets": buckets})
                return True
            except Conflict:
                continue

    def _write(self, rows: DataFrame) -> tuple[list[int], str]:
        """Write rows by bucket; (the buckets that have rows, the folder's name)."""
        data = uuid.uuid4().hex
        path = f"{self.root}/data/part={data}"
        if "bucket" not in rows.columns:
            rows = rows.withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.partitionBy("bucket").parquet(path)
        fs, folder = self._fs("data", f"part={data}")
        found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removeprefix("bucket=")) for n in found if n.startswith("bucket=")), data

    def compact(self, deltas: int = 8) -> list[int]:
        """Rewrite the buckets that have more than ``deltas`` folders as one each; returns them."""
        log = self._log()
        many = {b: parts for b, parts in self._live(log).items() if len(parts) > deltas}
        if many:
            buckets, data = self._write(self._merged(self._rows(many)))
            upto = log[-1]["version"]
            version = upto + 1
            while True:
                try:
                    self._commit(version, {"kind": "base", "data": data, "buckets": buckets, "upto": upto})
                    break
                except Conflict:
                    version += 1
        return sorted(many)

    def vacuum(self) -> list[str]:
        """Delete data folders of which the present version reads no bucket; older versions that named them can't be read after it."""
        fs, folder = self._fs("data")
        log = self._log()
        named = {e["data"] for e in log}
        used = {data for parts in self._live(log).values() for data, _ in parts}
        # Folders that the log does not name may belong to a writer about to commit.
        gone = [n for s in fs.listStatus(folder) if (n := s.getPath().getName().removeprefix("part=")) in named - used] if fs.exists(folder) else []
        for name in gone:
            fs.delete(self._fs("data", f"part={name}")[1], True)
        return gone


def upsert_stream(stream: DataFrame, table: UpsertTable, checkpoint: str, compact_every: int = 16, order: list[str] | None = None) -> StreamingQuery:
    """Upsert every micro-batch of what has landed, then stop; the stream is known by the id that its checkpoint keeps."""

    def step(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if own is None:
            raise RuntimeError("Spark names no query for this batch")
        table.apply(batch, batch_id, own, order)
        if compact_every and batch_id % compact_every == compact_every - 1:
            table.compact()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
