"""Legacy ARC archives and their conversion to WARC.

``write_arc`` lays pages down as ARC files (versions 1 and 2 in turn),
``read_arc`` parses version-specific header lines and declared lengths,
``convert`` synthesises equivalent WARC records (identifier, timestamp, type,
digests) and ``read_warc`` reads those back.  Records are gzip members of
their own, as both formats ask; uncompressed archives are read as well.

Payloads travel inside archive files only: tasks open the archives by name and
stream them member by member, and what decides about revisits (digest, id,
place) is a narrow table.  Every attempt of a task writes files of its own, and
the manifest, a table that Spark commits, names the files that count; so a
task that runs again, or twice at a time, leaves no record double.

Defined results: a null payload is an empty one, a null url is written ``-``
and a null id stays null.  Of equal payloads the one with the largest id is
the response, among equal ids the first in the archives.  An empty table gives
no archive and no row; repeated rows are records of their own; columns other
than the three named ones are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from io import BytesIO
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions

ROLL_BYTES = 32 << 20
READ_BYTES = 1 << 20
ID_HEADER = "X-Archive-Orig-Id"
REFERS_HEADER = "X-Refers-To-Id"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header fields of an ARC record line by version (fixed values of the format).
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _members(stream: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member, read in blocks; an uncompressed archive is one piece."""
    data = stream.read(READ_BYTES)
    if data[:2] != b"\x1f\x8b":
        yield 0, data + stream.read()
        return
    start = 0
    while data:
        unpacker, parts, size = zlib.decompressobj(31), [], 0
        while data and not unpacker.eof:
            parts.append(unpacker.decompress(data))
            size += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data if unpacker.eof else stream.read(READ_BYTES)
        yield start, b"".join(parts)
        start += size
        data = data or stream.read(READ_BYTES)


class _Files:
    """Writes members into numbered files of bounded size under names that no other attempt uses."""

    def __init__(self, folder: str, prefix: str, suffix: str):
        self.fs, self.folder = _opened(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.prefix, self.suffix, self.number, self.written = f"{prefix}-{uuid.uuid4().hex[:12]}", suffix, 0, 0
        self.out = None

    def name(self) -> str:
        return f"{self.prefix}-{self.number:05d}{self.suffix}"

    def open(self) -> bool:
        """Start a file if none is open; True if a new one was started."""
        if self.out is not None:
            return False
        self.out, self.written = self.fs.open_output_stream(f"{self.folder}/{self.name()}", compression=None), 0
        return True

    def write(self, member: bytes) -> None:
        self.out.write(member)
        self.written += len(member)

    def close(self) -> tuple[str, int] | None:
        """Name and size of the file that was open."""
        if self.out is None:
            return None
        self.out.close()
        done, self.out = (self.name(), self.written), None
        self.number += 1
        return done


def _opened(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


MANIFEST_SCHEMA = "archive string, bytes long, records long"


def _manifest_row(name: str, size: int, records: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["archive", "bytes", "records"])


# -- ARC -----------------------------------------------------------------


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 gleanwork\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str | None, date: str, page_id: int | None, payload: bytes, name: str, offset: int) -> bytes:
    own = f"{ID_HEADER}: {page_id}\r\n" if page_id is not None else ""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    values = {"URL": quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "-", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


def parse_arc(data: bytes | BinaryIO) -> Iterator[tuple[int, int, int, dict, bytes]]:
    """(version, member offset, place inside the member, header fields, block) of each record after the version block."""
    version = 1
    for offset, piece in _members(BytesIO(data) if isinstance(data, bytes) else data):
        at = 0
        while at < len(piece):
            end = piece.find(b"\n", at)
            if end < 0:
                break
            line = piece[at:end].decode("utf-8", "replace").strip()
            if not line:
                at = end + 1
                continue
            values = line.split(" ")
            size = int(values[-1])
            block = piece[end + 1 : end + 1 + size]
            if len(block) != size:
                raise ValueError(f"record at {offset} declares {size} bytes and has {len(block)}")
            if line.startswith("filedesc://"):
                version = int(block.split(b" ", 1)[0])
            else:
                fields = ARC_FIELDS[version]
                # A content type may hold blanks; the fields on its right and left may not.
                extra = len(values) - len(fields)
                values = values[:3] + [" ".join(values[3 : 4 + extra])] + values[4 + extra :]
                yield version, offset, at, dict(zip(fields, values, strict=True)), block
            at = end + 1 + size + 1


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(head with its blank line, lower-cased headers, payload) of an HTTP response block."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    cut = block.find(b"\r\n\r\n")
    head = block[: cut + 4] if cut >= 0 else block
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    return head, headers, block[len(head) :]


def _number(text: str | None) -> int | None:
    return int(text) if text not in (None, "") else None


def write_arc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "20260101000000") -> DataFrame:
    """Write one ARC record for each row; returns the manifest (archive, bytes, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, count = _Files(folder, f"part-{TaskContext.get().partitionId():06d}", ".arc.gz"), 0
        for batch in batches:
            for i, u, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = body if isinstance(body, bytes) else (body or "").encode("utf-8", "surrogatepass")
                version = 1 + files.number % 2
                if files.open():
                    files.write(_member(arc_version_block(version, files.name(), date)))
                files.write(_member(arc_record(version, u, date, i, raw, files.name(), files.written)))
                count += 1
                if files.written >= ROLL_BYTES:
                    yield _manifest_row(*files.close(), count)
                    count = 0
        if count:
            yield _manifest_row(*files.close(), count)

    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("i"), F.col(f"`{url}`").cast("string").alias("u"), F.col(f"`{payload}`").alias("p"))
    return materialize(rows.mapInArrow(run, MANIFEST_SCHEMA), "manifest")


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """A manifest of archives that others wrote: names and sizes, no content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("archive"), F.col("length").alias("bytes"), F.lit(None).cast("long").alias("records"))


def _tasks(manifest: DataFrame) -> int:
    """So many tasks that each reads about ROLL_BYTES of archives."""
    size, files = manifest.agg(F.sum("bytes"), F.count("*")).first()
    return max(1, min(files, -(-(size or 0) // ROLL_BYTES) + partitions(manifest.sparkSession)))


ARC_SCHEMA = "archive string, member long, place long, version int, url string, archive_date string, page_id long, payload_bytes long, payload_digest string"


def _table(rows: list[tuple], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])


ROWS_AT_ONCE = 4096


def read_arc(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """One row for each record: where it is, what its header says, size and digest of its payload."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{archive}", compression=None) as stream:
                    for version, member, place, fields, block in parse_arc(stream):
                        _, headers, payload = split_http(block)
                        rows.append((archive, member, place, version, fields["URL"], fields["Archive-date"], _number(headers.get(ID_HEADER.lower())), len(payload), digest(payload)))
                        if len(rows) == ROWS_AT_ONCE:
                            yield _table(rows, ARC_SCHEMA, types)
                            rows = []
                yield _table(rows, ARC_SCHEMA, types)

    files = manifest if manifest is not None else listed(spark, folder, "*.arc*")
    return files.select("archive").repartition(_tasks(files)).mapInArrow(run, ARC_SCHEMA)


# -- WARC ----------------------------------------------------------------


def record_id(archive: str, member: int, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{member}+{place}')}>"


def warc_date(arc_date: str) -> str:
    """ARC's 14 (or fewer) digits as WARC's timestamp."""
    d = arc_date.ljust(14, "0")
    month, day = (d[4:6], "01")[d[4:6] == "00"], (d[6:8], "01")[d[6:8] == "00"]
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(archive: str, member: int, place: int, fields: dict, block: bytes, original: dict | None) -> bytes:
    """The WARC record for an ARC record; ``original`` names the record of equal payload that it revisits."""
    head, _, payload = split_http(block)
    kind = "revisit" if original else "response" if head else "resource"
    body = head if original else block
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(archive, member, place)}", f"WARC-Date: {warc_date(fields['Archive-date'])}", f"WARC-Target-URI: {fields['URL']}", f"WARC-IP-Address: {fields['IP-address']}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(body)}"]
    if original:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {original['record']}"] + [f"{REFERS_HEADER}: {original['page_id']}"] * (original["page_id"] is not None)
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else fields['Content-type']}", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(archive, member, place, refers_to, refers_record) of every record whose payload another one holds.

    A digest may belong to a third of all rows: the original is found by a
    partial maximum, written down, and joined back from there, so that the
    join's shuffles stand alone and Spark can split a hot digest.
    """
    large = records.filter(F.col("payload_bytes") >= least_bytes)
    spot = F.struct(F.col("page_id"), (-F.col("member")).alias("m"), (-F.col("place")).alias("p"), F.col("archive").alias("a"))
    shared = materialize(large.groupBy("payload_digest").agg(F.max(spot).alias("top"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "top"), "originals")
    found = large.select("archive", "member", "place", "payload_digest").join(shared, "payload_digest")
    return found.filter("not (archive = top.a and member = -top.m and place = -top.p)").select("archive", "member", "place", F.col("top.page_id").alias("refers_to"), F.struct(F.col("top.a").alias("archive"), (-F.col("top.m")).alias("member"), (-F.col("top.p")).alias("place")).alias("original"))


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, records: DataFrame, least_bytes: int = 0, manifest: DataFrame | None = None) -> DataFrame:
    """Write a WARC file for each ARC file; returns their manifest.  Only names and decisions are shuffled."""
    # A file's own decisions: at most one small row for each of its records.
    by_archive = revisits(records, least_bytes).groupBy("archive").agg(F.collect_list(F.struct("member", "place", "refers_to", "original")).alias("revisits"))
    files = manifest if manifest is not None else listed(spark, arc_folder, "*.arc*")
    work = files.join(by_archive, "archive", "left").select("archive", "revisits").repartition(_tasks(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(arc_folder)
        for batch in batches:
            for archive, decided in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                originals = {(r["member"], r["place"]): {"page_id": r["refers_to"], "record": record_id(**r["original"])} for r in decided or ()}
                out, count = _Files(warc_folder, archive.split(".arc")[0], ".warc.gz"), 0
                out.open()
                info = b"software: gleanwork\r\nformat: WARC File Format 1.1\r\n"
                out.write(_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(archive, -1, 0)}\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                with fs.open_input_stream(f"{base}/{archive}", compression=None) as stream:
                    for _, member, place, fields, block in parse_arc(stream):
                        out.write(_member(warc_record(archive, member, place, fields, block, originals.get((member, place)))))
                        count += 1
                yield _manifest_row(*out.close(), count)

    return materialize(work.mapInArrow(run, MANIFEST_SCHEMA), "manifest")


def parse_warc(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased headers, block) of each record, by declared lengths."""
    for _, piece in _members(BytesIO(data) if isinstance(data, bytes) else data):
        at = 0
        while at < len(piece):
            cut = piece.find(b"\r\n\r\n", at)
            if cut < 0:
                break
            lines = piece[at:cut].decode("utf-8", "replace").strip().split("\r\n")
            headers = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
            size = int(headers["content-length"])
            yield headers, piece[cut + 4 : cut + 4 + size]
            at = cut + 4 + size + 4


WARC_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string"


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """One row for each response, resource or revisit record; size and digest are those of the full payload."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{archive}", compression=None) as stream:
                    for headers, block in parse_warc(stream):
                        kind = headers["warc-type"]
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        _, http, payload = split_http(block)
                        size, sum_ = (int(http["content-length"]), headers["warc-payload-digest"].removeprefix("sha1:")) if kind == "revisit" else (len(payload), digest(payload))
                        rows.append((_number(http.get(ID_HEADER.lower())), size, sum_, kind, _number(headers.get(REFERS_HEADER.lower())), headers["warc-record-id"], headers.get("warc-target-uri"), headers["warc-date"]))
                        if len(rows) == ROWS_AT_ONCE:
                            yield _table(rows, WARC_SCHEMA, types)
                            rows = []
                yield _table(rows, WARC_SCHEMA, types)

    files = manifest if manifest is not None else listed(spark, folder, "*.warc*")
    return files.select("archive").repartition(_tasks(files)).mapInArrow(run, WARC_SCHEMA)


def pages_through_archives(pages: DataFrame, root: str, least_bytes: int = 0) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the rows that the WARC files give; all under ``root``."""
    spark = pages.sparkSession
    arcs = write_arc(pages, f"{root}/arc")
    if not arcs.limit(1).count():
        return spark.createDataFrame([], WARC_SCHEMA)
    records = materialize(read_arc(spark, f"{root}/arc", arcs), "arc-records")
    warcs = convert(spark, f"{root}/arc", f"{root}/warc", records, least_bytes, arcs)
    return read_warc(spark, f"{root}/warc", warcs)
