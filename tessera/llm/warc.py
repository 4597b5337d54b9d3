"""Web archive records, and the resolution of not-modified revisits.

A revisit (status 304) has no body. It stands for the latest earlier full
response of its canonical URL, if its validators agree with that response's;
its header fields then update the response's, as far as RFC 9111 permits.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Time is cut into so many parts, by quantiles, so that a hot URL's rows spread over tasks.
TIME_PARTS = 256
# Fields that a 304 does not update.
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that only say where a visitor came from.
TRACKING = r"^(utm_[a-z_]+|gclid|fbclid|msclkid|mc_eid|mc_cid|igshid)(=|$)"

_GZIP = b"\x1f\x8b\x08"
PIECE = 1 << 16
BATCH_BYTES = 16_000_000
RECORDS = "record_id string, url string, time timestamp, type string, status int, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """Host, path and query without scheme, user, www, default port, fragment, closing slashes and tracking parameters; parameters sorted. Null for what isn't an absolute URL."""
    form = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)\??([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, form, 2)), r"^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(url, form, 3), r"/+$", "")
    parts = F.filter(F.split(F.regexp_extract(url, form, 4), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.array_join(F.array_sort(parts), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(url.rlike(form) & (host != ""), whole)


def _field(headers: Column, name: str) -> Column:
    """A header field's value; names are lower-case. Blank counts as absent."""
    value = F.trim(F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), F.lit(0)))
    return F.when(value != "", value)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^[Ww]/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """stored, its fields replaced by fresh ones where permitted; names in lower case."""

    def lower(headers, keep):
        entries = F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
        named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        # of a name in two spellings the first counts
        first = F.filter(named, lambda e, i: ~F.exists(F.slice(named, F.lit(1), i), lambda o: o["key"] == e["key"]))
        return F.filter(first, keep)

    new = lower(fresh, lambda e: ~e["key"].isin(*KEPT_FIELDS))
    names = F.transform(new, lambda e: e["key"])
    old = lower(stored, lambda e: ~F.array_contains(names, e["key"]))
    return F.map_from_entries(F.array_sort(F.concat(old, new)))


def resolve_revisits(records: DataFrame, time_parts: int = TIME_PARTS) -> DataFrame:
    """Every revisit of records (record_id, url, time, status, headers; others are ignored) with what it refers to.

    Returns record_id, canonical_url, time, refers_to (the record_id of the
    latest full response, status 200, of the same canonical URL at an earlier time, or at
    the same time with a smaller record_id), state and headers. state is
    "resolved"; "changed" if an ETag or else a Last-Modified date is on both
    sides and differs; "unvalidated" if neither is on both sides; "missing" if there is no such response or no valid
    URL or time. headers are the merged fields if resolved, else the revisit's
    own, names in lower case. Repeated rows are resolved alike; an empty table gives no rows.

    The latest response before a row is looked for in two levels: within a part
    of the time, and over the parts' last responses. A URL, however hot, has at
    most ``time_parts`` rows on the second level. Bodies are never moved.
    """
    info = F.struct("record_id", F.col("headers"))
    canonical = canonical_url(F.col("url"))
    slim = records.select("record_id", canonical.alias("_url"), F.col("time").alias("_time"), F.col("time").cast("double").alias("_seconds"), "status", "headers").where("status in (200, 304)")
    shares = [i / time_parts for i in range(1, time_parts)]
    bounds = sorted(set(slim.approxQuantile("_seconds", shares, 0.25 / time_parts))) if shares else []
    if bounds:
        from pyspark.ml.feature import Bucketizer

        inf = float("inf")
        slim = Bucketizer(splits=[-inf, *bounds, inf], inputCol="_seconds", outputCol="_part", handleInvalid="keep").transform(slim).withColumn("_part", F.col("_part").cast("int"))
    else:
        slim = slim.withColumn("_part", F.lit(0))
    usable = slim.where("_url is not null and _time is not null")
    full = F.when(F.col("status") == 200, info)
    here = W.partitionBy("_url", "_part").orderBy("_time", "record_id", "status").rowsBetween(W.unboundedPreceding, -1)
    near = usable.withColumn("_near", F.last(full, ignorenulls=True).over(here)).where("status = 304")
    ends = usable.where("status = 200").groupBy("_url", "_part").agg(F.max_by(info, F.struct("_time", "record_id")).alias("_last"))
    # a part needs the last response of the latest earlier part that has one
    asked = near.where("_near is null").select("_url", "_part").distinct()
    steps = ends.unionByName(asked.join(ends.select("_url", "_part"), ["_url", "_part"], "left_anti").withColumn("_last", F.lit(None).cast(ends.schema["_last"].dataType)))
    before = W.partitionBy("_url").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = steps.select("_url", "_part", F.last("_last", ignorenulls=True).over(before).alias("_earlier"))
    joined = near.join(carried, ["_url", "_part"], "left").withColumn("_found", F.coalesce("_near", "_earlier"))
    lost = slim.where("status = 304 and (_url is null or _time is null)").withColumn("_found", F.lit(None).cast(joined.schema["_found"].dataType))
    columns = ["record_id", "_url", "_time", "headers", "_found"]
    both = joined.select(columns).unionByName(lost.select(columns))
    theirs, own = F.col("_found.headers"), F.col("headers")
    checked = both.withColumns({"_e1": _weak(_field(theirs, "etag")), "_e2": _weak(_field(own, "etag")), "_m1": _field(theirs, "last-modified"), "_m2": _field(own, "last-modified")})
    state = (
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("_e1").isNotNull() & F.col("_e2").isNotNull(), F.when(F.col("_e1") == F.col("_e2"), "resolved").otherwise("changed"))
        .when(F.col("_m1").isNotNull() & F.col("_m2").isNotNull(), F.when(F.col("_m1") == F.col("_m2"), "resolved").otherwise("changed"))
        .otherwise("unvalidated")
    )
    checked = checked.withColumn("state", state)
    merged = F.when(F.col("state") == "resolved", merged_headers(theirs, own)).otherwise(merged_headers(F.lit(None).cast("map<string,string>"), own))
    return checked.select("record_id", F.col("_url").alias("canonical_url"), F.col("_time").alias("time"), F.col("_found.record_id").alias("refers_to"), "state", merged.alias("headers"))


class _Member(io.RawIOBase):
    """What one gzip member of ``data`` unpacks to, piece by piece; ``end`` is where the next one may begin.

    A damaged member ends where the damage shows; the next one begins at the next gzip header.
    """

    def __init__(self, data: bytes, begin: int):
        self.data, self.at, self.end = data, begin, None
        self.unpack, self.ready = zlib.decompressobj(31), memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.ready and self.end is None:
            piece = self.unpack.unconsumed_tail or self.data[self.at : self.at + PIECE]
            if not self.unpack.unconsumed_tail:
                self.at += len(piece)
            try:
                self.ready = memoryview(self.unpack.decompress(piece, PIECE))
            except zlib.error:
                found = self.data.find(_GZIP, self.at - len(piece) + 1)
                self.end = found if found >= 0 else len(self.data)
            if self.unpack.eof:
                self.end = self.at - len(self.unpack.unused_data)
            elif not piece:
                self.end = len(self.data)
        size = min(len(target), len(self.ready))
        target[:size] = self.ready[:size]
        self.ready = self.ready[size:]
        return size


def _members(data: bytes):
    """A file's records as streams: one for each gzip member, or all in one plain stream."""
    if not data.startswith(_GZIP):
        yield io.BytesIO(data)
        return
    at = 0
    while at < len(data):
        if not data.startswith(_GZIP, at):  # padding, or damage
            at = data.find(_GZIP, at)
            if at < 0:
                return
        member = _Member(data, at)
        stream = io.BufferedReader(member, PIECE)
        yield stream
        while stream.read(PIECE):
            pass
        at = max(member.end, at + 1)


def _head(stream) -> dict[str, str] | None:
    """The first line, under "", and the header fields up to a blank line, names in lower case; of a repeated field the values, comma-joined."""
    found, line = {}, stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    found[""] = line.decode("latin-1").strip()
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:
            found[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            found[name] = f"{found[name]}, {value.strip()}" if name in found else value.strip()
    return found


def parse_warc(data: bytes):
    """(record id, url, time, type, status, headers, body) of a file's response and revisit records.

    Lines that belong to no record are passed over up to the next one that
    begins with WARC/, and so are records without a valid Content-Length, and
    those whose block is cut short. The file is read once, a piece at a time.
    """
    for stream in _members(data):
        first = stream.readline()
        while first:
            if not first.startswith(b"WARC/"):
                first = stream.readline()
                continue
            head = _head(_Before(first, stream))
            length = head.get("content-length", "")
            if not re.fullmatch("[0-9]{1,18}", length):
                first = stream.readline()
                continue
            kind = head.get("warc-type", "")
            if kind not in ("response", "revisit"):
                left = int(length)
                while left and (skipped := len(stream.read(min(left, PIECE)))):
                    left -= skipped
                first = stream.readline()
                continue
            block = stream.read(int(length))
            first = stream.readline()
            if len(block) < int(length):
                continue
            inner = io.BytesIO(block)
            http = _head(inner) or {"": ""}
            status = re.match(r"HTTP/\S+ (\d{3})", http.pop("", ""))
            code = int(status[1]) if status else 304 if kind == "revisit" else None
            yield head.get("warc-record-id"), head.get("warc-target-uri", "").strip("<>") or None, head.get("warc-date"), kind, code, http, inner.read()


class _Before:
    """A stream's lines after a line that was read from it already."""

    def __init__(self, first: bytes, stream):
        self.first, self.stream = first, stream

    def readline(self) -> bytes:
        line, self.first = self.first, None
        return line if line is not None else self.stream.readline()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files, plain or gzipped by record, as RECORDS; see parse_warc().

    A file is one row of Spark's binaryFile source, so files are limited to 2 GB.
    Records leave in batches of about BATCH_BYTES, however many a file has.
    """
    kinds = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("time", pa.string()), ("type", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for *row, headers, body in parse_warc(content.as_py()):
                    rows.append(dict(zip(kinds.names, (*row, list(headers.items()), body))))
                    size += len(body) + 500
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(run, RECORDS.replace("time timestamp", "time string"))
    return found.withColumn("time", F.try_to_timestamp("time"))


def record_bytes(record_id: str, url: str, time: str, kind: str, status: int, headers: dict, body: bytes = b"") -> bytes:
    """One gzipped WARC record."""
    block = f"HTTP/1.1 {status} X\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {time}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n")
