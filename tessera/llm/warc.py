"""WARC archives: deduplicated writing with an index, and coalesced reads of byte ranges.

Writing: every record is one gzip member, a WARC/1.1 `response` or `revisit` with an HTTP head in its block. Of the
records with equal payloads of at least `least` bytes those with the smallest id are responses, the others revisit it
and hold no payload. Rows that repeat both id and payload stay responses; ids that are null come after all others and,
where a group has no other, are responses. A null payload is empty and a null URL has no header.

The index comes first: as a task appends records to its archive, it returns file, offset, length, URL and digest of
each, and Spark commits these rows. An archive of a lost attempt has a name of its own that no row of the index gives.

Reading: what is to be read is selected from the index; the selected records' ranges, sorted by file and offset, are
merged where the gap is small, and each merged range is read at once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import bounded, steps
from tessera.llm.store import fresh_path, written

ROLL = 1 << 29
LEVEL = 6
GAP = 1 << 16
RANGE = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, id long, record_type string, refers_to long, payload_bytes long"
PAYLOADS = "id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, intact boolean"
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, _ARROW[k]) for x, k in zip(columns, kinds, strict=True)], names=list(names))


def _at(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), unquote(parts.path)
    return pyarrow.fs.FileSystem.from_uri(uri)


def _uri(key: int | None) -> bytes:
    return b"<urn:x-record:%s>" % (b"" if key is None else b"%d" % key)


def record(key: int | None, url: str | None, payload: bytes, digest: str, first: int | None, again: bool) -> bytes:
    """One record, not compressed; again: whether it revisits the record called first."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if again else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if again else b"response"), b"WARC-Record-ID: " + _uri(key), b"WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\r\n]+", b" ", url.encode()))
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if again:
        head += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: " + _uri(first)]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def _deduplicated(pages: DataFrame, key: str, url: str, payload: str, least: int) -> DataFrame:
    """id, url, payload, sha1 in hexadecimal digits, the first id of the payload, again.

    The first ids are a table of a row for each payload; it meets the payloads in a join that adaptive execution splits
    where one payload has a large part of all rows.
    """
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), text.alias("payload"), F.sha1(text).alias("sha1"))
    alike = F.octet_length("payload") >= least
    first = written(rows.filter(alike).groupBy("sha1").agg(F.min("id").alias("first")), "warc-first")
    again = alike & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(first.hint("merge"), "sha1", "left").select("id", "url", F.encode("payload", "utf-8").alias("payload"), "sha1", "first", again.alias("again"))


def write(pages: DataFrame, key: str, url: str, payload: str, least: int = 0) -> DataFrame:
    """Archives of the rows of pages in the shared folder; returns their index."""
    bounded(pages.sparkSession)
    folder = fresh_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _at(folder)
        stream = uri = None
        at = 0
        for batch in steps(batches):
            rows = []
            for key, url, payload, sha1, first, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None or at >= ROLL:
                    if stream is not None:
                        stream.close()
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    system.create_dir(path, recursive=True)
                    stream, uri, at = system.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}", 0
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = pack.compress(record(key, url, payload, digest, first, again)) + pack.flush()
                stream.write(data)
                rows.append((uri, at, len(data), url, digest, key, "revisit" if again else "response", first if again else None, len(payload)))
                at += len(data)
            yield _batch(rows, INDEX)
        if stream is not None:
            stream.close()

    return written(_deduplicated(pages, key, url, payload, least).mapInArrow(run, INDEX), "warc-index")


def merged(spans: list[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> list[tuple[int, int, list[int]]]:
    """Ranges over sorted (start, end) spans, at most `gap` apart and together at most `most` bytes unless one alone is
    longer, each with the spans' places."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (start, end) in enumerate(spans):
        if out and start - out[-1][1] <= gap and max(end, out[-1][1]) - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(end, out[-1][1]), [*out[-1][2], i])
        else:
            out.append((start, end, [i]))
    return out


def read(selected: DataFrame) -> DataFrame:
    """The payloads of rows of an index: id, url, record_type, refers_to, payload (null for a revisit), payload_bytes and
    payload_digest of the full payload, intact (whether a payload has the digest of its head and the index)."""
    rows = selected.select(*[f.split()[0] for f in INDEX.split(", ")]).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stream = None
        for batch in batches:
            records = batch.to_pylist()
            for uri, group in groupby(records, lambda r: r["file"]):
                group = list(group)
                if uri != name:
                    if stream is not None:
                        stream.close()
                    system, path = _at(uri)
                    name, stream = uri, system.open_input_file(path)
                for start, end, places in merged([(r["offset"], r["offset"] + r["length"]) for r in group]):
                    data, out = stream.read_at(end - start, start), []
                    for r in (group[i] for i in places):
                        headers, payload = parse(zlib.decompress(data[r["offset"] - start : r["offset"] + r["length"] - start], 31))
                        claimed = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "revisit":
                            out.append((r["id"], r["url"], "revisit", r["refers_to"], None, r["payload_bytes"], claimed, claimed == r["digest"]))
                            continue
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        out.append((r["id"], r["url"], "response", None, payload, len(payload), digest, digest == claimed == r["digest"]))
                    yield _batch(out, PAYLOADS)
        if stream is not None:
            stream.close()

    return rows.mapInArrow(run, PAYLOADS)
