from __future__ import annotations

import base64
import gzip
import hashlib
import os

from tessera.llm import warc

PAGES = [(3, "http://a", "same"), (1, "http://b\r\nX: y", "same"), (2, None, None), (5, "u", ""), (4, "ü", "ünï\r\n\r\nWARC/1.1"), (None, "n", "same"), (1, "http://b\r\nX: y", "same"), (None, "n", "alone")]


def expected(rows, least=0):
    first = {}
    for key, _, html in rows:
        if key is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", key), key)
    out = []
    for key, _, html in rows:
        value = (html or "").encode()
        again = len(value) >= least and (html or "") in first and first[html or ""] != key
        out.append((key, len(value), base64.b32encode(hashlib.sha1(value).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for least in (0, 1, 5):
        index = warc.write(pages, "page_id", "url", "html", least)
        out = warc.read(index)
        assert found(out) == expected(PAGES, least)
        assert all(r.intact for r in out.collect())
        payloads = {r.id: bytes(r.payload).decode() for r in out.filter("record_type = 'response' AND id IS NOT NULL").collect()}
        assert all(payloads[k] == (h or "") for k, _, h in PAGES if k in payloads)


def test_archives_are_plain_warc(spark):
    index = warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), "page_id", "url", "html").collect()
    for file in {r.file for r in index}:
        path = file.removeprefix("file://")
        data, raw = gzip.open(path).read(), open(path, "rb").read()
        assert os.path.getsize(path) == sum(r.length for r in index if r.file == file)
        places = sorted((r.offset, r.length) for r in index if r.file == file)
        assert b"".join(gzip.decompress(raw[o : o + n]) for o, n in places) == data
        assert all(gzip.decompress(raw[o : o + n]).endswith(b"\r\n\r\n") for o, n in places)


def test_selected_records_are_read_alone(spark):
    index = warc.write(spark.createDataFrame([(i, f"u{i}", f"page {i}" * i) for i in range(50)], "id long, url string, html string"), "id", "url", "html")
    assert [(r.id, bytes(r.payload).decode()) for r in warc.read(index.filter("id IN (7, 31)")).orderBy("id").collect()] == [(i, f"page {i}" * i) for i in (7, 31)]
    assert warc.read(index.limit(0)).count() == 0
    assert warc.merged([(0, 5), (6, 9), (100, 120)], gap=2, most=50) == [(0, 9, [0, 1]), (100, 120, [2])]
    assert warc.merged([(0, 60), (60, 70)], gap=2, most=50) == [(0, 60, [0]), (60, 70, [1])]


def test_query(spark, sf_dir):
    from tessera.llm.queries import op5_warc

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op5_warc(spark, sf_dir).collect()), key=str)
    assert got == expected(rows)
