"""WARC archives written, read back, resolved and rewritten."""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow.fs as pafs
import pytest

from framelake.llm import warc
from framelake.llm.common import shared_folder

BIG, OTHER, SMALL = "<p>é" * 400, "x" * 1000, "y" * 999
PAGES = [
    (1, "http://a/1", BIG), (7, "http://a/7", BIG), (3, None, BIG), (None, "http://a/n", BIG), (2, "http://b", OTHER),
    (4, "http://s", SMALL), (5, "http://s", SMALL), (6, "http://e\r\nX: y", None), (8, "", ""), (9, "u", OTHER), (9, "u", OTHER),
    (10, "http://crlf", "a\r\n\r\nWARC/1.1\r\n" * 90), (None, "n", "z" * 2000), (None, "m", "z" * 2000),
]


def brute(rows, least=1000):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        last = max(same) if same and len(body) >= least else None
        again = last is not None and last != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, payload_digest string, original int")


def solved(spark, folder):
    found = warc.resolve_revisits(warc.read_archives(spark, folder, payloads=False)).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted([tuple(r[n] for n in names) for r in found], key=str)


def test_round_trip(spark):
    folder = shared_folder(spark, "t")
    written = warc.write_archives(pages(spark), folder)
    assert written.agg({"records": "sum"}).first()[0] == len(PAGES)
    assert solved(spark, folder) == brute(PAGES)
    records = warc.read_archives(spark, folder).collect()
    bodies = {i: (h or "").encode() for i, _, h in PAGES if i is not None}
    assert all(bytes(r["payload"]) == bodies[r["page_id"]] for r in records if r["payload"] is not None and r["page_id"] is not None)
    assert {r["payload"] for r in records if r["record_type"] == "revisit"} == {None}


def test_rewriting_keeps_captures(spark):
    folder, again = shared_folder(spark, "t"), shared_folder(spark, "t")
    warc.write_archives(pages(spark), folder, least=1)
    warc.rewrite_archives(spark, folder, again, least=1000)
    assert solved(spark, again) == brute(PAGES)


def test_archives_roll_and_empty_tables(spark, monkeypatch):
    folder, empty = shared_folder(spark, "t"), shared_folder(spark, "t")
    monkeypatch.setattr(warc, "ROLL", 200)
    files = warc.write_archives(pages(spark).coalesce(1), folder)
    assert files.count() > 3 and solved(spark, folder) == brute(PAGES)
    assert warc.write_archives(pages(spark).limit(0), empty).count() == 0
    assert solved(spark, empty) == []


def test_records_are_standard(spark):
    folder = shared_folder(spark, "t")
    warc.write_archives(pages(spark, PAGES[:2]).coalesce(1), folder)
    path = folder.removeprefix("file://").removeprefix("file:")
    names = [f.path for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(path)) if f.path.endswith(".warc.gz")]
    raw = b"".join(gzip.open(n).read() for n in names)
    heads = [fields for fields, _ in warc.parse(io.BytesIO(raw))]
    by_type = {h["warc-type"]: h for h in heads}
    assert by_type["revisit"]["warc-refers-to"] == by_type["response"]["warc-record-id"]
    assert by_type["revisit"]["warc-profile"] == warc.PROFILE
    assert all(h["warc-payload-digest"].startswith("sha1:") and len(h["warc-payload-digest"]) == 37 for h in heads)


def test_damage_is_found(spark):
    block = warc._http(3) + b"abc"
    head = warc._head([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + "0" * 40), ("Content-Type", "application/http")], len(block))
    fields, body = next(warc.parse(io.BytesIO(head + block + b"\r\n\r\n")))
    with pytest.raises(ValueError, match="digest"):
        warc._row(fields, body, "f", True)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(io.BytesIO(head + block[:-1])))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.parse(io.BytesIO(b"nonsense\r\n")))
