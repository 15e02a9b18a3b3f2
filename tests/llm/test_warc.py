"""Archives: what is written is read back, member by member; damaged and foreign files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from caseloom.llm import warc

PAGES = "page_id bigint, url string, html string, digest string, file int, head bigint"
BIG = "<p>" + "é" * 3_000_000
ROWS = [
    (5, "http://a.example/x", "<p>one"), (3, "http://a.example/y z\r\nq", "<p>one"), (9, None, "<p>one"), (4, "u", None), (6, "u", ""),
    (7, "http://b.example/", BIG), (8, "http://b.example/", "<p>two\r\n\r\nWARC/1.1\r\n"), (3, "http://a.example/y", "<p>one"),
    (None, "n", "<p>one"), (None, "n", "<p>alone"), (None, "n", "<p>alone"), (10, "ü", "<p>three 😀"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "d", 1, 2) for r in ROWS], PAGES).repartition(3)


def told(min_bytes=0):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row."""
    heads = defaultdict(list)
    for i, _, html in ROWS:
        heads[html or ""].append(i)
    rows = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        known = [x for x in heads[html or ""] if x is not None]
        head = min(known) if known and len(data) >= min_bytes else i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        rows.append((i, len(data), digest, "response" if head == i else "revisit", None if head == i else head))
    return sorted(map(str, rows))


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("min_bytes", [0, 1, 7])
def test_round_trip(pages, min_bytes):
    assert rows_of(warc.archive(pages, min_bytes)) == told(min_bytes)


def test_groups_beyond_the_broadcast(pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    assert rows_of(warc.archive(pages)) == told()


def test_text_ids(spark):
    pages = spark.createDataFrame([("b/ä <x>", "u", "same"), ("a\n%", "u", "same"), (None, "u", "own")], "page_id string, url string, html string")
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive(pages).collect()}
    assert found == {"b/ä <x>": ("revisit", "a\n%"), "a\n%": ("response", None), None: ("response", None)}


def test_empty_table(spark, pages):
    found = warc.archive(pages.limit(0))
    assert found.collect() == [] and found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_files_are_whole_streams_then_members(spark, pages, tmp_path):
    written = warc.write_archives(warc.decide(pages), f"{tmp_path}/whole", file_bytes=1000)
    names = [r["file"] for r in written.collect()]
    assert len(names) > 3 and sum(r["records"] for r in written.collect()) == len(ROWS)
    for name in names:
        stream = zlib.decompressobj(31)
        stream.decompress((tmp_path / "whole" / name).read_bytes())
        assert stream.eof and not stream.unused_data  # one member
    members = warc.normalise(written, f"{tmp_path}/whole", f"{tmp_path}/members")
    inflated = sorted(gzip.decompress(p.read_bytes()) for p in (tmp_path / "whole").glob("*.warc.gz"))
    assert sorted(gzip.decompress(p.read_bytes()) for p in (tmp_path / "members").glob("*.warc.gz")) == inflated
    for row in members.collect():
        data = (tmp_path / "members" / row["file"]).read_bytes()
        index = [json.loads(x) for x in (tmp_path / "members" / f"{row['file']}.index").read_text().splitlines()]
        assert len(index) == row["records"] and index[0]["type"] == "warcinfo"
        assert [x["offset"] for x in index] == [0, *(x["offset"] + x["length"] for x in index[:-1])]
        assert index[-1]["offset"] + index[-1]["length"] == len(data)
        for x in index:
            record = gzip.decompress(data[x["offset"] : x["offset"] + x["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    back = warc.read_archives(members, f"{tmp_path}/members", payload=True).collect()
    assert sorted(bytes(r["payload"]) for r in back if r["record_type"] == "response") == sorted(
        (html or "").encode() for (i, _, html), t in zip(ROWS, told_types(), strict=True) if t == "response"
    )
    assert {r["url"] for r in back} == {"http://a.example/x", "http://a.example/y%20z%0D%0Aq", "http://a.example/y", None, "u", "http://b.example/", "n", "ü"}


def told_types():
    first = {}
    for i, _, html in ROWS:
        known = [x for x, _, h in ROWS if (h or "") == (html or "") and x is not None]
        first[html or ""] = min(known, default=None)
    return ["response" if first[html or ""] in (i, None) else "revisit" for i, _, html in ROWS]


def test_files_of_failed_tasks_are_not_read(spark, pages, tmp_path):
    written = warc.write_archives(warc.decide(pages), f"{tmp_path}/whole")
    members = warc.normalise(written, f"{tmp_path}/whole", f"{tmp_path}/members")
    for p in list(Path(tmp_path, "members").glob("*")):
        stray = p.name.replace(".warc", "x.warc")
        (p.parent / stray).write_bytes(p.read_bytes().replace(b'"file": "', b'"file": "stray-'))
    assert warc.read_archives(members, f"{tmp_path}/members").count() == len(ROWS)


def record(kind, n, block):
    return f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:x:{n}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("members", [1, 2, 5])
def test_foreign_files(members):
    records = [record("resource", n, bytes([n]) * (n * 700_001)) for n in range(6)]
    parts = [b"".join(records)[k::1] for k in (0,)] if members == 1 else [b"".join(records[k::1][:1]) for k in range(6)]
    if members == 2:  # a boundary of members inside a record
        whole = b"".join(records)
        parts = [whole[:1_000_000], whole[1_000_000:]]
    target = io.BytesIO()
    found = list(warc.split_members(io.BytesIO(b"".join(gzip.compress(p) for p in parts)), target))
    data = target.getvalue()
    assert [gzip.decompress(data[m.offset : m.offset + m.length]) for m in found] == records
    assert [m.fields["warc-record-id"] for m in found] == [f"<urn:x:{n}>" for n in range(6)]


def test_damaged_files():
    whole = record("resource", 1, b"abc" * 1000)
    packed = gzip.compress(whole)
    for broken in (packed[:-20], gzip.compress(whole[:-500]), gzip.compress(b"no archive\r\n\r\n"), gzip.compress(whole.replace(b"Length: 3000", b"Length: 2990"))):
        with pytest.raises((ValueError, KeyError)):
            list(warc.split_members(io.BytesIO(broken), io.BytesIO()))
    assert list(warc.split_members(io.BytesIO(b""), io.BytesIO())) == []
    head, body = warc.record_parts("1", "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None), b""
    good = b"".join(head)
    assert warc.parse_member(gzip.compress(good))["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_member(gzip.compress(good.replace(b"\r\nabc", b"\r\nabd") + body))
