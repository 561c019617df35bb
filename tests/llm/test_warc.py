import io
import json
import zlib

import pytest

from cardlens.llm import warc
from cardlens.llm.common import fresh_path

from .util import rows_of, save, with_clashes

ODD = [(1, "http://a/", "same"), (2, "http://b/x y", "same"), (2, "http://b/x y", "same"), (3, None, None), (4, "http://c/\r\nX: y", ""), (None, "http://d/", "same"), (None, None, "alone"), (5, "http://e/", "é" * 70_000 + "\r\n\r\nWARC/1.1\r\n"), (1, "http://a/", "same")]


def expected(rows, least=0):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            key = html or ""
            first[key] = min(page_id, first.get(key, page_id))
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        refers = first.get(html or "")
        if refers == page_id or refers is None or len(payload) < least:
            refers = None
        out.append((page_id, len(payload), warc.base32_sha1(payload), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def pages(spark):
    return spark.createDataFrame(ODD, "page_id long, url string, html string")


def round_trip(spark, df, least=0):
    root = fresh_path(spark, "warc")
    names = warc.write_archives(df, f"{root}/raw", least)
    return warc.read_archives(warc.normalise_archives(names, f"{root}/raw", f"{root}/members"), f"{root}/members")


def test_pages_come_back(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert rows_of(warc.op8_warc(spark, sf_dir)) == expected(rows)


def test_defined_cases(spark, tmp_path):
    assert rows_of(warc.op8_warc(spark, save(with_clashes(pages(spark)), tmp_path, "pages"))) == expected(ODD)
    assert rows_of(round_trip(spark, pages(spark), 1)) == expected(ODD, 1)
    assert round_trip(spark, pages(spark).limit(0)).count() == 0


def test_several_archives_by_task(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 10)
    assert rows_of(round_trip(spark, pages(spark).coalesce(1))) == expected(ODD)


def test_each_record_is_a_member_at_its_indexed_place():
    data = [warc.record(i, f"http://x/{i}", b"payload %d " % i * 5000, None) for i in range(20)]
    for source in (warc._member(b"".join(data)), b"".join(map(warc._member, data))):
        archive, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise(io.BytesIO(source), archive, index) == 20
        entries = [json.loads(x) for x in index.getvalue().splitlines()]
        for d, e in zip(data, entries, strict=True):
            assert zlib.decompress(archive.getvalue()[e["offset"] : e["offset"] + e["length"]], 31) == d
            fields, block = warc.read_record(archive, e["offset"], e["length"])
            assert fields["warc-record-id"] == e["id"]
            assert block.endswith(b"payload %s " % e["id"][10:-1].encode())


def test_cut_archives_are_refused():
    data = warc.record(1, "http://x/", b"abc" * 100, None)
    for cut in (30, len(data) - 20):
        with pytest.raises(ValueError):
            list(warc.records(iter([data[:cut]])))


def normalised(source):
    archive, index = io.BytesIO(), io.BytesIO()
    warc.normalise(io.BytesIO(source), archive, index)
    return [warc.read_record(archive, e["offset"], e["length"]) for e in map(json.loads, index.getvalue().splitlines())]


def test_foreign_headers():
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    data = b"WARC/1.0\r\nwarc-type:response\r\nWARC-Record-ID:<urn:x:1>\r\nWARC-Target-URI: http://x/\r\n  y\r\nCONTENT-LENGTH :%d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    ((fields, found),) = normalised(warc._member(data) + b"\0" * 8)
    assert found == block and fields["warc-type"] == "response" and fields["warc-target-uri"] == "http://x/ y"
    for wrong in (data.replace(b"WARC/1.0", b"HTTP/1.0"), data.replace(b"CONTENT-LENGTH", b"LENGTH"), data.replace(b":response", b"")):
        with pytest.raises(ValueError):
            normalised(warc._member(wrong))


def test_cut_and_damaged_streams_are_refused():
    records = [warc.record(i, "http://x/", b"abc%d" % i * 100, None) for i in range(3)]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    flushed = b"".join(deflate.compress(r) + deflate.flush(zlib.Z_FULL_FLUSH) for r in records)  # ends where a record does, its member doesn't
    whole = warc._member(b"".join(records))
    assert len(normalised(whole)) == len(normalised(whole + whole)) // 2 == 3
    damaged = bytearray(whole)
    damaged[-6] ^= 1  # in the checksum
    for source in (flushed, *[whole[:-n] for n in (1, 4, 8, 9, 20)], whole + whole[:15], whole + b"more", bytes(damaged)):
        with pytest.raises(ValueError):
            normalised(source)
    assert normalised(b"") == []
