import base64
import gzip
import hashlib
import os
import zlib

import pytest

from urbanloom.llm import warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_arc_versions_round_trip():
    docs = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\nwith lines\n", b"no header", b"", b"HTTP/1.0 broken"]
    data = b"".join(warc.arc_record(1 + i % 2, f"http://x/{i} y", "19990102030405", "text/html", d) for i, d in enumerate(docs))
    got = list(warc.parse_arc(b"\n\r\n" + data + b"\n"))
    assert [(v, d) for v, _, d, _ in got] == [(1 + i % 2, d) for i, d in enumerate(docs)]
    assert got[0][1]["url"] == "http://x/0%20y" and warc.warc_date(got[0][1]["date"]) == "1999-01-02T03:04:05Z" and warc.warc_date("1997") == "1997-01-01T00:00:00Z"
    assert [warc.payload_of(d)[1] for d in docs] == [b"body\nwith lines\n", b"no header", b"", b"HTTP/1.0 broken"]
    for bad in (data[:-60], b"a b c\n", b"u 1.1.1.1 19990101 text/html 99\nshort\n", b"filedesc://x 0.0.0.0 1996 text/plain 8\n9 0 odd\n\n"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


def test_version_blocks_declare_the_fields_and_become_warcinfo():
    for version in (1, 2):
        lines = [f"http://x/ 1.2.3.4 2001 {'text/html; charset=utf-8' if version == 1 else 'text/html 200 abc - 0 f.arc'} 4\nbody\n", "dns:x 1.2.3.4 2002 text/dns " + ("" if version == 1 else "- - - 9 f.arc ") + "3\n1.2\n"]
        data = warc.arc_block(version, "f.arc", "19960101000000", "Some Archive") + "".join(lines).encode()
        got = list(warc.parse_arc(data))
        assert [v for v, *_ in got] == [version] * 3 and [d for _, _, d, _ in got[1:]] == [b"body", b"1.2"]
        made = [warc.convert(f, d, "f.arc", at) for _, f, d, at in got]
        assert [m["kind"] for m in made] == ["warcinfo", "resource", "resource"] and made[1]["mime"].startswith("text/html")
        assert f"x-arc-version: {version}.0\r\nx-arc-origin: Some Archive\r\n".encode() in made[0]["body"]
        (fields, block), = warc.parse_warc(warc.warc_record(made[0], "warcinfo", ""))
        assert fields["WARC-Filename"] == "f.arc" and fields["Content-Type"] == "application/warc-fields" and block == made[0]["body"]
        assert len({m["id"] for m in made}) == 3


def test_warc_records_follow_declared_lengths():
    r = warc.convert({"url": "http://x", "date": "2001", "ip": "1.1.1.1"}, b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n\r\n\r\n\r\nWARC/1.0")
    data = warc.warc_record(r, "response", "5") + warc.warc_record(r, "revisit", "6", {"id": r["id"], "uri": r["uri"], "date": r["date"], "key": "5"})
    got = list(warc.parse_warc(data))
    assert [f["WARC-Type"] for f, _ in got] == ["response", "revisit"] and got[0][1].endswith(b"WARC/1.0")
    assert got[1][0]["X-Refers-To-Key"] == "5" and got[1][1] == r["http"]
    assert (got[1][0]["WARC-Refers-To"], got[1][0]["WARC-Refers-To-Target-URI"], got[1][0]["WARC-Refers-To-Date"]) == (r["id"], "http://x", "2001-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        list(warc.parse_warc(data[:-3]))


def test_records_are_gzip_members(monkeypatch):
    monkeypatch.setattr(warc, "_MEMBER", 1000)
    records = [os.urandom(n) for n in (1, 999, 1001, 2500, 17)]
    packed = b"".join(map(warc.members, records))
    assert packed.endswith(b"\0") and list(warc.records_in(packed)) == records and list(warc.records_in(packed + b"\0\0")) == records
    assert gzip.decompress(packed) == b"".join(records)
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records_in(packed[:-9]))


def test_archives_are_bounded_and_hold_nothing_but_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    df = spark.range(300).selectExpr("id page_id", "concat('http://x/', id) url", "if(id % 3 = 0, 'same', repeat(id, 200)) html").repartition(2)
    out = warc.archive_pages(df, path=f"{tmp_path}/w")
    assert out.count() == 300 and out.where("record_type = 'revisit' and refers_to = 297").count() == 99
    files = list((tmp_path / "w").glob("part-*"))
    whole = [gzip.decompress(f.read_bytes()) for f in files]
    assert len(files) > 5 and max(map(len, whole)) < 22_000
    kinds = [f["WARC-Type"] for w in whole for f, _ in warc.parse_warc(w)]
    assert kinds.count("response") == 201 and kinds.count("revisit") == 99 and kinds.count("warcinfo") >= 3
    ids = [f["WARC-Record-ID"] for w in whole for f, _ in warc.parse_warc(w)]
    named = {f["WARC-Refers-To"] for w in whole for f, _ in warc.parse_warc(w) if f["WARC-Type"] == "revisit"}
    assert len(set(ids)) == len(ids) and len(named) == 1 and named < set(ids)


def test_archive(spark):
    rows = [(1, "u", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, None), (4, "v", ""), (5, "u", "other\r\n\r\nWARC/1.0\r\n"), (None, "w", "<p>é</p>"), (2, "u", "<p>é</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS key")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(df).collect()), key=str)
    a, e, o = "<p>é</p>".encode(), b"", b"other\r\n\r\nWARC/1.0\r\n"
    want = [(1, len(a), digest(a), "revisit", 2), (2, len(a), digest(a), "response", None), (2, len(a), digest(a), "response", None), (3, 0, digest(e), "revisit", 4), (4, 0, digest(e), "response", None), (5, len(o), digest(o), "response", None), (None, len(a), digest(a), "revisit", 2)]
    assert got == sorted(want, key=str)
    small = {r.page_id: r.record_type for r in warc.archive_pages(df.where("page_id in (1, 3, 4)"), least_bytes=1).collect()}
    assert small == {1: "response", 3: "response", 4: "response"}
    assert warc.archive_pages(df.limit(0)).count() == 0
