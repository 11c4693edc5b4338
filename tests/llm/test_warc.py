import base64
import gzip
import hashlib
import io
import zlib

import pytest

from varspark.llm import common as c
from varspark.llm.warc import Members, _gzip, arc_header, arc_version_block, convert, convert_archives, op5_warc, read_arc, read_archives, read_warc, warc_date, write_arcs


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows):
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(-1 if page is None else page, last.get(html or "", -1))
    out = []
    for page, _, html in rows:
        to = last[html or ""]
        response = page == to or to == -1
        out.append((page, len((html or "").encode()), digest(html), "response" if response else "revisit", None if response else to))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, op5_warc(spark, sf).collect()), key=str) == brute(rows)


def write_archives(spark, pages, **options):
    return convert_archives(write_arcs(pages, c.scratch(spark, "t")), c.scratch(spark, "t"), **options)


def test_edge_rows(spark):
    rows = [(1, "http://a/ b", "x"), (2, None, "x"), (2, "http://c", "x"), (3, "ftp://é", None), (4, "", ""), (None, "http://d", "x"), (None, "http://d", "only"), (5, "http://e", "é\r\n\r\nWARC/1.1\r\n" * 9000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    out = read_archives(write_archives(spark, df))
    assert sorted((tuple(r)[:1] + tuple(r)[2:6] for r in out.collect()), key=str) == brute(rows)
    assert read_archives(write_archives(spark, df.where("false"))).count() == 0
    few = read_archives(write_archives(spark, df, min_bytes=2)).where("record_type = 'revisit'")
    assert few.count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\na\nb"
    other = b"1 2 3\n\nhttp://fake 1 2 3 4\n"
    data = arc_version_block("f.arc", version, "20010203040506")
    data += arc_header("http://x/", "1.2.3.4", "20010203040506", "text/html; charset=utf-8", len(block), version, "f.arc") + block + b"\n"
    data += arc_header("dns:x", "1.2.3.4", "200102", "text/dns", len(other), version, "f.arc") + other + b"\n"
    a, b = read_arc(io.BytesIO(data))
    assert (a.url, a.content_type, a.block, a.version) == ("http://x/", "text/html; charset=utf-8", block, version)
    assert a.more.get("Result-code") == ("200" if version == 2 else None)
    packed = io.BufferedReader(Members(io.BytesIO(_gzip(convert(a, "<urn:a>")) + _gzip(convert(b, "<urn:b>")))))
    (f, one), (g, two) = read_warc(packed)
    assert (f["WARC-Type"], f["WARC-Date"], f["WARC-IP-Address"], one) == ("response", "2001-02-03T04:05:06Z", "1.2.3.4", block)
    assert f["WARC-Payload-Digest"] == "sha1:" + digest("a\nb")
    assert (g["WARC-Type"], g["Content-Type"], two) == ("resource", "text/dns", other)
    assert f["WARC-Record-ID"] == "<urn:a>" and convert(a, "<urn:a>") == convert(a, "<urn:a>")


def test_damaged_arc():
    with pytest.raises(ValueError):
        list(read_arc(io.BytesIO(b"http://x 1 2 3 4\nabcd\n")))
    with pytest.raises(ValueError):
        list(read_arc(io.BytesIO(arc_version_block("f", 1, "2001") + b"http://x 1 2 text/html 99\nabcd\n")))
    assert warc_date("2001") == "2001-01-01T00:00:00Z"


def members(path):
    """Each gzip member of a file on its own, by the standard library."""
    data = open(path, "rb").read()
    while data:
        inflate = zlib.decompressobj(31)
        yield inflate.decompress(data) + inflate.flush()
        assert inflate.eof
        data = inflate.unused_data


def test_archives_are_valid_for_other_readers(spark):
    """Files are plain gzip members of one record, lengths and digests hold, and all references resolve."""
    rows = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "http://c", "x"), (None, "http://d", "x"), (4, "ftp://é", "y\r\n\r\nWARC/1.1"), (5, None, "y\r\n\r\nWARC/1.1"), (6, "http://e", None), (7, "http://f", ""), (7, "http://f", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    arcs = write_arcs(df, c.scratch(spark, "t"))
    versions = set()
    for r in arcs.collect():
        head, *own = members(r.file.removeprefix("file:"))
        versions.add(head.split(b"\n")[1][:1])
        assert head.startswith(b"filedesc://") and len(own) == r.records
    assert versions == {b"1", b"2"} or arcs.count() == 1 or len(versions) == 1
    assert arcs.agg({"records": "sum"}).first()[0] == len(rows)
    records = []
    for r in convert_archives(arcs, c.scratch(spark, "t")).collect():
        assert gzip.open(r.file.removeprefix("file:")).read(9) == b"WARC/1.1\r"
        own = list(members(r.file.removeprefix("file:")))
        assert len(own) == r.records + 1
        for data in own:
            version, _, rest = data.partition(b"\r\n")
            head, _, block = rest.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
            assert version == b"WARC/1.1" and block[int(fields["Content-Length"]) :] == b"\r\n\r\n"
            records.append((fields, block[: int(fields["Content-Length"])]))
    assert len({f["WARC-Record-ID"] for f, _ in records}) == len(records)
    known = {f["WARC-Record-ID"]: f for f, _ in records if f["WARC-Type"] == "response"}
    revisits = [(f, b) for f, b in records if f["WARC-Type"] == "revisit"]
    assert len(known) == 4 and len(revisits) == 5
    for f, block in revisits:
        to = known[f["WARC-Refers-To"]]
        assert (to["WARC-Payload-Digest"], to["WARC-Target-URI"], to["WARC-Date"]) == tuple(f[k] for k in ("WARC-Payload-Digest", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date"))
        assert block.endswith(b"\r\n\r\n") and not any(k.startswith("X-") for k in f)
    for f, block in records:
        if f["WARC-Type"] == "response":
            assert f["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block.partition(b"\r\n\r\n")[2]).digest()).decode()
            assert f["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
