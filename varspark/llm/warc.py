"""Legacy archives to WARC: ARC version 1 and 2 records are parsed by their header lines and declared
lengths, and equivalent WARC records are synthesised (identifiers, timestamps, types, digests).

An ARC file (gzip members, a record each) becomes a WARC file of the same kind. A first pass over the ARC files finds the records with equal
payloads; each file is then told what its revisits refer to, and converted in a second pass, so that payloads are never
shuffled. Tasks write files into the shared folder under names that a repeated task uses again.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

# The URL record definitions of the two ARC versions, as version blocks give them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("8f6a1f0e-6d5c-4f7e-9d0a-3f1f3f0c2b7d")  # of identifiers made here


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- ARC


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    version: int
    more: dict = field(default_factory=dict)


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 varspark\n{ARC_FIELDS[version]}\n".encode()
    return arc_header(f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), version, name) + body + b"\n"


def arc_header(url: str, ip: str, date: str, content_type: str, length: int, version: int, name: str, offset: int = 0, code: int = 200) -> bytes:
    middle = f" {code} - - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {content_type}{middle} {length}\n".encode()


def read_arc(stream) -> Iterator[ArcRecord]:
    """Records after the version block, which says how header lines read. Lengths decide where a record ends."""
    version = None
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        length = int(parts[-1])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"an ARC record of {length} bytes ends after {len(block)}")
        if version is None:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("an ARC file starts with a filedesc record")
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            continue
        names = ARC_FIELDS[version].split(" ")
        # a content type may hold spaces: fields are counted from both ends
        tail = len(names) - 4
        own = [*parts[:3], " ".join(parts[3 : len(parts) - tail]), *parts[len(parts) - tail :]]
        if len(own) != len(names):
            raise ValueError(f"an ARC header line with {len(parts)} fields")
        yield ArcRecord(*own[:4], block, version, dict(zip(names[4:], own[4:], strict=True)))


# ---------------------------------------------------------------- WARC


def warc_date(date: str) -> str:
    """YYYY[MM[DD[hh[mm[ss]]]]] of an ARC header as an ISO timestamp; what is missing is the earliest there is."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(map(str, parts)))}>"


def http_split(block: bytes) -> tuple[bytes, bytes]:
    head, mark, body = block.partition(b"\r\n\r\n")
    return head + mark, body


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def arc_parts(arc: ArcRecord) -> tuple[bytes, bytes]:
    """HTTP header and payload of a record; other records are payload as a whole."""
    if arc.url.startswith(("http:", "https:")) and arc.block.startswith(b"HTTP/"):
        return http_split(arc.block)
    return b"", arc.block


def convert(arc: ArcRecord, identifier: str, refers_to: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record that stands for an ARC record. refers_to: identifier, URL and WARC date of the record with the same payload."""
    head, payload = arc_parts(arc)
    is_http = bool(head)
    digest = f"sha1:{sha1_base32(payload)}"
    block = head if refers_to and is_http else b"" if refers_to else arc.block
    headers = [
        ("WARC-Record-ID", identifier), ("WARC-Date", warc_date(arc.date)), ("WARC-Target-URI", arc.url),
        *([("WARC-IP-Address", arc.ip)] if arc.ip not in ("-", "0.0.0.0") else []),
        ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response" if is_http else arc.content_type),
    ]
    if refers_to:
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", refers_to[0]), ("WARC-Refers-To-Target-URI", refers_to[1]), ("WARC-Refers-To-Date", refers_to[2])]
    return warc_record("revisit" if refers_to else "response" if is_http else "resource", headers, block)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and blocks of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            fields[k.strip()] = v.strip()
        block = stream.read(int(fields["Content-Length"]))
        yield fields, block


class Members(io.RawIOBase):
    """A stream of gzip members, read as one."""

    def __init__(self, raw):
        self.raw, self.left, self.inflate = raw, b"", None

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            if not self.left:
                self.left = self.raw.read(1 << 16)
                if not self.left:
                    return 0
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            got = self.inflate.decompress(self.left, len(out))
            if self.inflate.eof:
                self.left, self.inflate = self.inflate.unused_data, None
            else:
                self.left = self.inflate.unconsumed_tail
            if got:
                out[: len(got)] = got
                return len(got)


# ---------------------------------------------------------------- operator

ARC_BYTES = 64 << 20  # payload bytes after which a task begins another archive


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Archive:
    """An archive being written, a gzip member for each record; it appears under its name when it is whole."""

    def __init__(self, uri: str):
        self.uri, self.fs, self.at = uri, *c.filesystem(uri)
        self.part = f"{self.at}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.records = self.bytes = 0

    def add(self, record: bytes) -> None:
        self.out.write(_gzip(record))
        self.records += 1
        self.bytes += len(record)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.at)


def _members(uri: str):
    fs, at = c.filesystem(uri)
    return io.BufferedReader(Members(fs.open_input_stream(at, compression=None)), 1 << 18)


def _page_block(page_id, payload: bytes) -> bytes:
    who = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{who}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _page_url(url: str | None) -> str:
    safe = quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")
    return safe if safe.startswith(("http:", "https:")) else f"http://invalid/{safe}"


def _write_arcs(path: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = c.filesystem(path)
        fs.create_dir(root, recursive=True)
        out, version, made = None, 0, 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if out is None:
                    version = 2 - made % 2
                    made += 1
                    name = f"pages-{uuid.uuid4().hex}.arc.gz"
                    out = _Archive(f"{path}/{name}")
                    out.add(arc_version_block(name, version, date))
                block = _page_block(page_id, (html or "").encode())
                out.add(arc_header(_page_url(url), "-", date, "text/html", len(block), version, name, out.bytes) + block + b"\n")
                if out.bytes > ARC_BYTES:
                    out.close()
                    yield c.table(file=[out.uri], records=[out.records - 1])
                    out = None
        if out is not None:
            out.close()
            yield c.table(file=[out.uri], records=[out.records - 1])

    return run


def write_arcs(pages: DataFrame, path: str, date: str = "20240101000000") -> DataFrame:
    """Legacy archives of both versions with a record for each page (page_id, url, html) under path; returns file, records.

    A null html is an empty payload, a null url stands under http://invalid/, a null page_id has no X-Page-Id.
    """
    c.columnwise(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return c.keep(rows.mapInArrow(_write_arcs(path, date), "file string, records long"), "op5-arcs")


INDEX = "place int, digest string, size long, page_id long, id string, url string, date string"


def _page_of(head: bytes) -> int | None:
    for line in head.split(b"\r\n"):
        if line.lower().startswith(b"x-page-id:"):
            return int(line.split(b":", 1)[1])
    return None


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the records of each ARC file are: their place, payload digest and size, page_id, WARC identifier, URL and date."""
    for batch in batches:
        for uri, file in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            rows = []
            for i, arc in enumerate(read_arc(_members(uri))):
                head, payload = arc_parts(arc)
                digest = sha1_base32(payload)
                rows.append((i, digest, len(payload), _page_of(head), record_id(uri.rpartition("/")[2], i, arc.url, arc.date, digest), arc.url, warc_date(arc.date)))
            if rows:
                kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield c.table(**{k: pa.array(x, t) for k, x, t in zip(("place", "digest", "size", "page_id", "id", "url", "date"), zip(*rows, strict=True), kinds, strict=True)}, _file=np.full(len(rows), file))


def _convert(told: str, path: str, min_bytes: int):
    """The WARC file of each ARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = c.filesystem(path)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for uri, file in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                got = c.delivered(told, file, ["digest", "size", "page_id", "id", "url", "date"], "_file")
                last = {} if got is None else {(r["digest"], r["size"]): r for r in got.to_pylist()}
                arc_name = uri.rpartition("/")[2]
                name = arc_name.removesuffix(".gz").removesuffix(".arc") + ".warc.gz"
                out = _Archive(f"{path}/{name}")
                for i, arc in enumerate(read_arc(_members(uri))):
                    if not i:
                        out.add(warc_record("warcinfo", [("WARC-Record-ID", record_id(name)), ("WARC-Date", warc_date(arc.date)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], f"software: varspark\r\nformat: WARC File Format 1.1\r\ndescription: converted from {arc_name}\r\n".encode()))
                    head, payload = arc_parts(arc)
                    digest, page = sha1_base32(payload), _page_of(head)
                    one, to = last.get((digest, len(payload))), None
                    if one is not None and len(payload) >= min_bytes and one["page_id"] is not None and page != one["page_id"]:
                        to = one["id"], one["url"], one["date"]
                    out.add(convert(arc, record_id(arc_name, i, arc.url, arc.date, digest), to))
                out.close()
                yield c.table(file=[out.uri], records=[max(0, out.records - 1)])

    return run


def _spread(files: DataFrame, column: str = "file") -> DataFrame:
    """A task for a few files each, dealt evenly."""
    return files.repartition(max(1, min(100_000, files.count()))).select(column, *(x for x in files.columns if x != column))


def convert_archives(arcs: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Convert the listed ARC files (column file) to WARC files under path; returns file, records.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest page_id is a response and others revisit it; a
    page_id that stands twice with that payload is a response twice, of which others name the first by file and place. Records
    without a page_id revisit others but are never revisited. Equal payloads are known by SHA-1 and length. A payload that a third
    of all pages share is one row for each file.
    """
    files = c.keep(arcs.select("file").distinct().withColumn("_file", F.xxhash64("file")), "op5-list")
    index = c.keep(_spread(files).mapInArrow(_index, f"{INDEX}, _file long"), "op5-index")
    first = F.struct("page_id", (-F.col("_file").cast("decimal(20)")).alias("f"), (-F.col("place")).alias("p"))
    last = index.groupBy("digest", "size").agg(F.max_by(F.struct("page_id", "id", "url", "date"), first).alias("one"))
    asked = index.select("_file", "digest", "size").distinct()
    told = c.deliver(asked.join(last, ["digest", "size"]).select("digest", "size", "one.*", "_file"), "op5-told", files, "_file")
    return c.keep(_spread(files).mapInArrow(_convert(told, path, min_bytes), "file string, records long"), "op5-warcs")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to_id", "record_id", "date"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = []
            for f, block in read_warc(_members(uri)):
                if f["WARC-Type"] == "warcinfo":
                    continue
                head, payload = http_split(block) if f["Content-Type"].startswith("application/http") else (b"", block)
                http = dict(x.lower().split(": ", 1) for x in head.decode("utf-8", "surrogateescape").split("\r\n") if ": " in x)
                digest = f["WARC-Payload-Digest"].partition(":")[2]
                if f["WARC-Type"] != "revisit" and sha1_base32(payload) != digest:
                    raise ValueError(f"{uri}: {f['WARC-Record-ID']} doesn't have its digest")
                size = len(payload) if f["WARC-Type"] != "revisit" else int(http["content-length"]) if "content-length" in http else None
                rows.append((uri, _page_of(head), f["WARC-Target-URI"], size, digest, f["WARC-Type"], f.get("WARC-Refers-To"), f["WARC-Record-ID"], f["WARC-Date"]))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(files: DataFrame) -> DataFrame:
    """The records of the listed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, date.

    refers_to is the page_id of the response whose WARC-Record-ID a revisit names, null where the archives don't have it. A response that a
    third of all records revisit is one row for each file in the joins.
    """
    schema = "file string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to_id string, record_id string, date string"
    records = c.keep(_spread(files.select("file")).mapInArrow(_read, schema), "op5-records")
    others = records.where("record_type <> 'revisit'")
    revisits = records.where("record_type = 'revisit'")
    asked = revisits.select("file", "refers_to_id").distinct()
    named = asked.join(others.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")), "refers_to_id")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date"]
    return others.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(revisits.join(named, ["file", "refers_to_id"], "left").select(columns))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    arcs = write_arcs(spark.read.parquet(f"{sf_dir}/pages.parquet"), c.scratch(spark, "op5-arc"))
    files = convert_archives(arcs, c.scratch(spark, "op5-warc"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
