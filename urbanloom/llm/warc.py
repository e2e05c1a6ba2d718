"""Legacy archive converter: ARC archives become WARC records, written to archives and read back.

An ARC archive begins with a version block, a record whose address is ``filedesc://`` and the archive's name: its first
line has the version, its second the fields of the header lines to come. Every other record is such a line, then as many
bytes as the line declares. ``convert`` makes of a version block a ``warcinfo`` record and synthesises identifiers,
timestamps, types and digests of the others. WARC archives hold one gzip member a record and about ARCHIVE_BYTES of
records; reader and writer hold one record at a time beside the archive's compressed bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.skew import spread_join
from urbanloom.llm.storage import scratch_path, stored
from urbanloom.session import ship

#: Fixed by the formats: the fields of a header line by version, and how a version block names them.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
ARC_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_BLOCK = "filedesc://"
#: Identifiers are name-based, so a rerun of a lost task writes the same records.
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes of records (before compression) after which an archive ends, and pages of an ARC archive.
ARCHIVE_BYTES, ARC_PAGES = 16 << 20, 100
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: The reserved size of a gzip member's last byte: members of less than 2^24 bytes end in a zero.
_MEMBER = (1 << 24) - 1


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_record(version: int, url: str, date: str, content_type: str, document: bytes, ip: str = "0.0.0.0", result_code: int = 200) -> bytes:
    """One ARC record: header line, network document, newline. Blanks and line ends in the URL are escaped."""
    safe = "".join("%%%02X" % b if b <= 0x20 or b == 0x7F else chr(b) for b in url.encode("utf-8")).encode("latin-1") or b"-"
    values = {"url": safe, "ip": ip, "date": date, "content_type": content_type, "length": len(document), "result_code": result_code, "checksum": hashlib.md5(document).hexdigest(), "location": "-", "offset": 0, "filename": "legacy.arc"}
    line = b" ".join(v if isinstance(v, bytes) else str(v).encode("latin-1") for v in (values[f] for f in ARC_FIELDS[version]))
    return line + b"\n" + document + b"\n"


def arc_block(version: int, name: str, date: str, origin: str = "urbanloom") -> bytes:
    """The version block that an ARC archive begins with."""
    body = f"{version} 0 {origin}\n{ARC_NAMES[version]}\n".encode("latin-1")
    return arc_record(version, _BLOCK + name, date, "text/plain", body)


def parse_arc(data: bytes):
    """(version, fields, document, offset) of each record, version blocks included.

    The version is that of the last version block; before one it follows from the number of fields in the line. A
    content type of version 1 may hold blanks. Blank lines between records are skipped; a line with too few fields, a
    block that declares an unknown version or a document shorter than declared is an error, never a silently dropped
    record.
    """
    at, declared = 0, None
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at byte {at}")
        parts = data[at:end].rstrip(b"\r").split(b" ")
        block = data.startswith(_BLOCK.encode(), at)
        version = None if block else declared
        if version is None:
            version = next((v for v, f in ARC_FIELDS.items() if len(f) == len(parts)), None)
        more = len(parts) - len(ARC_FIELDS[version]) if version else -1
        if more < 0 or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line at byte {at}")
        parts[3 : 4 + more] = [b" ".join(parts[3 : 4 + more])]
        fields = dict(zip(ARC_FIELDS[version], (p.decode("latin-1") for p in parts)))
        size = int(fields["length"])
        document = data[end + 1 : end + 1 + size]
        if len(document) < size:
            raise ValueError(f"record at byte {at} declares {size} bytes, {len(document)} are there")
        if block:
            first = document.split(b"\n", 1)[0].split(b" ")
            declared = int(first[0]) if first[0].isdigit() else None
            if declared not in ARC_FIELDS:
                raise ValueError(f"unknown version in the block at byte {at}")
            version = declared
        yield version, fields, document, at
        at = end + 1 + size


def payload_of(document: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its blank line) and payload of a network document; without a header all is payload."""
    if document.startswith(b"HTTP/"):
        head, mark, body = document.partition(b"\r\n\r\n")
        if mark:
            return head + mark, body
    return b"", document


def warc_date(arc_date: str) -> str:
    """14 digits (fewer are filled up) as a WARC timestamp."""
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(fields: dict, document: bytes, archive: str = "", offset: int = 0) -> dict:
    """The equivalent WARC record's parts; a record at the same place of the same archive always gives the same ones.

    Version blocks give ``warcinfo``, documents with an HTTP header ``response``, others (DNS answers, say) ``resource``.
    """
    date = warc_date(fields["date"])
    made = {"id": f"<urn:uuid:{uuid.uuid5(_SPACE, f'{archive} {offset} ' + fields['url'] + ' ' + date + ' ' + hashlib.sha1(document).hexdigest())}>", "uri": fields["url"], "date": date, "ip": fields["ip"]}
    if fields["url"].startswith(_BLOCK):
        version, minor, origin = (document.split(b"\n", 1)[0].decode("latin-1").split(" ", 2) + ["", ""])[:3]
        lines = ["software: urbanloom", "format: WARC File Format 1.0", f"x-arc-version: {version}.{minor}", f"x-arc-origin: {origin.strip()}"]
        body = "".join(f"{x}\r\n" for x in lines).encode("latin-1")
        kind, head, mime = "warcinfo", b"", "application/warc-fields"
    else:
        head, body = payload_of(document)
        kind, mime = ("response", "application/http; msgtype=response") if head else ("resource", fields["content_type"])
    return made | {"kind": kind, "mime": mime, "http": head, "payload_bytes": len(body), "payload_digest": sha1_base32(body), "body": body}


def warc_record(r: dict, record_type: str, key: str, refers: dict | None = None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header alone and names the record that holds its payload by
    identifier, address and date (``refers``: id, uri, date and the row's key)."""
    block = r["http"] + (b"" if record_type == "revisit" else r["body"])
    lines = ["WARC/1.0", f"WARC-Type: {record_type}", f"WARC-Record-ID: {r['id']}", f"WARC-Date: {r['date']}"]
    if record_type == "warcinfo":
        lines += [f"WARC-Filename: {r['uri'].removeprefix(_BLOCK)}"]
    else:
        lines += [f"WARC-Target-URI: {r['uri']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{r['payload_digest']}"]
        lines += [f"X-Source-Key: {key}", f"X-Payload-Length: {r['payload_bytes']}"]
    if record_type == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {refers['id']}", f"WARC-Refers-To-Target-URI: {refers['uri']}", f"WARC-Refers-To-Date: {refers['date']}", f"X-Refers-To-Key: {refers['key'] or ''}"]
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Type: {r['mime']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes):
    """(header fields, block) of each record, by the declared lengths; a short block is an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in data[at:end].decode("latin-1").split("\r\n")[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} isn't {size} bytes long")
        yield fields, block
        at = end + 8 + size


def members(record: bytes) -> bytes:
    """A record as gzip: one member, or several where the record has _MEMBER bytes or more. The last byte is zero."""
    return b"".join(gzip.compress(record[i : i + _MEMBER], 4, mtime=0) for i in range(0, len(record), _MEMBER))


def records_in(archive) -> object:
    """The uncompressed records of an archive, one at a time; zeros between members are skipped."""
    rest, held = memoryview(archive), b""
    while len(rest):
        if rest[0] == 0:
            rest = rest[1:]
            continue
        member = zlib.decompressobj(31)
        held += member.decompress(rest)
        if not member.eof:
            raise ValueError("an archive ends within a gzip member")
        rest = rest[len(rest) - len(member.unused_data) :]
        if len(held) % _MEMBER or not held:  # a full member goes on in the next one
            yield held
            held = b""
    if held:
        yield held


def legacy_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(name, keys, arc): ARC archives of at most ARC_PAGES pages, versions 1 and 2 in turn, payloads in UTF-8 (null: empty).

    Each begins with its version block; ``keys`` has the key of each record after it. Dates are synthetic (a second for
    each key); the key of a null id is null.
    """
    ship(pages.sparkSession)
    began = datetime(1996, 1, 1, tzinfo=timezone.utc)

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, ARC_PAGES):
                part = batch.slice(a, ARC_PAGES)
                version, made = 1 + made % 2, made + 1
                name = f"legacy-{task:06d}-{made:08d}.arc"
                out = [arc_block(version, name, began.strftime("%Y%m%d%H%M%S"))]
                keys = part.column(0).to_pylist()
                for key, url, html in zip(keys, part.column(1).to_pylist(), part.column(2)):
                    body = html.as_buffer().to_pybytes() if html.is_valid else b""
                    number = int(key) if key is not None and key.lstrip("-").isdigit() else 0
                    date = (began + timedelta(seconds=number % 800_000_000)).strftime("%Y%m%d%H%M%S")
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    out.append(arc_record(version, url or "", date, "text/html", head + body))
                yield pa.record_batch([pa.array([name]), pa.array([keys], pa.list_(pa.string())), pa.array([b"".join(out)], pa.binary())], names=["name", "keys", "arc"])

    rows = pages.select(F.col(id_col).cast("string").alias("key"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").cast("binary").alias("h"))
    return rows.mapInArrow(run, "name string, keys array<string>, arc binary")


#: Bodies travel compressed by this codec, as shuffles would else hold them nearly as they are.
_CODEC = "zstd"
_PARTS = "key string, kind string, id string, uri string, date string, ip string, mime string, http binary, payload_bytes long, payload_digest string, body binary"
_TYPES = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}


def from_arc(archives: DataFrame) -> DataFrame:
    """The parts of the WARC records that stand for the records of ARC archives (name, keys, arc); bodies compressed."""
    ship(archives.sparkSession)
    names = [x.split()[0] for x in _PARTS.split(", ")]

    def run(batches):
        for batch in batches:
            for name, keys, arc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own, rows = iter(keys), []
                for _, fields, document, offset in parse_arc(arc.as_buffer().to_pybytes()):
                    made = convert(fields, document, name, offset)
                    rows.append(made | {"key": None if made["kind"] == "warcinfo" else next(own), "body": pa.compress(made["body"], _CODEC, asbytes=True)})
                yield pa.record_batch([pa.array([r[n] for r in rows], _TYPES[t.split()[1]]) for n, t in zip(names, _PARTS.split(", "))], names=names)

    return archives.mapInArrow(run, _PARTS)


def write_archives(records: DataFrame, path: str) -> None:
    """Writes records (the parts, record_type, refers) as archives under ``path``, by Spark's text writer.

    A row is an archive and a file. A gzip member of less than 2^24 bytes ends in a zero byte (the top of its size), so
    the archive's last zero is left to the writer, as its line separator: the files hold gzip members and nothing else.
    """
    ship(records.sparkSession)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                for r in batch.slice(a, 100).to_pylist():
                    whole = 0 if r["record_type"] == "revisit" else r["payload_bytes"]
                    r["body"] = pa.decompress(r["body"], whole, _CODEC, asbytes=True) if whole else b""
                    record = warc_record(r, r["record_type"], r["key"] or "", r["refers"])
                    held.append(members(record))
                    size += len(record)
                    if size >= ARCHIVE_BYTES:
                        yield pa.record_batch([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
                        held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    binary = records.mapInArrow(run, "value binary")
    binary.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """(key, record_type, payload_bytes, payload_digest, refers_to) of the archives' records but ``warcinfo`` ones.

    Digests of blocks, and of payloads that are there, are taken anew and must equal the headers'.
    """
    ship(spark)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out: list[list] = [[], [], [], [], []]
                for record in records_in(content.as_buffer()):
                    for fields, block in parse_warc(record):
                        if sha1_base32(block) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"damaged block of {fields['WARC-Record-ID']}")
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] != "revisit":
                            body = payload_of(block)[1]
                            if sha1_base32(body) != digest or len(body) != int(fields["X-Payload-Length"]):
                                raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
                        row = (fields["X-Source-Key"], fields["WARC-Type"], int(fields["X-Payload-Length"]), digest, fields.get("X-Refers-To-Key"))
                        for o, v in zip(out, row):
                            o.append(v)
                yield pa.record_batch([pa.array(o, t) for o, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["key", "record_type", "payload_bytes", "payload_digest", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "key string, record_type string, payload_bytes long, payload_digest string, refers_to string")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes a WARC record for each page, converted from its ARC record, and returns what the archives hold.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest id is the response, the
    others revisit it; rows that repeat that id are responses too. Null payloads are empty ones; a null id counts as
    less than all others and is never referred to unless all are null. Payloads are equal if length and SHA-1 are; rows
    of a payload that very many pages share are not brought together. The ARC archives' version blocks become
    ``warcinfo`` records. Result: ``id_col`` (its type kept), payload_bytes, payload_digest, record_type, refers_to. An
    empty table gives no archives and no rows.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    id_type = pages.schema[id_col].dataType.simpleString()
    payload = F.when(F.col("kind") != "warcinfo", F.concat_ws(":", "payload_digest", "payload_bytes"))
    parts = stored(from_arc(legacy_archives(pages, id_col, url_col, html_col)).withColumn("payload", payload), "parts")
    number = F.col("key").cast(id_type)
    same = parts.where("payload is not null").groupBy("payload").agg(F.max(F.struct(number.alias("top"), "id", "uri", "date", "key")).alias("top"), F.count("*").alias("n"))
    same = stored(same, "payloads")
    typed = spread_join(parts, same.select("payload", "top"), "payload", same.select("payload", "n"))
    first = (F.col("payload_bytes") < least_bytes) | number.eqNullSafe(F.col("top.top"))
    kind = F.when(F.col("kind") == "warcinfo", F.col("kind")).when(first, F.col("kind")).otherwise("revisit")
    records = typed.select(*[x.split()[0] for x in _PARTS.split(", ")], kind.alias("record_type"), F.struct("top.id", "top.uri", "top.date", "top.key").alias("refers"))
    write_archives(records, path)
    back = read_archives(spark, path)
    refers = F.when(F.col("refers_to") != "", F.col("refers_to")).cast(id_type)
    return back.select(F.when(F.col("key") != "", F.col("key")).cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))
