"""ARC archives to WARC archives, and WARC archives to rows.

``arc_records`` reads ARC files of version 1 and 2 by the header lines that their version block declares and by the
lengths that each line declares. ``warc_record`` makes the equivalent WARC/1.1 record: identifier (from the place in
the source archive that version 2 names, else from a hash of the file, the place in it, the header line and the block), date, type, block and
payload digests (SHA-1 in base 32). A record whose payload another one has already is written as a revisit of it.

``write_arc`` lays pages down as ARC files with their true offsets, under names that no other archive has; ``convert`` reads ARC files once, finds
equal payloads and writes WARC files (``.warc.gz``, a gzip member for each record); ``read`` reads these. Files go through Spark's writer and
reader, so that any store Spark knows will do, and end with the record that brings them to their size. Any of the files may be compressed
by gzip, whole or record by record. ``write`` does all for a table of pages. A page's id travels in a header of its own, ``X-Page-Id``.

Dates are kept as far as they are known: a part out of its range, and what is behind it, is left out; years of two digits are
those from 1970 to 2069; a record whose year isn't known has its archive's date, or 1970.

Cases: a null payload is empty; a url that is null or empty is ``-``, white space and controls in it are percent-encoded;
pages without an id are responses, never targets; equal payloads below ``least`` bytes are responses each; of rows
repeated under the target's id each is a response; white space in an id is encoded as in a url; an empty table writes an
empty archive and gives no rows; columns of the pages beside those named are left out, whatever their names.
"""

from __future__ import annotations

import base64
import calendar
import hashlib
import re
import uuid
import warnings
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm.common import delete, forget, lookup, materialise, shared_dir, slices, texts_as_bytes, written

LEAST = 1000
#: About so many payload bytes go into one WARC file, and into one ARC file, which a task holds whole.
FILE_BYTES, ARC_BYTES = 16 << 20, 8 << 20

#: A gzip member's last four bytes are its size, so that of one shorter than 16 MB ends in a zero, which stands for a line's end.
_MEMBER = 1 << 23
_END = b"\0"

_PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}

# The field lines of the two ARC versions
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
_PAGE_ID = re.compile(rb"(?im)^X-Page-Id: *([^\r\n]*)")
_GZIP, _CHUNK = b"\x1f\x8b", 1 << 16
_ADDRESS = re.compile(r"-|[0-9.]{7,15}|[0-9a-fA-F]*:[0-9a-fA-F:.]+")
_DATE = re.compile(r"[0-9]{4,17}")


def inflated(data: bytes) -> bytes:
    """A file's bytes, of all its members if it is compressed; after a damaged member the next whole one is looked for."""
    if not data.startswith(_GZIP):
        return data
    view, out, at = memoryview(data), [], 0
    while at >= 0:
        member, to, whole = zlib.decompressobj(31), at, True
        try:
            while to < len(data) and not member.eof:
                out.append(member.decompress(view[to : to + _CHUNK]))
                to += min(_CHUNK, len(data) - to)
            whole = member.eof
        except zlib.error:
            whole = False
        if not whole:
            warnings.warn(f"a damaged gzip member at byte {at}", stacklevel=2)
        at = data.find(_GZIP, to - len(member.unused_data) if whole else at + 2)
    return b"".join(out)


def _encoded(value: object) -> bytes:
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], str(value).encode()) or b"-"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 folioweave\n{ARC_FIELDS[version]}\n".encode()
    rest = f"filedesc://{name} 0.0.0.0 {date} text/plain".encode()
    return rest + (b" " if version == 1 else b" 200 - - 0 " + name.encode() + b" ") + str(len(body)).encode() + b"\n" + body + b"\n"


def arc_record(version: int, block: bytes, url: str | None, date: str, kind: str = "text/html", ip: str = "0.0.0.0", code: int = 200, offset: object = "-", name: str = "-") -> bytes:
    middle = b"" if version == 1 else f" {code} - - ".encode() + _encoded(offset) + b" " + _encoded(name)
    return _encoded(url or "") + f" {ip} {date} {kind}".encode() + middle + f" {len(block)}\n".encode() + block + b"\n"


def arc_fields(line: str, names: list[str], sure: bool = False) -> dict[str, str] | None:
    """The fields of a header line, None if it isn't one; ``sure``: only if it has an address and a date in their places.

    Spaces beyond those between fields belong to the URL or to the content type, as many to the URL as leave an address
    and a date in their places.
    """
    values = line.split(" ")
    more = len(values) - len(names)
    if more < 0 or not (values[-1].isascii() and values[-1].isdigit()):
        return None
    kind = names.index("Content-type") if "Content-type" in names[1:] else 0
    for k in range(more, -1 if kind else more - 1, -1):
        end = kind + more
        parts = [" ".join(values[: k + 1]), *values[k + 1 : k + kind], " ".join(values[k + kind : end + 1]), *values[end + 1 :]] if kind else [" ".join(values[: k + 1]), *values[k + 1 :]]
        fields = dict(zip(names, parts, strict=True))
        if _ADDRESS.fullmatch(fields.get("IP-address", "")) and _DATE.fullmatch(fields.get("Archive-date", "")):
            return fields
    return None if sure or more else fields


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an ARC file; only the first can be its version block, whose fields have ``version``."""
    for _, fields, block in arc_places(data):
        yield fields, block


def arc_places(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``arc_records`` with the place where each begins.

    After a damaged line or a block that is cut short, the next whole record is looked for, and a warning says so.
    """
    at, names, opening, lost = 0, ARC_FIELDS[1].split(), True, None
    while at < len(data):
        end = data.find(b"\n", at)
        end = end if end >= 0 else len(data)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:
            at = end + 1
            continue
        version = opening and line.startswith("filedesc://")
        if version:
            names = ARC_FIELDS[2 if line.count(" ") + 1 >= len(ARC_FIELDS[2].split()) else 1].split()
        opening = False
        fields = arc_fields(line, names, lost is not None)
        size = int(fields[names[-1]]) if fields else 0
        if not fields or end + 1 + size > len(data):
            lost = at if lost is None else lost
            at = end + 1
            continue
        if lost is not None:
            warnings.warn(f"no whole ARC record from byte {lost} to {at}", stacklevel=2)
            lost = None
        block = data[end + 1 : end + 1 + size]
        if version:
            declared = block.split(b"\n")
            fields["version"] = declared[0].split(b" ")[0].decode("ascii", "replace")
            names = declared[1].decode("ascii", "replace").split() if len(declared) > 1 and declared[1].strip() else names
        yield at, fields, block
        at = end + 1 + size
    if lost is not None:
        warnings.warn(f"no whole ARC record from byte {lost} to {len(data)}", stacklevel=2)


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(fields: dict[str, str], block: bytes, place: str = "") -> str:
    """The identifier; ``place`` says where the record lies, if its fields don't."""
    if fields.get("Offset", "-") not in ("-", "") and fields.get("Filename", "-") not in ("-", ""):
        return f"<urn:arc:{fields['Filename']}:{fields['Offset']}>"
    seed = " ".join([place, *fields.values()]) + hashlib.sha1(block).hexdigest()
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>"


def _known(digits: str) -> list[int]:
    """Year, month, day, hour, minute and second, as far as they are in their ranges."""
    found: list[int] = []
    for at, size in ((0, 4), (4, 2), (6, 2), (8, 2), (10, 2), (12, 2)):
        part = digits[at : at + size]
        k = len(found)
        most = calendar.monthrange(found[0], found[1])[1] if k == 2 else (2100, 12, 0, 23, 59, 59)[k]
        if len(part) < size or not (1970, 1, 1, 0, 0, 0)[k] <= int(part) <= most:
            break
        found.append(int(part))
    return found[:3] if len(found) == 4 else found  # an hour says nothing without its minute


def warc_date(date: str, other: str = "19700101000000") -> str:
    """An archive's date as WARC has it, with as many parts as are known; ``other`` if not even the year is."""
    digits = date if date.isascii() and date.isdigit() else ""
    found = _known(digits)
    if len(digits) in (6, 8, 10, 12):  # years of two digits
        short = _known(("19" if digits[:2] >= "70" else "20") + digits)
        found = short if len(short) > len(found) else found
    if not found:
        return warc_date(other)
    text = "-".join(f"{x:0{4 if k == 0 else 2}d}" for k, x in enumerate(found[:3]))
    return text + (("T" + ":".join(f"{x:02d}" for x in found[3:])) + "Z" if len(found) > 3 else "")


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and payload; no head where the block doesn't start with a status line."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(block.find(x), len(x)) for x in (b"\r\n\r\n", b"\n\n") if x in block]
    at = min((a + n for a, n in ends), default=len(block))
    return block[:at], block[at:]


def warc_record(fields: dict[str, str], block: bytes, refers_to: str | None = None, refers_to_page: str | None = None, name: str | None = None, date: str = "") -> bytes:
    """The WARC record for an ARC record; ``refers_to`` is the identifier of the response with the same payload, if any, and ``refers_to_page`` its page's id.

    ``name`` is its own identifier, made of fields and block if there is none; ``date`` the archive's.
    """
    head, payload = payload_of(block)
    named = [("WARC-Record-ID", name or record_id(fields, block)), ("WARC-Date", warc_date(fields["Archive-date"], date))]
    if "version" in fields:
        text = b"software: folioweave\r\nformat: WARC/1.1\r\noriginal-arc-version: " + fields["version"].encode() + b"\r\n"
        named = [("WARC-Type", "warcinfo"), *named, ("WARC-Filename", fields["URL"][11:]), ("Content-Type", "application/warc-fields")]
        block = text
    else:
        kind = "revisit" if refers_to else "response" if head else "resource"
        named = [("WARC-Type", kind), ("WARC-Target-URI", fields["URL"]), *named]
        if fields["IP-address"] not in ("0.0.0.0", "-"):
            named.append(("WARC-IP-Address", fields["IP-address"]))
        named.append(("WARC-Payload-Digest", sha1_32(payload)))
        if refers_to:
            named += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to)]
            named += [] if refers_to_page is None else [("X-Refers-To-Page-Id", _encoded(refers_to_page).decode())]
            block = head or f"Content-Length: {len(payload)}\r\n\r\n".encode()
        named.append(("WARC-Block-Digest", sha1_32(block)))
        named.append(("Content-Type", "application/http; msgtype=response" if head else fields["Content-type"]))
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*named, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def convert_arc(data: bytes, refers_to: dict[int, str] | None = None, file: str = "") -> Iterator[bytes]:
    """WARC records of an ARC file; ``refers_to`` has the identifiers that some records (by their number, from 0) revisit."""
    opened = ""
    for k, (at, fields, block) in enumerate(arc_places(data), -1):
        opened = fields["Archive-date"] if "version" in fields else opened
        yield warc_record(fields, block, (refers_to or {}).get(k), None, record_id(fields, block, f"{file}:{at}"), opened)


def member(record: bytes) -> bytes:
    """A record as a gzip member, or as several if it is long, of which the last byte is zero."""
    parts = [record[a : a + _MEMBER] for a in range(0, len(record), _MEMBER)] or [b""]
    return b"".join(_deflated(p) for p in parts)


def _deflated(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def warc_parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file; what isn't a whole record is skipped, and a warning says so."""
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        headers = _headers(data[at:end]) if end >= 0 else {}
        size = headers.get("content-length", "")
        if not (size.isascii() and size.isdigit()) or end + 4 + int(size) > len(data) or "warc-type" not in headers:
            warnings.warn(f"no whole WARC record at byte {at}", stacklevel=2)
            at = data.find(b"WARC/", at + 5)
            continue
        yield headers, data[end + 4 : end + 4 + int(size)]
        at = data.find(b"WARC/", end + 4 + int(size))


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", version: int = 2, date: str = "20240101000000") -> None:
    """Lays each page down as a record of compressed ARC files in ``path``."""
    archive = uuid.uuid4().hex[:16]
    found = pages.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"))

    def run(batches):
        partition = TaskContext.get().partitionId()
        for n, batch in enumerate(slices(batches, "payload", ARC_BYTES)):
            name = f"pages-{archive}-{partition:06d}-{n:06d}.arc"
            parts = [arc_version_block(version, name, date)]
            at = len(parts[0])
            for page, u, body in zip(batch.column("key").to_pylist(), batch.column("url").to_pylist(), texts_as_bytes(batch.column("payload")), strict=True):
                own = b"" if page is None else b"X-Page-Id: " + _encoded(page) + b"\r\n"
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + own + f"Content-Length: {len(body)}\r\n\r\n".encode()
                parts.append(arc_record(version, head + body, u, date, offset=at, name=name))
                at += len(parts[-1])
            # the writer ends each row with a line feed, the last byte of a record
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["file"])

    # a row is a file
    found.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).options(**_PACKED).text(path)


_ARC = "fields map<string,string>, id string, page string, digest string, size long, opened string, block binary"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ARC files in ``path``: their fields, identifier, page's id, the payload's SHA-1 and size, the archive's own date, and the block."""

    def run(batches):
        names = ["fields", "id", "page", "digest", "size", "opened", "block"]
        kinds = [pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, opened = [], ""
                for at, fields, block in arc_places(inflated(content.as_py())):
                    opened = fields["Archive-date"] if "version" in fields else opened
                    head, payload = payload_of(block)
                    page = _PAGE_ID.search(head)
                    name = record_id(fields, block, f"{file.rsplit('/', 1)[-1]}:{at}")
                    rows.append((list(fields.items()), name, unquote(page[1].decode()) if page else None, hashlib.sha1(payload).hexdigest(), len(payload), opened, block))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _ARC)


def convert(spark: SparkSession, arc_path: str, path: str, least: int = LEAST, order: str = "long") -> int:
    """Converts the ARC files in ``arc_path`` to WARC files in ``path``; the number of records other than version blocks.

    Of records with one payload of at least ``least`` bytes, those of the page with the largest id (as an ``order``) stay
    responses, and the others are revisits of one of them. Archives are parsed once, into a table that is deleted at the end.
    """
    since = written()
    version = F.map_contains_key("fields", F.lit("version"))
    records = materialise(read_arc(spark, arc_path).withColumn("at", F.when(~version, F.col("page").cast(order))).withColumn("version", version))
    n = records.where(~F.col("version")).count()
    asked = ~F.col("version") & (F.col("size") >= least) & F.col("at").isNotNull()
    groups = records.where(asked).groupBy("digest").agg(F.max(F.struct("at", "id", "page")).alias("target"), F.count(F.lit(1)).alias("_times"))
    groups = materialise(groups.where(F.col("_times") > 1))
    found = lookup(records.select("fields", "id", "at", "opened", "block", F.when(asked, F.col("digest")).alias("digest")), groups, "digest", "_times")
    other = F.col("target.at") != F.col("at")
    found = found.select("fields", "id", "opened", "block", F.when(other, F.col("target.id")).alias("to"), F.when(other, F.col("target.page")).alias("to_page"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for fields, name, opened, block, to, page in zip(*(batch.column(c).to_pylist() for c in ("fields", "id", "opened", "block", "to", "to_page")), strict=True):
                held.append(member(warc_record(dict(fields), block, to, page, name, opened)))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield _file(held)
                    held, size = [], 0
        if held:
            yield _file(held)

    # a row is a file, and the end of a line its last byte
    found.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", _END.decode()).text(path)
    forget(spark, since)
    _renamed(spark, path)
    return n


def _file(members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], names=["file"])


def _renamed(spark: SparkSession, path: str) -> None:
    """Gives Spark's text files the name of what they are."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().endswith(".txt")]
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda f: fs.rename(f, f.suffix("").getParent().suffix("/" + f.getName().removesuffix(".txt") + ".warc.gz")), files))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, version: int = 2, date: str = "20240101000000") -> None:
    """Lays the pages down as a legacy archive in ``path``-arc, converts it to WARC files in ``path`` and deletes it."""
    spark = pages.sparkSession
    write_arc(pages, f"{path}-arc", key, url, payload, version, date)
    n, wanted = convert(spark, f"{path}-arc", path, least, dict(pages.dtypes)[key]), pages.count()
    if n != wanted:
        raise ValueError(f"{wanted} pages gave {n} ARC records")
    delete(spark, [f"{path}-arc"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page record of the WARC files in ``path``: record_id, page_id, url, date, record_type, refers_to_id, refers_to_page, payload_bytes, payload_digest (hex) and payload (null for a revisit)."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for headers, block in warc_parsed(inflated(content.as_py())):
                    kind = headers["warc-type"]
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    head, payload = payload_of(block) if kind != "revisit" else (block, None)
                    declared, page = re.search(rb"(?i)content-length: *(\d+)", head), _PAGE_ID.search(head)
                    digest = base64.b32decode(headers["warc-payload-digest"][5:]).hex()
                    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{headers['warc-record-id']}: the payload doesn't have the digest that its header declares")
                    size = len(payload) if payload is not None else int(declared[1]) if declared else None
                    of, to = (unquote(x) if x is not None else None for x in (page[1].decode() if page else None, headers.get("x-refers-to-page-id")))
                    rows.append((headers["warc-record-id"], of, headers.get("warc-target-uri"), headers["warc-date"], kind, headers.get("warc-refers-to"), to, size, digest, payload))
                columns = list(zip(*rows, strict=True)) or [()] * 10
                kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["record_id", "page_id", "url", "date", "record_type", "refers_to_id", "refers_to_page", "payload_bytes", "payload_digest", "payload"]
    schema = "record_id string, page_id string, url string, date string, record_type string, refers_to_id string, refers_to_page string, payload_bytes long, payload_digest string, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/folioweave-warc-{uuid.uuid4().hex}"
