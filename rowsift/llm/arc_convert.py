"""Legacy archives to WARC: parse ARC records, synthesise equivalent WARC records.

An ARC file begins with a version block whose second line names the version
and whose third line names the fields of the record headers: five in version
1 (URL, IP-address, Archive-date, Content-type, Archive-length), ten in
version 2 (result code, checksum, location, offset and file name as well).
A record is such a line, a newline, as many bytes as the declared length says
and a newline; payloads may hold anything, so only the lengths tell where a
record ends.

The WARC records get what ARC lacks: a record id (a name-based UUID over the
archive and the record's number in it, so converting twice gives the same id), the date in ISO form
from the 14 digits, the type, and SHA-256 digests of block and payload. The
version block becomes a ``warcinfo``; a block that begins with an HTTP status
line a ``response``, or a ``revisit`` (which names the response's record id)
for the same payload seen under a smaller page id; any other block, such as the
answer of a name server, a ``resource`` whose payload is the whole block.
Records that cannot be read are set aside with a reason, and reading goes on at
the next line that is a record header.

Archives are files written and read by Spark's own writers and readers, so any
file system Spark knows will do, and a lost task is written again by the
commit protocol. One row is one archive file of about ``ARCHIVE_BYTES``
(a larger single record makes a larger file). ARC files are gzip-compressed as
a whole, WARC files record by record, so each record can be read by its offset.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsift.session import shared_dir

from .common import map_frames, staged, utf8

#: Raw bytes after which the next archive file begins.
ARCHIVE_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: Bytes read or unpacked at a time.
PIECE = 1 << 18
V1_FIELDS = b"URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = (b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
             b"Filename Archive-length")
_PAGE = b"X-Page-Id: "
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


# ---- writing ARC

def _url_field(url) -> bytes:
    """A URL without blanks or control characters (percent-encoded); ``-`` when null or empty."""
    raw = url.encode("utf-8", "surrogatepass") if isinstance(url, str) else b""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], raw) or b"-"


def _version_block(version: int, name: bytes, date: bytes) -> bytes:
    body = b"%d 0 rowsift\n" % version + (V1_FIELDS if version == 1 else V2_FIELDS) + b"\n"
    if version == 1:
        head = b"filedesc://%s 0.0.0.0 %s text/plain %d\n" % (name, date, len(body))
    else:
        head = b"filedesc://%s 0.0.0.0 %s text/plain 200 - - 0 %s %d\n" % (name, date, name, len(body))
    return head + body


def arc_record(version: int, url, page_id, payload: bytes, date: bytes, offset: int, name: bytes) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page_id is not None:
        block += _PAGE + b"%d\r\n" % page_id
    block += b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    head = _url_field(url) + b" 0.0.0.0 " + date + b" text/html "
    if version == 2:
        head += b"200 - - %d %s " % (offset, name)
    return head + b"%d\n" % len(block) + block


def write_arc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html",
              date: str = "20200101000000", archive_bytes: int = ARCHIVE_BYTES, version: int | None = None) -> None:
    """Write ``pages`` as ARC files; ``version`` None alternates 1 and 2 by task.

    Records are made where the rows are read, nothing is shuffled.
    """
    when = date.encode()
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.col(f"`{html}`").cast("string").alias("html"))

    def run(frames):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        kind = version or 1 + part % 2
        name, records, size = b"", [], 0
        for pdf in frames:
            for pid, link, payload in zip(pdf["page_id"], pdf["url"], utf8(pdf["html"])):
                if not records:
                    name = b"part-%05d-%05d.arc" % (part, made)
                    records = [_version_block(kind, name, when)]
                    size = len(records[0]) + 1
                record = arc_record(kind, link, None if pd.isna(pid) else int(pid), payload, when, size, name)
                records.append(record)
                size += len(record) + 1
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [b"\n".join(records)]})
                    records, made = [], made + 1
        if records:
            yield pd.DataFrame({"archive": [b"\n".join(records)]})

    _write(map_frames(rows, run, "archive binary"), path, "\n")


def _write(archives: DataFrame, path: str, end: str, compression: str = "gzip") -> None:
    """One file per row: the text writer puts ``end``, a record's closing, behind the row's bytes."""
    (archives.select(F.col("archive").cast("string").alias("value")).write
     .option("lineSep", end).option("maxRecordsPerFile", 1).option("compression", compression).text(path))


def gzip_member(record: bytes) -> bytes:
    """One record as a gzip member of its own, without a time, so that equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


# ---- reading

def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of the archive files below ``path``."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                           T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    return (spark.read.schema(schema).format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .where("length > 0").select("path", "content"))


class _Bytes:
    """Sequential reader over a file's bytes, gunzipped piece by piece."""

    def __init__(self, content: bytes):
        self._raw, self._at, self._have, self._feed = memoryview(content), 0, bytearray(), b""
        self._zip = zlib.decompressobj(31) if bytes(content[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        """Take in some more bytes, at most ``PIECE`` of them; False at the end."""
        while True:
            if self._zip is None:
                piece = self._raw[self._at:self._at + PIECE]
                self._at += len(piece)
                self._have += piece
                return len(piece) > 0
            if not self._feed and self._at < len(self._raw):
                self._feed = bytes(self._raw[self._at:self._at + PIECE])
                self._at += len(self._feed)
            if self._zip.eof:  # the next member, behind any padding
                self._feed = self._feed.lstrip(b"\0")
                if self._feed:
                    self._zip = zlib.decompressobj(31)
                elif self._at >= len(self._raw):
                    return False
                else:
                    continue
            piece = self._zip.decompress(self._feed, PIECE)
            self._feed = self._zip.unused_data if self._zip.eof else self._zip.unconsumed_tail
            if piece:
                self._have += piece
                return True
            if not self._zip.eof and not self._feed and self._at >= len(self._raw):
                return False  # the file ends inside a member

    def line(self) -> bytes | None:
        """Up to the next newline, which is consumed; None at the end."""
        start = 0
        while (cut := self._have.find(b"\n", start)) < 0:
            start = len(self._have)
            if not self._more():
                if not self._have:
                    return None
                cut = len(self._have)
                break
        out = bytes(self._have[:cut])
        del self._have[:cut + 1]
        return out

    def take(self, n: int) -> bytes:
        while len(self._have) < n and self._more():
            pass
        if len(self._have) < n:
            raise ValueError(f"archive ends {n - len(self._have)} bytes early")
        out = bytes(self._have[:n])
        del self._have[:n]
        return out

    def rest(self) -> bytes:
        """All that is left."""
        while self._more():
            pass
        out = bytes(self._have)
        self._have.clear()
        return out


def _header(line: bytes, fields: list[str]) -> tuple[list[bytes], int] | str:
    """The values and the declared length of a record header, or why it is none."""
    values = line.split(b" ")
    if len(values) != len(fields):
        return f"record header of {len(values)} fields, {len(fields)} declared"
    if not re.fullmatch(rb"[0-9]{1,18}", values[-1]):
        return f"record length {values[-1][:40].decode('utf-8', 'replace')!r}"
    return values, int(values[-1])


def arc_records(content: bytes, strict: bool = True) -> Iterator[dict]:
    """Header fields and block of each record of one ARC file, the version block first.

    ``version_block`` marks the first record, whatever the URLs of the others.
    What is no record raises, or, not ``strict``, comes out with the reason as
    ``fault`` and its bytes as ``block``: up to the next line that is a record
    header, the rest of a file that is cut short, a whole file whose version
    block cannot be read.
    """
    data = _Bytes(content)
    first = data.line()
    if first is None:
        return
    try:
        values = first.split(b" ")
        block = data.take(int(values[-1]))
        version, names = block.split(b"\n")[:2]
        if version.split(b" ")[0] not in (b"1", b"2"):
            raise ValueError(f"ARC version {version!r}")
        fields = names.decode().split(" ")
        head = {"URL": values[0].decode("utf-8", "surrogateescape"), "Archive-date": values[2].decode()}
    except (ValueError, IndexError) as err:
        if strict:
            raise ValueError(str(err)) from err
        yield {"fault": f"no version block: {err}", "block": first + b"\n" + data.rest(), "version_block": False}
        return
    yield head | {"block": block, "fields": len(fields), "version_block": True}
    bad, why = [], ""
    while (line := data.line()) is not None:
        if not line.strip() and not bad:
            continue  # the newline behind a record
        got = _header(line, fields)
        if isinstance(got, str):
            if strict:
                raise ValueError(got)
            why = why or got
            bad.append(line)
            continue
        if bad:
            yield {"fault": why, "block": b"\n".join(bad), "version_block": False}
            bad, why = [], ""
        values, size = got
        try:
            block = data.take(size)
        except ValueError as err:
            if strict:
                raise
            yield {"fault": str(err), "block": line + b"\n" + data.rest(), "version_block": False}
            return
        yield dict(zip(fields, (v.decode("utf-8", "surrogatepass") if _utf8(v) else v.decode("latin-1") for v in values))) | {
            "block": block, "fields": len(fields), "version_block": False}
    if bad:
        yield {"fault": why, "block": b"\n".join(bad), "version_block": False}


def _utf8(value: bytes) -> bool:
    try:
        value.decode("utf-8", "surrogatepass")
        return True
    except UnicodeDecodeError:
        return False


def _is_http(block: bytes) -> bool:
    return block[:5].upper() == b"HTTP/"


def _split_block(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload of a block (the head ends at the first empty line,
    written either way); a block without HTTP head is all payload."""
    if not _is_http(block):
        return b"", block
    full, bare = block.find(b"\r\n\r\n"), block.find(b"\n\n")
    if bare >= 0 and (full < 0 or bare < full):
        return block[:bare], block[bare + 2:]
    return (block, b"") if full < 0 else (block[:full], block[full + 4:])


def _page_of(head: bytes) -> int | None:
    for line in head.split(b"\r\n"):
        if line.startswith(_PAGE):
            return int(line[len(_PAGE):])
    return None


def _iso(date: str) -> str:
    """``YYYYMMDDhhmmss`` (missing digits: the earliest) as ``YYYY-MM-DDThh:mm:ssZ``."""
    d = (date + "00000101000000"[len(date):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def _record_id(archive: str, nth: int) -> str:
    """The same for the same record of the same ARC file, whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{archive}#{nth}')}>"


# ---- writing and reading WARC

def warc_record(kind: str, record_id: str, url: str, date: str, block: bytes, *, digest: str = "",
                refers_to: int | None = None, refers_to_id: str = "", content_type: str = "") -> bytes:
    """One record without its closing blank lines."""
    payload = _split_block(block)[1] if kind != "resource" else block
    body = block[:len(block) - len(payload)] if kind == "revisit" else block
    what = {"warcinfo": "application/warc-fields", "resource": content_type or "application/octet-stream"}.get(
        kind, "application/http; msgtype=response")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}",
             f"WARC-Date: {_iso(date)}", f"Content-Type: {what}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}"]
    if kind != "warcinfo":
        lines += [f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {refers_to_id}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body


def convert(spark: SparkSession, arc_path: str, warc_path: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Convert the ARC files of one folder to WARC files in another.

    Returns what was set aside: ``path, reason, size, head`` (the first bytes) per faulty stretch.

    Two passes over the archives: the first takes the digests and finds the
    first page of each payload (grouped sums over digests, pre-summed in each
    task), the second writes. The second pass gets each archive's revisits, a
    list bounded by the archive's size, by a join on the archive's path: Spark
    broadcasts that table below its limit, else the compressed archives move once.
    """
    arc = read_archives(spark, arc_path)

    def listed(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows, nth, archive = [], 0, ""
                for r in arc_records(content, strict=False):
                    if "fault" in r:
                        rows.append((path, None, None, len(r["block"]), r["block"][:80].decode("utf-8", "replace"), None, r["fault"]))
                    elif r["version_block"]:
                        archive = r["URL"]
                    else:
                        head, payload = _split_block(r["block"])
                        rows.append((path, nth, _page_of(head), len(payload), hashlib.sha256(payload).hexdigest(),
                                     _record_id(archive, nth) if _is_http(r["block"]) else None, None))
                        nth += 1
                if not rows:
                    continue
                made = list(zip(*rows))
                yield pd.DataFrame({
                    "path": list(made[0]), "nth": pd.array(list(made[1]), dtype="Int64"), "page_id": pd.array(list(made[2]), dtype="Int64"),
                    "size": pd.array(list(made[3]), dtype="Int64"), "digest": list(made[4]), "record_id": list(made[5]), "fault": list(made[6])})

    digests = staged(map_frames(arc, listed, "path string, nth long, page_id long, size long, digest string, record_id string, "
                                             "fault string"), "digests")
    big = digests.where((F.col("size") >= REVISIT_BYTES) & F.col("record_id").isNotNull())
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id")))
    groups = (big.groupBy("size", "digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("size", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("to_id")))
    # an archive has a bounded number of records, so its list of revisits is bounded too
    again = (big.join(groups, ["size", "digest"]).where(F.coalesce(F.col("page_id") != F.col("refers_to"), F.col("refers_to").isNotNull()))
             .groupBy("path").agg(F.collect_list(F.struct("nth", "refers_to", "to_id")).alias("again")))
    again = staged(again, "revisits")
    rows = arc.join(again, "path", "left").select("content", "again")

    def run(frames):
        for pdf in frames:
            for content, known in zip(pdf["content"], pdf["again"]):
                archive = ""
                refers = {} if known is None else {r["nth"]: (r["refers_to"], r["to_id"]) for r in known}
                records, size, nth = [], 0, 0
                for r in arc_records(content, strict=False):
                    if "fault" in r:
                        continue
                    if r["version_block"]:
                        body = (f"software: rowsift\r\nformat: WARC File Format 1.1\r\n"
                                f"converted-from: {r['URL']}\r\narc-fields: {r['fields']}\r\n").encode()
                        archive = r["URL"]
                        record = warc_record("warcinfo", _record_id(archive, -1), archive, r["Archive-date"], body)
                    else:
                        digest = hashlib.sha256(_split_block(r["block"])[1]).hexdigest()
                        to, to_id = refers.get(nth, (None, ""))
                        kind = "revisit" if to is not None else "response" if _is_http(r["block"]) else "resource"
                        record = warc_record(kind, _record_id(archive, nth), r["URL"], r["Archive-date"], r["block"], digest=digest,
                                             refers_to=to, refers_to_id=to_id, content_type=r["Content-type"])
                        nth += 1
                    records.append(gzip_member(record + b"\r\n\r\n"))
                    size += len(record)
                    if size >= archive_bytes:
                        yield pd.DataFrame({"archive": [b"".join(records)]})
                        records, size = [], 0
                if records:
                    yield pd.DataFrame({"archive": [b"".join(records)]})

    # zero bytes behind the last member are padding to every gzip reader
    _write(map_frames(rows, run, "archive binary"), warc_path, "\0", "none")
    return digests.where("fault is not null").select("path", F.col("fault").alias("reason"), "size", F.col("digest").alias("head"))


def warc_records(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower-case names) and block of each record of one WARC file."""
    data = _Bytes(content)
    while (line := data.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = {}
        while (line := data.line()) and line.strip():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, data.take(int(head["content-length"]))


def read_warc(warc: DataFrame) -> DataFrame:
    """One row per response, resource or revisit record: ``page_id, record_id, date, url,
    payload_bytes, payload_digest, record_type, refers_to, refers_to_id``.

    Digest and length of a payload are taken from the bytes read back and must
    agree with its headers; a revisit has none and states them.
    """
    names = ["page_id", "record_id", "date", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_id"]

    def run(frames):
        for pdf in frames:
            for content in pdf["content"]:
                rows = []
                for head, block in warc_records(content):
                    kind = head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, payload = (b"", block) if kind == "resource" else _split_block(block)
                    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"])
                    if kind != "revisit" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {head['warc-record-id']} differs from its headers")
                    to = head.get("x-refers-to-page")
                    rows.append((_page_of(http), head["warc-record-id"], head["warc-date"], head["warc-target-uri"], size,
                                 digest, kind, None if to is None else int(to), head.get("warc-refers-to")))
                if rows:
                    yield pd.DataFrame({n: pd.array(list(c), dtype="Int64") if n in ("page_id", "refers_to") else list(c)
                                        for n, c in zip(names, zip(*rows))})

    return map_frames(warc, run, "page_id long, record_id string, date string, url string, payload_bytes long, "
                                 "payload_digest string, record_type string, refers_to long, refers_to_id string")


def archive_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html",
                  archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as ARC, convert to WARC, and read the WARC files back (see ``read_warc``).

    Of records with equal payloads of at least ``REVISIT_BYTES`` bytes those
    with the smallest page id are responses (several if rows repeat), the
    others revisit it; a null page id revisits any other, and is a response
    where all ids are null. A null html is an empty payload, a null or empty
    url is stated as ``-``; an html of any length is one record; further
    columns are not read; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    arc, warc = shared_dir(spark, "llm", "arc"), shared_dir(spark, "llm", "warc")
    write_arc(pages, arc, page_id=page_id, url=url, html=html, archive_bytes=archive_bytes)
    convert(spark, arc, warc, archive_bytes=archive_bytes)
    return read_warc(read_archives(spark, warc))
