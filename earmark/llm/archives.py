"""Legacy ARC archives and their conversion to WARC.

An ARC file starts with a version block that names its fields; every record is a header line of that version and as many
bytes as it declares. The converter writes for each record what WARC asks for: an identifier derived from the content and
the place of the record, the date in ISO form, the type, and digests of block and payload. Of HTTP responses with equal
payloads of at least ``MIN_REVISIT`` bytes the first is kept as a response, the others become revisits of it. Payloads stay
where they are: only digests are shuffled, and each file is converted by one task with the decisions for its records.

Files may be compressed, a gzip member per record. Tasks write them to a shared folder; a manifest says which ones count.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from earmark.llm.store import file_tasks, files_dir, settle, spread_join
from earmark.llm.token_codes import open_shared

FILE_BYTES = 16 << 20
MIN_REVISIT = 100
KEY_HEADER = b"X-Archive-Key"
#: Fields of the header lines of versions 1 and 2 of the format.
ARC_FIELDS = {1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
              2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
                  "Filename", "Archive-length"]}
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- bytes

def plain(raw: bytes, step: int = 1 << 14) -> bytes:
    """Contents of a file, whether or not its records are gzip members. Members are fed in steps, so that what is left over
    behind a member's end is short however long the file is."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out, at, view = [], 0, memoryview(raw)
    while at < len(raw):
        member = zlib.decompressobj(31)
        while not member.eof:
            some = view[at:at + step]
            if not some:
                raise EOFError("a gzip member is cut off")
            out.append(member.decompress(some))
            at += len(some) - len(member.unused_data)
    return b"".join(out)


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 earmark\n{' '.join(ARC_FIELDS[version])}\n".encode()
    middle = ["0.0.0.0", date, "text/plain"] + ([] if version == 1 else ["200", "-", "-", "0", name])
    return " ".join([f"filedesc://{name}", *middle, str(len(body))]).encode() + b"\n" + body


def arc_record(version: int, url: str, ip: str, date: str, mime: str, code: int, body: bytes, offset: int, name: str) -> bytes:
    middle = [ip, date, mime] + ([] if version == 1 else [str(code), hashlib.md5(body).hexdigest(), "-", str(offset), name])
    return " ".join([url, *middle, str(len(body))]).encode() + b"\n" + body


def parse_arc(raw: bytes):
    """``dict`` per record after the version block: the fields of its version, ``offset`` and ``body``.

    Fields are taken from the right, so that a URL may hold spaces. Line breaks between records are skipped. A record
    that is cut off has ``truncated`` set and the bytes that are there; a line that is no header ends the file.
    """
    at, version = 0, None
    while True:
        while raw[at:at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(raw):
            return
        end = raw.find(b"\n", at)
        if end < 0:
            return
        line = raw[at:end].rstrip(b"\r")
        if version is None:
            if not line.startswith(b"filedesc:"):
                raise ValueError("not an ARC file: no version block")
            size = int(line.rsplit(b" ", 1)[1])
            body = raw[end + 1:end + 1 + size]
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            names = ARC_FIELDS[version]
        else:
            values = line.rsplit(b" ", len(names) - 1)
            if len(values) < len(names) or not values[-1].isdigit():
                return
            size = int(values[-1])
            body = raw[end + 1:end + 1 + size]
            yield dict(zip(names, (v.decode("utf-8", "replace") for v in values)), offset=at, body=body,
                       truncated=len(body) < size, version=version)
        at = end + 1 + size


def split_http(body: bytes) -> tuple[bytes, bytes] | None:
    """Header block with its empty line, and payload, of an HTTP response; None for anything else."""
    if not body.startswith(b"HTTP/"):
        return None
    end = body.find(b"\r\n\r\n")
    gap = 4
    if end < 0:
        end, gap = body.find(b"\n\n"), 2
    return (body[:end + gap], body[end + gap:]) if end >= 0 else (body, b"")


def http_header(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)\r?$", head)
    return found[1] if found else None


def iso_date(date: str) -> str:
    """WARC date of a 14-digit date; missing digits are those of the start of the period."""
    digits = (re.sub(r"\D", "", date) + "00000101000000"[len(re.sub(r"\D", "", date)):])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def record_id(*parts) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(str, parts)))}"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(raw: bytes):
    """``(headers, block)`` of every record; header names in lower case."""
    at = 0
    while at < len(raw):
        if not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].split(b"\r\n")[1:]
        headers = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, v in (x.split(b":", 1) for x in lines)}
        size = int(headers["content-length"])
        yield headers, raw[end + 4:end + 4 + size]
        at = end + 8 + size


def clean_url(url: str | None) -> str:
    """A URL for a header line: white space and control characters escaped, ``-`` for none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


class _Files:
    """Writes records to numbered files of bounded size."""

    def __init__(self, folder: str, prefix: str, suffix: str, compress: bool):
        self.folder, self.prefix, self.suffix, self.compress = folder, prefix, suffix + ".gz" * compress, compress
        self.store, self.root = open_shared(folder)
        self.store.create_dir(self.root, recursive=True)
        self.parts, self.size, self.records = [], 0, 0

    def start(self):
        self.name = f"{self.prefix}-{uuid.uuid4().hex}{self.suffix}"
        self.parts, self.size, self.records = [], 0, 0

    def add(self, record: bytes):
        self.parts.append(gzip.compress(record, 4, mtime=0) if self.compress else record)
        self.size += len(record)
        self.records += 1

    def write(self) -> dict:
        with self.store.open_output_stream(f"{self.root}/{self.name}", compression=None) as f:
            f.write(b"".join(self.parts))
        return {"path": f"{self.folder}/{self.name}", "records": self.records}


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64())])


def read_file(path: str) -> bytes:
    store, name = open_shared(path)
    with store.open_input_file(name) as f:
        return plain(f.read())


# ---------------------------------------------------------------- operators

def write_arc(pages: DataFrame, version: int = 1, date: str = "19960101000000", compress: bool = True,
              id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row as an HTTP response; returns the manifest ``path, records``.

    A NULL page is an empty payload, a NULL URL is ``-``, a NULL id writes no key. Rows stay in their tasks.
    """
    folder = files_dir(pages.sparkSession, "arc")

    def run(batches):
        files = _Files(folder, f"part-{TaskContext.get().partitionId():06d}", ".arc", compress)
        begun = False
        for batch in batches:
            for key, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not begun:
                    files.start()
                    files.add(arc_version_block(files.name, version, date) + b"\n")
                    begun = True
                payload = (html or "").encode("utf-8", "surrogatepass")
                mark = b"" if key is None else KEY_HEADER + b": " + str(key).encode() + b"\r\n"
                body = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark
                        + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload)
                files.add(arc_record(version, clean_url(url), "0.0.0.0", date, "text/html", 200, body, files.size, files.name) + b"\n")
                if files.size >= FILE_BYTES:
                    yield pa.RecordBatch.from_pylist([files.write()], schema=_MANIFEST)
                    begun = False
        if begun:
            yield pa.RecordBatch.from_pylist([files.write()], schema=_MANIFEST)

    rows = pages.select(F.col(id_col).cast("bigint"), F.col(url_col), F.col(html_col))
    return settle(rows.mapInArrow(run, "path string, records long"))


def arc_records(manifest: DataFrame) -> DataFrame:
    """What decides over revisits, a row per ARC record: ``path, offset, key, digest, payload_bytes, is_http, id, url, date``."""
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for r in parse_arc(read_file(path)):
                    http = split_http(r["body"])
                    payload = http[1] if http else r["body"]
                    key = http_header(http[0], KEY_HEADER) if http else None
                    digest = hashlib.sha256(payload).hexdigest()
                    rows.append((path, r["offset"], int(key) if key else None, digest, len(payload), http is not None,
                                 record_id(r["URL"], r["Archive-date"], digest, path.rsplit("/", 1)[-1], r["offset"]),
                                 r["URL"], iso_date(r["Archive-date"])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string()]
    names = ["path", "offset", "key", "digest", "payload_bytes", "is_http", "id", "url", "date"]
    return manifest.select("path").repartition(file_tasks(manifest)).mapInArrow(
        run, "path string, offset long, key long, digest string, payload_bytes long, is_http boolean, id string, url string, "
             "date string")


def arc_to_warc(manifest: DataFrame, min_revisit: int = MIN_REVISIT, compress: bool = True) -> DataFrame:
    """Convert ARC files to WARC files of the same records; returns the manifest ``path, records``.

    Among HTTP responses of equal payload that with the smallest key is the response, records without a key after all
    others, ties by file and place. Records that are no HTTP responses become resources; a record that is cut off is
    converted as far as it goes and marked ``WARC-Truncated: length``.
    """
    folder = files_dir(manifest.sparkSession, "warc")
    records = settle(arc_records(manifest))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "path", "offset", "id", "url", "date")
    groups = records.where(F.col("is_http") & (F.col("payload_bytes") >= min_revisit))
    groups = groups.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = settle(groups.where("copies > 1").select("digest", "first"))
    copies = records.where(F.col("is_http") & (F.col("payload_bytes") >= min_revisit)).select("digest", "path", "offset")
    revisits = spread_join(copies, groups, "digest", F.struct("path", "offset")).where(
        F.struct("path", "offset") != F.struct("first.path", "first.offset")).select(
        "path", "offset", F.col("first.id").alias("to_id"), F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date"))
    none = manifest.select("path", *[F.lit(None).cast(t).alias(n) for n, t in (
        ("offset", "bigint"), ("to_id", "string"), ("to_url", "string"), ("to_date", "string"))])

    def convert(table: pa.Table) -> pa.Table:
        path = table.column("path")[0].as_py()
        first = {o: (i, u, d) for o, i, u, d in zip(*(table.column(c).to_pylist() for c in ("offset", "to_id", "to_url", "to_date")))
                 if o is not None}
        source = path.rsplit("/", 1)[-1]
        files = _Files(folder, re.sub(r"\.arc(\.gz)?$", "", source), ".warc", compress)
        files.start()
        for r in parse_arc(read_file(path)):
            if not files.records:
                info = f"software: earmark\r\nformat: WARC File Format 1.1\r\nsource: {source} (ARC {r['version']})\r\n".encode()
                files.add(warc_record([("WARC-Type", "warcinfo"), ("WARC-Date", iso_date(r["Archive-date"])),
                                       ("WARC-Record-ID", f"<{record_id('info', source)}>"), ("WARC-Filename", files.name),
                                       ("Content-Type", "application/warc-fields")], info))
            files.add(converted(r, source, first.get(r["offset"])))
        return pa.Table.from_pylist([files.write()], schema=_MANIFEST)

    # decisions for the records of one file, which has a bounded size; every file takes part, with or without revisits
    rows = settle(revisits.unionByName(none))
    rows = rows.repartition(2 * file_tasks(manifest), "path")       # twice, as hashes deal files unevenly
    return settle(rows.groupBy("path").applyInArrow(convert, "path string, records long"))


def converted(r: dict, source: str, first: tuple | None) -> bytes:
    """The WARC record of an ARC record; a revisit if ``first`` names the record with its payload."""
    http = split_http(r["body"])
    payload = http[1] if http else r["body"]
    digest = hashlib.sha256(payload).hexdigest()
    block = http[0] if http and first else r["body"]
    headers = [("WARC-Type", "revisit" if first else "response" if http else "resource"),
               ("WARC-Record-ID", f"<{record_id(r['URL'], r['Archive-date'], digest, source, r['offset'])}>"),
               ("WARC-Date", iso_date(r["Archive-date"])), ("WARC-Target-URI", r["URL"]),
               ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
               ("Content-Type", "application/http; msgtype=response" if http else r["Content-type"])]
    if r["IP-address"] not in ("0.0.0.0", "-"):
        headers.append(("WARC-IP-Address", r["IP-address"]))
    if r["truncated"]:
        headers.append(("WARC-Truncated", "length"))
    if first:
        headers += [("WARC-Profile", PROFILE.decode()), ("WARC-Refers-To", f"<{first[0]}>"),
                    ("WARC-Refers-To-Target-URI", first[1]), ("WARC-Refers-To-Date", first[2])]
    return warc_record(headers, block)


def read_warc(manifest: DataFrame) -> DataFrame:
    """Records of WARC files but their info records: ``record_id, record_type, uri, date, key, payload_bytes,
    payload_digest, refers_to_id``; digests are made from the payloads that are there, of revisits they are the declared ones."""
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for h, block in parse_warc(read_file(path)):
                    if h["warc-type"] == "warcinfo":
                        continue
                    if hashlib.sha256(block).hexdigest() != h["warc-block-digest"].removeprefix("sha256:"):
                        raise ValueError(f"{path}: block digest of {h['warc-record-id']}")
                    http = split_http(block)
                    payload = http[1] if http else block
                    key = http_header(http[0], KEY_HEADER) if http else None
                    if h["warc-type"] == "revisit":
                        size = int(http_header(http[0], b"Content-Length") or 0)
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                    else:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((h["warc-record-id"].strip("<>"), h["warc-type"], h["warc-target-uri"], h["warc-date"],
                                 int(key) if key else None, size, digest, h.get("warc-refers-to", "").strip("<>") or None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["record_id", "record_type", "uri", "date", "key", "payload_bytes", "payload_digest", "refers_to_id"]
    return manifest.select("path").repartition(file_tasks(manifest)).mapInArrow(
        run, "record_id string, record_type string, uri string, date string, key long, payload_bytes long, "
             "payload_digest string, refers_to_id string")
