"""Legacy ARC archives: write them, parse them, and convert them to WARC.

An ARC file begins with a version block (``filedesc://``) whose first line names the version and
whose second names the fields of all later header lines; each record is one header line and as many
bytes as it declares. Version 1 lines hold URL, IP address, date, type and length; version 2 lines
add result code, checksum, location, offset and file name. The converter reads the fields as the
version block names them (from the right, so that URLs may hold blanks), trusts declared lengths
alone, and synthesises what WARC wants: record ids (name-based UUIDs), dates, types, and block and
payload digests. Of records with equal payloads one is a response and the others revisit it.

Archives lie in shared storage, a gzip file for each archive. A file holds at most ``ARCHIVE_BYTES``
and one record beyond, so that a task holds one archive at a time. Digests and decisions travel
without payloads; the conversion meets the decisions of an archive file by file.

Edge cases: null html is an empty payload, a null URL an empty one; a null page id is written as
none and its record is always a response; equal payloads are revisited down to ``least`` bytes; of
repeated rows with the smallest id one is the response, the others revisit it; an empty table makes
no archive and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.common import new_folder, read, remove_folder, rows, stored

ARCHIVE_BYTES = 8 << 20
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_date(seconds: int) -> str:
    """14 digits, a second apart from 2000 on, for archives whose pages carry no date."""
    import datetime

    return (datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=seconds % 600_000_000)).strftime("%Y%m%d%H%M%S")


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 bidflow\n{FIELDS[version]}\n".encode()
    tail = f"{len(body)}" if version == 1 else f"200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} 0.0.0.0 20000101000000 text/plain {tail}\n".encode() + body


def arc_record(version: int, page_id, url: str | None, payload: bytes, name: str, at: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload
    link = re.sub(r"[\r\n]+", " ", url or "")
    tail = f"{len(block)}" if version == 1 else f"200 {hashlib.md5(payload).hexdigest()} - {at} {name} {len(block)}"
    return f"\n{link} 0.0.0.0 {arc_date(page_id or 0)} text/html {tail}\n".encode() + block


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """pages as gzip ARC archives, of version 1 and 2 in turn; tasks begin with either."""

    def run(batches):
        made, size, version = [], 0, 1 + TaskContext.get().partitionId() % 2
        for page, url, html in rows(batches, "page_id", "url", "html"):
            if not made:
                name = f"{uuid.uuid4().hex}.arc"
                made, size = [version_block(version, name)], 0
            record = arc_record(version, page, url, (html or "").encode("utf-8", "surrogatepass"), name, size)
            made.append(record)
            size += len(record)
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(made)], pa.binary())})
                made, version = [], 3 - version
        if made:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(made)], pa.binary())})

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    write_archives(chosen.mapInArrow(run, "archive binary"), path, "\n")


def write_archives(files: DataFrame, path: str, end: str) -> None:
    """One gzip file for each row of files (archive: binary, to which the last line end is added)."""
    files.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the archive files in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def line_at(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\n", at)
    end = len(data) if end < 0 else end
    return data[at:end].rstrip(b"\r").decode("utf-8", "replace"), end + 1


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed archive; the version block comes first, with its own fields."""
    at, names = 0, FIELDS[1].split()
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        line, start = line_at(data, at)
        if line.startswith("filedesc:"):
            # Its own line has the fields of its version, which its body tells: by their number.
            names = FIELDS[2 if len(line.split(" ")) >= 10 else 1].split()
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line at byte {at}: {line[:200]!r}")
        fields, length = dict(zip(names, parts)), int(parts[-1])
        if start + length > len(data):
            raise ValueError(f"a record at byte {at} declares {length} bytes, {len(data) - start} are left")
        block = data[start : start + length]
        if line.startswith("filedesc:"):
            told = block.decode("utf-8", "replace").split("\n")
            fields["Version"] = told[0].split(" ")[0]
            if len(told) > 1 and told[1].strip():
                names = told[1].strip().split(" ")
        yield fields, block
        at = start + length


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers in lower case, the head with its blank line, and the payload of an HTTP response."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return {}, b"", block
    head = block[: end + 4]
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}, head, block[end + 4 :]


def pages_of(data: bytes) -> Iterator[tuple]:
    """(fields, page_id, head, payload) of the documents of an archive."""
    for fields, block in parse_arc(data):
        if not fields["URL"].startswith("filedesc:"):
            headers, head, payload = http_parts(block)
            page = headers.get("x-page-id") or None
            yield fields, None if page is None else int(page), head, payload


def warc_date(date: str) -> str:
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_id(*names) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join(map(str, names)))}>"


def warc_record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(spark: SparkSession, arc: str, warc: str, least: int = 0) -> None:
    """The archives in folder arc as WARC archives in folder warc; payloads of at least ``least`` bytes are deduplicated."""

    def digests(batches):
        for path, content in rows(batches, "path", "content"):
            found = [(k, page, sha1(p), len(p), f["URL"], f["Archive-date"]) for k, (f, page, _, p) in enumerate(pages_of(gzip.decompress(content)))]
            columns = list(zip(*found)) or [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["path", "at", "page_id", "digest", "size", "url", "date"])

    known = stored(archives(spark, arc).mapInArrow(digests, "path string, at int, page_id long, digest string, size long, url string, date string"), "arc-digests")
    able = known.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    # Stored, so that the join reads both sides by shuffle and Spark can split a hot digest.
    groups = stored(able.groupBy("digest", "size").agg(F.count("*").alias("many"), F.min(F.struct("page_id", "path", "at", "url", "date")).alias("first")).where("many > 1"), "digest-groups")
    again = able.join(groups, ["digest", "size"]).where("path <> first.path or at <> first.at")
    decisions = again.groupBy("path").agg(F.collect_list(F.struct("at", "first.page_id", "first.url", "first.date", "digest")).alias("revisits"))  # as many as an archive has records at most

    def write(batches):
        for path, content, revisits in rows(batches, "path", "content", "revisits"):
            other = {r["at"]: r for r in revisits or []}
            name = path.rsplit("/", 1)[-1]
            info = f"software: bidflow\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
            out = [warc_record("warcinfo", {"WARC-Record-ID": warc_id("info", name), "WARC-Date": warc_date("20000101000000"), "Content-Type": "application/warc-fields", "WARC-Block-Digest": f"sha1:{sha1(info)}"}, info)]
            for k, (f, page, head, payload) in enumerate(pages_of(gzip.decompress(content))):
                digest, r = sha1(payload), other.get(k)
                block = head if r else head + payload
                headers = {"WARC-Record-ID": warc_id(f["URL"], f["Archive-date"], page, digest, name, k), "WARC-Date": warc_date(f["Archive-date"]), "WARC-Target-URI": f["URL"], "WARC-IP-Address": f["IP-address"], "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Type": "application/http; msgtype=response"}
                if r:
                    headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To-Target-URI": r["url"], "WARC-Refers-To-Date": warc_date(r["date"]), "X-Refers-To-Page-Id": str(r["page_id"])}
                out.append(warc_record("revisit" if r else "response", headers, block))
            yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(out)[:-2]], pa.binary())})  # the writer adds the last line end

    files = archives(spark, arc)
    write_archives(files.join(decisions, "path", "left").select("path", "content", "revisits").mapInArrow(write, "archive binary"), warc, "\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"not a WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        start, length = end + 4, int(headers["Content-Length"])
        if data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it declares")
        yield headers, data[start : start + length]
        at = start + length + 4


def read_warc(spark: SparkSession, warc: str, keep_payload: bool = False) -> DataFrame:
    """Responses and revisits of the archives in a folder."""

    def run(batches):
        for (content,) in rows(batches, "content"):
            found = []
            for h, block in parse_warc(gzip.decompress(content)):
                if h["WARC-Type"] in ("response", "revisit"):
                    http, _, payload = http_parts(block)
                    revisit, page, to = h["WARC-Type"] == "revisit", http.get("x-page-id"), h.get("X-Refers-To-Page-Id")
                    size = int(http.get("content-length", 0)) if revisit else len(payload)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and sha1(payload) != digest:
                        raise ValueError(f"{h['WARC-Record-ID']}: the payload differs from its digest")
                    found.append((int(page) if page else None, size, digest, h["WARC-Type"], int(to) if to else None, h["WARC-Record-ID"], h["WARC-Date"], h.get("WARC-Target-URI"), payload if keep_payload else None))
            columns = list(zip(*found)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "record_date", "target_uri", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)][: 8 + keep_payload], names[: 8 + keep_payload])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, record_date string, target_uri string"
    return archives(spark, warc).mapInArrow(run, schema + ", payload binary" * keep_payload)


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(read(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    remove_folder(spark, arc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
