"""Secret scans that confirm the structure of a candidate before they report it.

Base kinds are plain patterns: ``assign`` (a value assigned to a name such as ``api_key``),
``access`` (access key ids) and ``hex`` (long hexadecimal runs). The method's own kinds are
reported only when their content decodes and parses to the last byte:

* ``jwt``: three dotted base64url parts, of which the first decodes to a JSON object with ``alg``, the second to a JSON object, and
  the third, the signature, to a byte at least (a token that is signed by nothing is no secret);
* ``der``: base64 or hex that decodes to an ASN.1 SEQUENCE of nested elements whose declared
  lengths fill it exactly, and whose outer elements are those of a private key: a version, then
  integers, an octet string, or an algorithm and an octet string; or an algorithm and an octet
  string alone (an encrypted key);
* ``ssh``: base64 or hex that decodes to an ``openssh-key-v1`` private key;
* ``public``: the same encodings of what is no secret (certificates, public keys, other ASN.1 with
  an INTEGER or OBJECT IDENTIFIER; length-prefixed fields of which the first names a key type).

Base64 may use the alphabet for URLs, and may be wrapped: what stands between BEGIN and END marks is joined (line breaks may be escaped),
and so are runs of lines of one width with the shorter one that ends them. It may begin within a run of its own letters (a path's
last part), where what begins there declares the length of all that follows. Hex may follow ``0x``. The span is that of the base64 or hex.
Texts of any length are scanned whole, in time that grows with their length.

Spans are in code points of the whole text, end exclusive. Edge cases: a null text is empty and
has no span; a null id stays null; repeated rows are reported each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.common import read, rows

# Fixed values of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "der", "jwt", "public", "ssh")

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
BASE64 = re.compile(r"[A-Za-z0-9+/]{32,}={0,2}")
URL_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M|AAAA|b3Bl)[A-Za-z0-9_-]{30,}={0,2}(?![A-Za-z0-9+/_=-])")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:[A-Za-z0-9+/=\s]|\\[rn])++)-----END \1-----")
BREAKS = re.compile(r"\s|\\[rn]")
LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/]+={0,2})")
ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?([0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")
#: What base64 of keys begins with: a SEQUENCE, a length of less than 256, the format's name.
INNER = re.compile(r"M[A-P]|AAAA|b3BlbnNzaC1rZXktdjEA")
#: Key types that a length-prefixed encoding may begin with.
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-ed25519", b"sk-ecdsa-sha2-")

OPENSSH = b"openssh-key-v1\0"


def der_elements(data: bytes, start: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags of the elements that fill data[start:end] exactly, nested ones included; None if they don't."""
    tags = []
    while start < end:
        if start + 2 > end or depth > 16:
            return None
        tag, size, start = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            size = int.from_bytes(data[start : start + n], "big")
            start += n
            if size < 0x80:  # must be the short form
                return None
        if start + size > end:
            return None
        tags.append(tag)
        if tag & 0x20:
            inner = der_elements(data, start, start + size, depth + 1)
            if inner is None:
                return None
            tags += inner
        start += size
    return tags


def openssh(data: bytes) -> bool:
    """Whether data is cipher, key derivation and its options, a number of public keys and the private part, to the last byte."""
    at, left, counted = len(OPENSSH), 3, False
    while left:
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        left -= 1
        if not left and not counted:
            n = int.from_bytes(data[at : at + 4], "big")
            at, left, counted = at + 4, n + 1, True
            if not 1 <= n <= 64:
                return False
    return at == len(data)


def outer_tags(data: bytes) -> list[int]:
    """Tags of the elements in the outermost one of well-formed DER."""

    def content(at: int) -> tuple[int, int]:
        size, at = data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        return at, at + size

    at, end = content(0)
    tags = []
    while at < end:
        tags.append(data[at])
        at = content(at)[1]
    return tags


def private(tags: list[int]) -> bool:
    """Whether the outer elements are those of a private key, encrypted or not."""
    versioned = tags[:1] == [0x02] and (tags[1:2] == [0x04] or tags[1:3] == [0x30, 0x04] or len(tags) > 4 and set(tags[:5]) == {0x02})
    return versioned or tags == [0x30, 0x04]


def key_kind(data: bytes) -> str | None:
    if data.startswith(OPENSSH):
        return "ssh" if openssh(data) else None
    if len(data) >= 16 and data[0] == 0x30:
        tags = der_elements(data, 0, len(data))
        if tags and len(tags) > 2 and {0x02, 0x06} & {*tags}:
            return "der" if private(outer_tags(data)) else "public"
    if data[:3] == b"\0\0\0":
        at, fields = 0, []
        while at + 4 <= len(data):
            n = int.from_bytes(data[at : at + 4], "big")
            fields.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        if at == len(data) and len(fields) > 1 and fields[0].startswith(SSH_TYPES):
            return "public"
    return None


def decoded(text: str, urlsafe: bool = False) -> bytes | None:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def wrapped(text: str, first: re.Match) -> list[tuple[int, str]]:
    """(end, base64) of the lines as wide as the first that follow it, with and without a shorter one after them."""
    width, at, parts, ends = len(first[0]), first.end(), [first[0]], [first.end()]
    while (m := LINE.match(text, at)) and len(m[1]) <= width:
        parts.append(m[1])
        at = m.end()
        ends.append(at)
        if len(m[1]) < width:
            break
    return [(ends[n - 1], "".join(parts[:n])) for n in (len(parts), len(parts) - 1) if n > 1]


def begins_key(text: str, start: int, end: int) -> bool:
    """Whether base64 in text[start:end] (without padding) begins like a key; a SEQUENCE has to declare the length of all of it."""
    head = decoded(text[start : start + 16])
    if not head or head[0] != 0x30:
        return bool(head) and (head.startswith(OPENSSH[:8]) or head[:3] == b"\0\0\0" and head[3] < 64)
    size, header = head[1], 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4:
            return False
        size, header = int.from_bytes(head[2 : 2 + n], "big"), 2 + n
    return header + size == (end - start) * 3 // 4


def inner_key(run: str) -> tuple[str, int] | None:
    """Kind and start of a key that begins within a run of base64 and ends with it."""
    end = len(run.rstrip("="))
    for m in INNER.finditer(run, 1):
        if end - m.start() >= 32 and begins_key(run, m.start(), end) and (data := decoded(run[m.start() :])) and (kind := key_kind(data)):
            return kind, m.start()
    return None


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """The method's own spans."""
    found = []
    if "eyJ" in text:
        for m in TOKEN.finditer(text):
            head, body, signed = (decoded(m[i], True) for i in (1, 2, 3))
            try:
                if head and body and signed and isinstance(h := json.loads(head), dict) and "alg" in h and isinstance(json.loads(body), dict):
                    found.append(("jwt", *m.span()))
            except ValueError:
                pass
    reach = tried = 0
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = decoded(BREAKS.sub("", m[2]))
            if data and (kind := key_kind(data)):
                # Breaks, escaped ones too, are no part of the span.
                start = m.start(2) + re.match(r"(?:\s|\\[rn])*", m[2]).end()
                found.append((kind, start, start + len(re.sub(r"(?:\s|\\[rn])+\Z", "", text[start : m.end(2)]))))
    marks = [x[1:] for x in found if x[0] != "jwt"]
    for m in BASE64.finditer(text):
        while marks and marks[0][1] <= m.start():
            marks.pop(0)
        if m.start() < reach or marks and marks[0][0] <= m.start():
            continue
        # A SEQUENCE begins with 0x30, a length-prefixed name with three zero bytes, a private key with its format's name.
        if m[0][0] == "M" or m[0].startswith(("AAAA", "b3Bl")):
            for end, joined in [(m.end(), m[0])] if m.start() < tried else [(m.end(), m[0]), *wrapped(text, m)]:
                tried = max(tried, end)
                data = decoded(joined)
                if data and (kind := key_kind(data)):
                    found.append((kind, m.start(), end))
                    reach = end
                    break
        if reach < m.end() and (within := inner_key(m[0])):
            found.append((within[0], m.start() + within[1], m.end()))
            reach = m.end()
    if "-" in text or "_" in text:
        for m in URL_BASE64.finditer(text):
            if ("-" in m[0] or "_" in m[0]) and (data := decoded(m[0].rstrip("="), True)) and (kind := key_kind(data)):
                found.append((kind, *m.span()))
    for m in ANY_HEX.finditer(text):
        if len(m[1]) % 2 == 0 and m[1].lower().startswith(("30", "000000", "6f70656e")) and (kind := key_kind(bytes.fromhex(m[1]))):
            found.append((kind, *m.span(1)))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end, base), by start, then kind."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for (text,) in rows([batch], "text"):
                found = [(*x, True) for x in base_spans(text)] + [(*x, False) for x in confirmed(text)] if text else []
                found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                out.append([dict(zip(("kind", "start", "end", "base"), x)) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    told = lambda public: F.filter("spans", lambda x: (x["kind"] == "public") == F.lit(public))  # noqa: E731  # what is public is no secret
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return spans.select("doc_id", *(number(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(told(False)).alias("spans"), joined(told(True)).alias("public_spans"))
