"""Where keys and tokens may stand, and what is no secret; line dedup beside columns of any name."""

import base64
import json
import random

from bidflow.llm import line_dedup, secret_scan
from tests.llm.data import frame, prose


def element(tag, content):
    n = len(content)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])) + content


def key(n):
    """A private key: version, algorithm, n bytes of key."""
    return element(0x30, element(2, b"\0") + element(0x30, element(6, b"\x2a\x86\x48\xce\x3d\x02\x01")) + element(4, bytes(range(1, n + 1))))


CERTIFICATE = element(0x30, element(0x30, element(2, b"\1") + element(6, b"\x2a\x86\x48") + element(4, bytes(40))) + element(3, b"\0abc"))
B64 = lambda data: base64.b64encode(data).decode()
URL = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")


def kinds(text):
    return [(k, text[a:b]) for k, a, b in secret_scan.confirmed(text)]


def test_hex_behind_a_prefix():
    for n in (20, 60, 140):
        for digits in (key(n).hex(), key(n).hex().upper()):
            for lead in ("", "0x", "0X", "key=0x", "\\x "):
                assert kinds(f"{lead}{digits} end") == [("der", digits)]
            assert kinds(f"z{digits}") == kinds(f"{digits}g") == kinds(f"10x{digits}") == kinds(digits[:-2]) == []


def test_base64_within_a_run():
    for n in (20, 61, 140, 222):
        text = B64(key(n))
        for lead in ("", "path/", "keyA", "etc/MII/", "ssl/private/AAAA/", "x+"):
            assert kinds(f"in {lead}{text} end") == [("der", text)], lead
        assert kinds(f"path/{text.rstrip('=')}AAAA") == []  # more follows than the key declares
    blob = base64.b64encode(bytes(random.Random(1).randrange(256) for _ in range(200_000))).decode()
    assert kinds(blob) == []


def test_tokens_need_claims_and_a_signature():
    head, none, body = URL({"alg": "HS256"}), URL({"alg": "none"}), URL({"sub": "1"})
    assert kinds(f"{head}.{body}.c2ln") == [("jwt", f"{head}.{body}.c2ln")]
    for text in (f"{none}.{body}.", f"{head}.{body}.", f"{head}.{URL([1])}.c2ln", f"{head}.aGVsbG8.c2ln", f"{URL({'typ': 'x'})}.{body}.c2ln"):
        assert kinds(text) == []


def test_public_material_is_told_apart(spark, tmp_path):
    texts = [f"a {B64(key(40))} b", f"a {B64(CERTIFICATE)} b", f"{B64(CERTIFICATE)} token=abcdefgh", None, ""]
    frame(spark, list(enumerate(texts)), extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in secret_scan.op3_secret_scan(spark, str(tmp_path)).collect()}
    assert rows[0]["spans"].startswith("der:2:") and rows[0]["public_spans"] == ""
    assert rows[1]["spans"] == "" and rows[1]["public_spans"].startswith("public:2:")
    assert rows[2]["spans"].startswith("assign:") and rows[2]["public_spans"].startswith("public:0:")
    assert rows[3]["spans"] == rows[4]["spans"] == rows[3]["public_spans"] == ""


def test_lines_beside_any_columns(spark):
    rng = random.Random(2)
    rows = [(i, f"{prose(rng, 30)}\nshared footer of page {i}\n{prose(rng, 20)}") for i in range(15)]
    table = frame(spark, rows).selectExpr("*", "1 as __did", "2 as __th", "3 as __lines", "4 as did", "5 as th")
    kept = line_dedup.drop_lines(table)
    assert [r["n_dropped"] for r in kept.collect()] == [1] * 15 and {"__did", "__th", "__lines", "did", "th"} <= {*kept.columns}
