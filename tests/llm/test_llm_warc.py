import hashlib
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.llm import warc

PAGES = "page_id long, url string, html string, type string, digest string, key long"
HEAD = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n"


def brute(rows):
    groups, out = defaultdict(list), []
    for page, _, html, *_ in rows:
        groups[html or ""].append(page)
    for html, own in groups.items():
        data = html.encode()
        own = sorted(own, key=lambda p: (p is not None, p or 0), reverse=True)
        for n, page in enumerate(own):
            again = n > 0 and len(data) >= 1000
            out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", own[0] if again else None))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, warc.op13(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.fixture
def small_splits(spark):
    for k, v in {"spark.sql.files.maxPartitionBytes": "3k", "spark.sql.files.openCostInBytes": "1k"}.items():
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


@pytest.fixture(scope="module")
def rows():
    """Payloads made of heads, line breaks and magic, over many splits."""
    r, out = random.Random(1), []
    for i in range(60):
        html = "".join(r.choice(["a" * r.randrange(400), "\r\n", "\r", "\r\n\r\n", "WARC/1.1", "é", HEAD % r.choice([0, 3, 100, 5000]), "\r\nWARC/1."]) for _ in range(r.randrange(30)))
        out.append((i, f"http://x/WARC/1.{i}" if i % 3 else None, html))
    long = out[5][2] * 20
    out += [(100 + i, "u", long) for i in range(5)] + [(104, "u", long)] * 3 + [(104, "v", long), (None, None, None), (None, None, out[7][2] * 9), (None, None, "only" * 300), (None, None, "only" * 300)]
    return out + [(7, "a\r\nWARC/1.1\r\nb", "z" * 999), (8, "a", "z" * 999), (9, "a", "z" * 1000), (9, "b", "z" * 1000), (10, "", "é" * 500), (11, "", "é" * 500)]


def test_against_definition_in_small_splits(spark, small_splits, rows):
    df = spark.createDataFrame([(*x, "clash", "clash", 1) for x in rows], PAGES)
    assert found(df.coalesce(1)) == brute(rows) and found(df.repartition(3)) == brute(rows)


def test_payloads_and_heads(spark, small_splits, rows):
    path = warc.write(spark.createDataFrame([(*x, "", "", 1) for x in rows], PAGES).repartition(2))
    got = warc.read(spark, path, with_payload=True).collect()
    assert len(got) == len(rows) and len({r["record_id"] for r in got}) == len(rows)
    assert {r["payload"].decode() for r in got if r["type"] == "response"} == {x[2] or "" for x in rows}
    ids, page = {r["record_id"]: r for r in got}, lambda r: int(r["fields"].get("page-id", -1))
    for r in got:
        if r["type"] == "revisit":
            of = ids[r["fields"]["warc-refers-to"].strip("<>")]
            assert of["type"] == "response" and f"sha1:{of['payload_digest']}" == r["fields"]["warc-payload-digest"] and page(of) >= page(r)
        else:
            assert r["fields"]["warc-payload-digest"] == f"sha1:{r['payload_digest']}"


def test_compressed_files(spark, rows):
    path = warc.write(spark.createDataFrame([(*x, "", "", 1) for x in rows], PAGES), compression="gzip")
    got = warc.read(spark, path)
    assert got.count() == len(rows) and got.where("payload_digest IS NULL").count() == 0


def test_another_writers_archive(spark, tmp_path):
    """Folded lines, other cases, no HTTP head, what comes behind a gap, and a record that the file's end cuts off."""
    def record(kind, body, extra=""):
        return f"WARC/1.0\r\nwarc-type:{kind}\r\nWARC-Record-ID: <urn:{kind}>\r\n{extra}content-length: {len(body)}\r\n\r\n{body}\r\n\r\n"

    inner = "\r\n\r\nWARC/1.0\r\nWARC-Type: a\r\nContent-Length: 1\r\n\r\nb"
    good = record("warcinfo", "software: x\r\n", "X-Note: one\r\n two\r\n") + record("metadata", inner)
    Path(tmp_path, "a.warc").write_bytes((good + record("request", "abc")[:-6]).encode())
    Path(tmp_path, "b.warc").write_bytes((good + "gap" + record("conversion", "never reached")).encode())
    Path(tmp_path, "c.warc").write_bytes(b"no archive\r\n\r\n" + good.encode())
    got = {(r["file"][-6], r["type"]): r for r in warc.read(spark, f"file://{tmp_path}", with_payload=True).collect()}
    assert sorted(got) == [("a", "metadata"), ("a", "request"), ("a", "warcinfo"), ("b", "metadata"), ("b", "warcinfo")]
    assert got["a", "warcinfo"]["fields"]["x-note"] == "one two" and got["a", "warcinfo"]["payload"] == b"software: x\r\n"
    assert got["b", "metadata"]["payload"].decode() == inner and got["a", "request"]["payload_digest"] is None and got["a", "request"]["payload"] is None


def test_jumps(spark):
    """Chains of hops in two files, of which only those from offset 0 count."""
    hops = [("a", 10 * i, 10 * (i + 1)) for i in range(70)] + [("a", 5, 20), ("a", 7, 9)] + [("b", 0, 4), ("b", 3, 8)]
    got = warc.entries(spark.createDataFrame(hops, "file string, head long, leaves long"))
    assert sorted(map(tuple, got.collect())) == sorted([("a", 10 * i) for i in range(70)] + [("b", 0)])


def test_empty(spark):
    assert warc.op13(spark.createDataFrame([], PAGES)).where(F.lit(True)).count() == 0
