"""WARC archives: written by Spark's text sink, read back by splits, each record proved by its boundary.

Reading: Spark's text source cuts the files at every line that begins as a record does, in whatever splits, so a task sees
segments in their order and knows their offsets from where its split begins; summed spans give a split's own offset. A
segment that reads as a record's head names a candidate and, by its content length, the offset where the next record has
to begin. Such a head may as well stand inside a payload. So only records that a chain of successors reaches from the
file's start are kept: a task follows the chains of its own split to where they leave it, and pointer jumping over these
hops, two to the power of n splits in round n, finds where the true chain enters each split. Records whose payload holds
such heads lie in several segments; these alone are gathered from a second scan.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, work_path, written

#: Fixed values of the format.
MAGIC, BREAK, END = b"WARC/1.", b"\r\n", b"\r\n\r\n"
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
#: What segments end with: a record's head begins a line.
CUT = BREAK + MAGIC
#: Payloads from this many bytes on are kept once, and the other records of them refer to that one.
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"

SEGMENTS = "file string, block long, start long, size long, span long, head long, body long, next long, leaves long, whole boolean, payload_bytes long, payload_digest string, fields map<string,string>"


def _uuid(of: Column) -> Column:
    """A URN made of a hash, in the form of a version 8 UUID."""
    h = F.md5(of)
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _field(name: str, value: Column) -> Column:
    """A line of a head; none if the value is null. Line breaks in a value are percent-encoded."""
    plain = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), plain, F.lit("\r\n")), F.lit(""))


def decided(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, record_id, original): original names the record that a revisit refers to, else null.

    Equal payloads of REVISIT_BYTES or more have one response, that with the largest page_id, then url; rows equal in all
    have it once too.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "key": F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha2("html", 256))})
    each = rows.where("key IS NOT NULL").groupBy("key", "page_id", "url").agg(F.count("*").alias("n"))
    groups = each.groupBy("key").agg(F.max(F.struct("page_id", "url", "n")).alias("best"), F.sum("n").alias("n")).where("n > 1")
    groups = written(groups.select("key", F.col("best.page_id").alias("of_page"), F.col("best.url").alias("of_url"), F.col("best.n").alias("of_n")), "warc-groups")
    met = rows.join(groups, "key", "left")
    mine = F.col("of_n").isNotNull() & F.col("page_id").eqNullSafe(F.col("of_page")) & F.col("url").eqNullSafe(F.col("of_url"))
    first = _uuid(F.concat_ws(":", F.lit("response"), "key"))
    out = ["page_id", "url", "html", "digest", "record_id", "original"]
    single = met.where(~mine | (F.col("of_n") == 1)).withColumn("record_id", F.when(mine, first).otherwise(F.concat(F.lit("urn:uuid:"), F.uuid())))
    single = single.withColumn("original", F.when(F.col("of_n").isNotNull() & ~mine, first)).select(*out)
    # rows equal in all: one of them stands for all, and the copies are made of it
    tied = rows.join(groups.where("of_n > 1"), "key").where(mine).groupBy("key").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "html", "digest", "of_n")))
    copies = tied.select("key", "page_id", "url", "html", "digest", F.explode(F.sequence(F.lit(1), F.col("of_n"))).alias("copy"))
    copies = copies.withColumn("record_id", F.when(F.col("copy") == 1, first).otherwise(F.concat(F.lit("urn:uuid:"), F.uuid())))
    return single.unionByName(copies.withColumn("original", F.when(F.col("copy") > 1, first)).select(*out))


def write(pages: DataFrame, path: str | None = None, *, date: str = DATE, compression: str = "none") -> str:
    """Writes pages (page_id, url, html) as WARC files, a record a row, and returns the path.

    A null html is an empty payload, a null url is named after the page, a null page_id has no field. Extra columns have no
    part. compression: of whole files, as Spark's text sink knows them; files that aren't compressed are read by splits.
    """
    path = path or work_path(pages.sparkSession, "warc")
    rows = decided(pages)
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _field("WARC-Profile", F.when(revisit, SAME_PAYLOAD)),
        _field("WARC-Refers-To", F.concat(F.lit("<"), "original", F.lit(">"))),
        _field("Page-Id", F.col("page_id")),
        _field("Content-Type", F.lit(HTTP)),
        _field("Content-Length", F.octet_length("body")),
    )
    record = F.concat(head, F.lit("\r\n"), F.col("body"))
    rows.withColumn("body", body).select(record.alias("value")).write.option("lineSep", END.decode()).option("compression", compression).text(path)
    return path


_FIRST = re.compile(rb"\d\r\n")
_SIZE = re.compile(r"\d{1,15}")


def head(text: bytes) -> tuple[int, int, dict[str, str]] | None:
    """Of what follows MAGIC: where the body begins, its length, and the fields by lower-case name; None: no head."""
    end = text.find(END)
    if end < 0 or not _FIRST.match(text):
        return None
    fields: dict[str, str] = {}
    name = ""
    for line in text[:end].split(BREAK)[1:]:
        if line[:1] in (b" ", b"\t") and name:  # a folded line
            fields[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        before, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            return None
        name = before.strip().lower()
        fields[name] = value.strip()
    if "warc-type" not in fields or not _SIZE.fullmatch(fields.get("content-length", "")):
        return None
    return end + len(END), int(fields["content-length"]), fields


def payload(body: bytes, fields: dict[str, str]) -> bytes:
    """A body without the head of its HTTP message."""
    if fields.get("content-type", "").lower().startswith("application/http") and (at := body.find(END)) >= 0:
        return body[at + len(END) :]
    return body


class _Block:
    """Segments of a split, whose offsets count from its first segment."""

    def __init__(self, file: str, block: int):
        self.file, self.block, self.at, self.rows = file, block, 0, []
        self.known: dict[int, int] = {}

    def add(self, value: bytes) -> None:
        first = self.block == 0 and not self.rows
        skip = len(MAGIC) if first else 0
        found = head(value[skip:]) if not first or value.startswith(MAGIC) else None
        row = [self.file, self.block, self.at, len(value), None, None, None, None, None, False, None, None, None]
        if found:
            start, size, fields = found
            body = skip + start
            whole = len(value) >= body + size
            row[5:10] = [self.at if first else self.at - len(MAGIC), self.at + body, self.at + body + size + len(END), None, whole]
            if whole:
                own = payload(value[body : body + size], fields)
                row[10:12] = [len(own), hashlib.sha1(own).hexdigest()]
            row[12] = list(fields.items())
            self.known[row[5]] = len(self.rows)
        self.rows.append(row)
        self.at += len(value) + len(CUT)

    def close(self) -> pa.RecordBatch:
        for row in reversed(self.rows):  # where each chain leaves the split
            if row[7] is not None:
                to = self.known.get(row[7])
                row[8] = row[7] if to is None else self.rows[to][8]
        self.rows[-1][4] = self.at  # the split's span, at its last segment
        kinds = [pa.string(), *[pa.int64()] * 8, pa.bool_(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*self.rows), kinds)], names)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", CUT.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = None
    for b in batches:
        for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if own is None or (own.file, own.block) != (file, block):
                if own is not None:
                    yield own.close()
                own = _Block(file, block)
            own.add(value.as_buffer().to_pybytes())
    if own is not None:
        yield own.close()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, start, value) of all segments; start as in _Block."""
    at, of = 0, None
    for b in batches:
        starts = []
        for file, block, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (len(v.as_buffer()) for v in b.column(2))):
            if of != (file, block):
                at, of = 0, (file, block)
            starts.append(at)
            at += n + len(CUT)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, pa.int64()), b.column(2)], ["file", "block", "start", "value"])


def entries(hops: DataFrame) -> DataFrame:
    """(file, head) of where the chain from each file's start enters a split, by pointer jumping over hops (file, head, leaves).

    Round n adds what lies up to 2^n hops behind what is known, and doubles the hops.
    """
    reached, heads = written(hops.where("head = 0").select("file", "head"), "warc-reached"), hops.select("file", "head")
    known = reached.count()
    while known:
        new = reached.join(hops, ["file", "head"]).select("file", F.col("leaves").alias("head")).join(heads, ["file", "head"], "left_semi")
        reached = written(reached.unionByName(new).distinct(), "warc-reached")
        before, known = known, reached.count()
        if known == before:
            break
        onward = hops.select("file", F.col("head").alias("leaves"), F.col("leaves").alias("further"))
        hops = written(hops.join(onward, ["file", "leaves"]).select("file", "head", F.col("further").alias("leaves")), "warc-hops")
    return reached


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds owner to segments in their order: the last record reached in the split so far, null if there is none."""
    of = want = owner = None
    for b in batches:
        column = lambda n: b.column(b.schema.get_field_index(n)).to_pylist()
        owners = []
        for file, block, at, onward, enters in zip(*map(column, ("file", "block", "head", "next", "enters"))):
            if of != (file, block):
                of, want, owner = (file, block), None, None
            if at is not None and (enters or at == want):
                owner, want = at, onward
            owners.append(owner)
        yield b.append_column("owner", pa.array(owners, pa.int64()))


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, head, payload) of bodies (file, head, body, content_type)."""
    for b in batches:
        got = [payload(x, {"content-type": t or ""}) for x, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], ["file", "head", "payload"])


def read(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """(file, offset, type, record_id, fields, payload_bytes, payload_digest) of all records reached from the files' starts.

    fields: a head's fields by lower-case name, of repeated ones the last. The digest is the SHA-1 of the payload, the body
    without the head of its HTTP message. A record that the file's end cuts off has null for both; a file that doesn't
    begin with a record gives none, and neither does anything behind a gap. with_payload adds the payload itself.
    """
    found = written(arrow_map(_lines(spark, path), _segments, SEGMENTS), "warc-segments")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    base = found.where("span IS NOT NULL").select("file", "block", F.coalesce(F.sum("span").over(before), F.lit(0)).alias("base"))
    base = written(base, "warc-splits")
    moved = {c: F.col(c) + F.col("base") for c in ("head", "body", "next", "leaves")}
    placed = found.join(base, ["file", "block"]).withColumns(moved)
    heads = placed.where("head IS NOT NULL").select("file", "head", "leaves")
    ways = heads.select("file", F.col("leaves").alias("head")).unionByName(heads.where("head = 0").select("file", "head")).distinct()
    enters = entries(written(heads.join(ways, ["file", "head"], "left_semi"), "warc-hops"))
    marked = placed.join(enters.withColumn("enters", F.lit(True)), ["file", "head"], "left")
    columns = ["file", "block", "start", "base", "size", "head", "body", "next", "whole", "payload_bytes", "payload_digest", "fields", "enters"]
    dealt = marked.select(*columns).repartition("file", "block").sortWithinPartitions("file", "block", "start")
    schema = "file string, block long, start long, base long, size long, head long, body long, next long, whole boolean, payload_bytes long, payload_digest string, fields map<string,string>, enters boolean, owner long"
    marked = written(arrow_map(dealt, _marked, schema), "warc-marked")
    records = marked.where("head = owner")
    out = records.select("file", F.col("head").alias("offset"), F.col("fields")["warc-type"].alias("type"), F.regexp_extract(F.col("fields")["warc-record-id"], "^<?([^>]*)>?$", 1).alias("record_id"), "fields", "payload_bytes", "payload_digest")
    if not with_payload and records.where("NOT whole").isEmpty():
        return out
    parts = _payloads(spark, path, marked, records if with_payload else records.where("NOT whole"), base)
    parts = parts.select("file", F.col("head").alias("offset"), F.octet_length("payload").cast("long").alias("_bytes"), F.sha1("payload").alias("_digest"), *["payload"] * with_payload)
    both = out.join(parts, ["file", "offset"], "left").withColumns({"payload_bytes": F.coalesce("payload_bytes", "_bytes"), "payload_digest": F.coalesce("payload_digest", "_digest")})
    return both.drop("_bytes", "_digest")


def _payloads(spark: SparkSession, path: str, marked: DataFrame, records: DataFrame, base: DataFrame) -> DataFrame:
    """(file, head, payload) of the records that are wholly there, gathered from the segments they lie in."""
    last = marked.groupBy("file", "block").agg(F.max("owner").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    last = last.select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    owned = marked.select("file", "block", "start", "base", F.col("owner").alias("own")).join(last, ["file", "block"]).withColumn("head", F.coalesce("own", "carried"))
    kept = records.select("file", "head", "body", (F.col("next") - len(END)).alias("ends"), F.col("fields")["content-type"].alias("content_type"))
    wanted = owned.join(kept, ["file", "head"]).where(F.col("start") + F.col("base") - len(CUT) < F.col("ends"))
    values = arrow_map(_lines(spark, path), _numbered, "file string, block long, start long, value binary")
    pieces = values.join(wanted, ["file", "block", "start"])
    at = F.col("start") + F.col("base")
    # a record's pieces, with what they were cut at between them, are one value in the end
    met = pieces.groupBy("file", "head", "body", "ends", "content_type").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "value"))).alias("p"))
    text = F.aggregate("p", F.lit(b""), lambda x, y: F.when(F.length(x) == 0, y["value"]).otherwise(F.concat(x, F.lit(CUT), y["value"])))
    met = met.withColumns({"text": text, "from": F.col("p")[0]["at"]}).withColumn("body", F.expr("substring(text, cast(body - from + 1 AS int), cast(ends - body AS int))"))
    whole = met.where(F.expr("from + length(text) >= ends"))
    return arrow_map(whole.select("file", "head", "body", "content_type"), _assembled, "file string, head long, payload binary")


def op13(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row, as read back from the archives.

    A null html is an empty payload. Repeated page_ids and rows give a record each; equal payloads of rows that share the
    largest page_id have one response among them. Null page_ids stay null, and such a page is the response of its payload
    only if all pages of it are. Payloads of any length are one record. An empty table gives an empty result. Extra
    columns, whatever their names, play no part.
    """
    found = read(pages.sparkSession, write(pages))
    own = found.select("type", "record_id", F.regexp_extract(F.col("fields")["warc-refers-to"], "^<?([^>]*)>?$", 1).alias("original"), F.col("fields")["page-id"].cast("long").alias("page_id"), "payload_bytes", "payload_digest")
    first = own.where("type = 'response'").select(F.col("record_id").alias("original"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest"))
    again = own.where("type = 'revisit'").drop("payload_bytes", "payload_digest").join(first, "original", "left")
    again = again.select("page_id", F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("of_page").alias("refers_to"))
    return own.where("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(again)


#: op13 in SQL for DuckDB.
OP13_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, strlen(html) >= {REVISIT_BYTES} AS large,
         row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS nth, max(page_id) OVER (PARTITION BY html) AS top
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN large AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN large AND nth > 1 THEN top END AS refers_to
FROM r
"""
