"""WARC archives: write pages as records, find the records again by chains of boundaries.

An archive is plain WARC/1.0 and can be read from the middle: Spark cuts it
into byte ranges, and each task reports every place that looks like the start
of a record, with the offset where its successor would begin. A payload may hold
the same magic, so such places are only candidates. Pointer jumping from the
start of each file then keeps exactly the candidates that a reader going from
record to record would meet.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.plans.scratch import discard, materialize

MAGIC = b"WARC/1.0\r\n"
BREAK = b"\n" + MAGIC
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_CANDIDATES = (
    "file string, block long, seg_start long, seg_end long, starts long, succ long, payload_at long, whole boolean, "
    "record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string"
)


def base32_digest(hexadecimal: Column) -> Column:
    """Bare upper-case base32 of a hexadecimal SHA-1: 20 bits make four letters."""
    groups = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record for each row of (page_id, url, html) under ``path``.

    The payload is the html in UTF-8, empty for null. Of payloads that are equal
    and at least ``least_bytes`` long, those with the smallest page_id become
    responses and those with a larger one revisits that refer to it, without
    payload. Rows that repeat the smallest page_id are all responses; so are rows
    with a null page_id, which nothing refers to. Line breaks in a url become
    spaces, a null url is left out. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"),
                        F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("n"))
    # One row for each payload that several ids share: joined by size, whatever Spark finds it to be.
    shared = materialize(
        rows.filter(F.col("n") >= least_bytes).groupBy("sha")
        .agg(F.min("page_id").alias("original"), F.max("page_id").alias("last"))
        .filter("original < last").select("sha", "original"), "shared-payloads")
    revisit = F.coalesce(F.col("page_id") > F.col("original"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit("\r\n\r\n"))
    identity = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), identity,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), base32_digest(F.col("sha")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", " ")), F.lit("")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"),
                                 F.col("original").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string"), F.lit("\r\n\r\n"),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    (rows.join(shared, "sha", "left").select(F.concat(head, http, body).alias("value"))
     .write.option("lineSep", END.decode()).text(path))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between one magic and the next, with the byte range Spark read it in."""
    return spark.read.option("lineSep", BREAK.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """Segments with their offset, counted from the first segment of their byte range."""
    here, at = None, 0
    for batch in batches:
        for file, block, value in zip(*(batch.column(i) for i in range(3)), strict=True):
            key, value = (file.as_py(), block.as_py()), value.as_py()
            if key != here:
                here, at = key, 0
            yield *key, at, value
            at += len(value) + len(BREAK)


def _fields(head: bytes) -> dict[bytes, bytes]:
    pairs = (line.split(b":", 1) for line in head.split(b"\r\n"))
    return {p[0].strip().lower(): p[1].strip() for p in pairs if len(p) == 2}


def _number(text: bytes) -> int | None:
    return int(text) if text.isdigit() else None


def _page(uri: bytes) -> int | None:
    name = uri.removeprefix(b"<urn:page:").removesuffix(b">")
    return int(name) if name.removeprefix(b"-").isdigit() else None


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _candidate(file: str, block: int, at: int, value: bytes) -> tuple:
    """A segment as a record that would begin just before it; ``starts`` is null if it cannot be one."""
    seg_end = at + len(value)
    nothing = (file, block, at, seg_end, *[None] * 10)
    skip = 0
    if at == 0 and block == 0:
        if not value.startswith(MAGIC):
            return nothing
        skip = len(MAGIC)
    text = value + BREAK[:1]  # a break begins with a line's end, which may be the header's
    close = text.find(END, skip)
    if close < 0:
        return nothing
    fields = _fields(value[skip:close])
    length = _number(fields.get(b"content-length", b""))
    if length is None:
        return nothing
    block_at = close + len(END)
    succ = at + block_at + length + len(END)
    whole = succ in (seg_end, seg_end + 1)  # the last byte before a magic belongs to the break
    http_end = text.find(END, block_at)
    payload_at = http_end + len(END) if http_end >= 0 else block_at
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    size = digest = None
    if kind == "revisit":
        size = _number(_fields(text[block_at:payload_at]).get(b"content-length", b""))
        digest = fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    elif whole:
        payload = value[payload_at:block_at + length]
        size, digest = len(payload), _digest(payload)
    return (file, block, at, seg_end, at + skip - len(MAGIC), succ, at + payload_at, whole, kind,
            _page(fields.get(b"warc-record-id", b"")), _page(fields.get(b"warc-refers-to", b"")),
            fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None, size, digest)


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in text.split(", "))])


def _table(rows: list[tuple], text: str) -> pa.RecordBatch:
    schema = _schema(text)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for segment in _walk(batches):
        rows.append(_candidate(*segment))
        if len(rows) == 5000:
            yield _table(rows, _CANDIDATES)
            rows = []
    yield _table(rows, _CANDIDATES)


def _with_offsets(found: DataFrame) -> DataFrame:
    """Offsets from the start of the file: a range begins where the ranges before it ended."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.groupBy("file", "block").agg(F.max(F.col("seg_end") + len(BREAK)).alias("size")).select(
        "file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    moved = ("seg_start", "seg_end", "starts", "succ", "payload_at")
    return found.join(bases, ["file", "block"]).withColumn("rel", F.col("seg_start")).withColumns(
        {c: F.col(c) + F.col("base") for c in moved}).drop("base")


def reachable(links: DataFrame) -> DataFrame:
    """(file, starts) of the candidates reached from offset 0 of their file, given (file, starts, succ).

    Pointer jumping: in each round every pointer leaps to where its target
    points, and every candidate reached marks the one it points at, so n
    records take about log2(n) rounds.
    """
    longest = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    state = links.select("file", "starts", F.col("succ").alias("jump"), (F.col("starts") == 0).alias("reached"))
    for _ in range(int(longest).bit_length()):
        marks = state.filter("reached and jump is not null").select("file", F.col("jump").alias("starts")).distinct()
        leaps = state.select("file", F.col("starts").alias("jump"), F.col("jump").alias("next"))
        onward = materialize(
            state.join(marks.withColumn("marked", F.lit(True)), ["file", "starts"], "left")
            .join(leaps, ["file", "jump"], "left")
            .select("file", "starts", F.col("next").alias("jump"),
                    (F.col("reached") | F.coalesce("marked", F.lit(False))).alias("reached")), "jumps")
        discard(state)
        state = onward
    return state.filter("reached").select("file", "starts")


def _wide_records(spark: SparkSession, path: str, found: DataFrame, records: DataFrame) -> DataFrame:
    """Size and digest of the records whose payload holds a magic, from all their segments."""
    order = Window.partitionBy("file").orderBy("seg_start").rowsBetween(Window.unboundedPreceding, 0)
    chain = records.select("file", "seg_start", "whole", F.struct(F.col("starts").alias("owner"), "succ", "payload_at").alias("r"))
    owned = (
        found.select("file", "block", "rel", "seg_start").join(chain, ["file", "seg_start"], "left")
        .filter(~F.coalesce("whole", F.lit(False)))  # segments of wide records only
        .withColumn("r", F.last("r", ignorenulls=True).over(order)).filter("seg_start < r.succ")
        .select("file", "block", "rel", "seg_start", "r.*")
    )
    wanted = materialize(owned, "wide-segments")
    raw = _segments(spark, path).mapInArrow(_raw, "file string, block long, rel long, value binary")
    whole = wanted.join(raw, ["file", "block", "rel"]).groupBy("file", "owner").agg(
        F.max("succ").alias("succ"), F.max("payload_at").alias("payload_at"),
        F.array_sort(F.collect_list(F.struct("seg_start", "value"))).alias("parts"))
    return whole.mapInArrow(_sum_up, "file string, starts long, size long, sha string")


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for segment in _walk(batches):
        yield _table([segment], "file string, block long, rel long, value binary")


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            text = BREAK.join(p["value"] for p in row["parts"])
            first = row["parts"][0]["seg_start"]
            payload = text[row["payload_at"] - first:row["succ"] - len(END) - first]
            yield _table([(row["file"], row["owner"], len(payload), _digest(payload))],
                         "file string, starts long, size long, sha string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under ``path``.

    file, record_offset, page_id, url, record_type, refers_to, payload_bytes and
    payload_digest. For responses size and digest are taken from the payload as
    read, for revisits from their headers. Records behind a broken link of a
    chain are not returned. Files without records give no rows.
    """
    seen = materialize(_segments(spark, path).mapInArrow(_candidates, _CANDIDATES), "segments")
    found = materialize(_with_offsets(seen), "candidates")
    discard(seen)
    links = found.filter("starts is not null").select("file", "starts", "succ")
    records = found.join(reachable(links), ["file", "starts"])
    if not records.filter("not whole and record_type <> 'revisit'").isEmpty():
        records = materialize(records, "records")
        wide = _wide_records(spark, path, found, records)
        records = records.join(wide, ["file", "starts"], "left").withColumns({
            "payload_bytes": F.coalesce("payload_bytes", "size"), "payload_digest": F.coalesce("payload_digest", "sha")})
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file",
        F.col("starts").alias("record_offset"))
