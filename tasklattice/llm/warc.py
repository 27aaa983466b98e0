"""WARC archives: writing captures, reading records, assembling transactions.

``write_archives`` turns pages into request, response (or revisit) and metadata
records, built as strings in the JVM and written by Spark's text writer with
the record separator as line end, gzipped, into the shared folder.  Pages are
written by classes of size, so a file holds at most ``records_per_file`` / 3
times ``small_bytes`` of payload, or one capture.  ``read_records`` decompresses
and parses the files as streams, by their Content-Length headers.  ``assemble`` joins the request and metadata records to
the response or revisit that they are concurrent to, and gives one nested row
for each capture.

Of equal payloads of ``min_revisit_bytes`` or more, the capture with the largest
page id is stored and the others refer to it.  Only payload digests that occur
more than once are looked up; that table is broadcast up to ``broadcast_rows``
rows and joined by shuffle beyond that.

Defined cases: null html is an empty payload; a null or empty url gives records
without target; equal pages (id, url and html) are captures of their own with
one record id, and give a row each; of pages with one id and one payload but
different urls, the one with the largest url is stored; an empty table gives
archives without records and an empty result.  Damaged files raise an error.
Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklattice.llm.common import checkpointed, shared_dir

EOL = "\r\n"
END = EOL + EOL
BASE32_HEX = "0123456789abcdefghijklmnopqrstuv"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class WarcParams:
    min_revisit_bytes: int = 0
    #: Records of a file; pages above small_bytes share files of fewer, those above medium_bytes have one each.
    records_per_file: int = 6000
    small_bytes: int = 64 << 10
    medium_bytes: int = 1 << 20
    date: str = "2026-01-01T00:00:00Z"
    broadcast_rows: int = 100_000


PRODUCTION = WarcParams()


def sha1_base32(data: Column) -> Column:
    """Base 32 of the SHA-1, 20 bits at a time."""
    digest = F.sha1(data)
    parts = [F.lpad(F.lower(F.conv(F.substring(digest, k, 5), 16, 32)), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, block: Column, date: str, **fields: Column) -> Column:
    """A record without the two line ends that close it; null fields are left out."""
    lines = [F.lit(f"WARC/1.1{EOL}WARC-Type: {kind}{EOL}WARC-Date: {date}{EOL}")]
    for name, value in fields.items():
        head = name.replace("_", "-")
        lines.append(F.coalesce(F.concat(F.lit(f"{head}: "), value, F.lit(EOL)), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, params: WarcParams = PRODUCTION) -> str:
    """Write gzipped archives of ``pages`` (page_id, url, html) to the folder ``path``."""
    p = params
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": sha1_base32(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    equal = rows.where(F.col("size") >= p.min_revisit_bytes).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("lead"))
    equal = checkpointed(equal.where("n > 1").select("digest", "size", "lead"))
    if equal.count() <= p.broadcast_rows:
        equal = F.broadcast(equal)
    # Pages of like size share files, so a file's bytes are bounded, or those of one capture.
    classes, low = [], -1
    for high, per_file in ((p.small_bytes, p.records_per_file), (p.medium_bytes, max(3, p.records_per_file * p.small_bytes // p.medium_bytes)), (None, 3)):
        own = F.col("size") > low
        classes.append((own if high is None else own & (F.col("size") <= high), per_file))
        low = high
    present = rows.agg(*[F.bool_or(own).alias(f"c{k}") for k, (own, _) in enumerate(classes)]).first()
    used = [x for x, there in zip(classes, present, strict=True) if there] or classes[:1]
    for k, (own, per_file) in enumerate(used):
        part = rows.where(own) if len(used) > 1 else rows
        _write_captures(part.join(equal, ["digest", "size"], "left"), f"{path}/{k}", per_file, p)
    return path


def _write_captures(rows: DataFrame, path: str, records_per_file: int, p: WarcParams) -> None:
    uri = F.nullif(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.lit(""))
    host, rest = F.regexp_extract("uri", "://([^/?#]*)", 1), F.regexp_extract("uri", "://[^/?#]*([^#]*)", 1)
    rows = rows.withColumns(
        {
            "uri": uri,
            "id": _urn(F.col("page_id"), F.col("url"), F.col("digest")),
            "lead_id": F.when(F.col("lead").isNotNull() & ~F.struct("page_id", "url").eqNullSafe(F.col("lead")), _urn(F.col("lead.page_id"), F.col("lead.url"), F.col("digest"))),
            "http": F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(END)),
        }
    )
    rows = rows.withColumn("ask", F.concat(F.lit("GET "), F.concat(F.when(rest.startswith("/"), F.lit("")).otherwise(F.lit("/")), F.coalesce(rest, F.lit(""))), F.lit(f" HTTP/1.1{EOL}Host: "), F.coalesce(host, F.lit("")), F.lit(END)))
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(EOL)), F.lit("")), F.lit(f"via: crawl{EOL}"))
    target = F.col("uri")
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    own = {"WARC_Record_ID": F.col("id"), "WARC_Target_URI": target, "WARC_Payload_Digest": digest, "Content_Type": F.lit("application/http;msgtype=response")}
    response = _record("response", F.concat("http", "html"), p.date, **own)
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    revisit = _record("revisit", F.col("http"), p.date, **own, WARC_Profile=profile, WARC_Refers_To=F.col("lead_id"))
    request = _record("request", F.col("ask"), p.date, WARC_Record_ID=_urn(F.col("id"), F.lit("request")), WARC_Target_URI=target, WARC_Concurrent_To=F.col("id"), Content_Type=F.lit("application/http;msgtype=request"))
    metadata = _record("metadata", about, p.date, WARC_Record_ID=_urn(F.col("id"), F.lit("metadata")), WARC_Target_URI=target, WARC_Concurrent_To=F.col("id"), Content_Type=F.lit("application/warc-fields"))
    records = rows.select(F.explode(F.array(request, F.when(F.col("lead_id").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    # In the writer's options the level of the codec is by its Hadoop name.
    writer = records.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def gunzipped(data: bytes, step: int = 1 << 16, most: int = 1 << 20) -> Iterator[bytes]:
    """The content of all members of a gzip file, at most ``most`` bytes at a time; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    member, within, at, held = zlib.decompressobj(31), False, 0, b""
    while held or at < len(data):
        if not held:
            held, at = data[at : at + step], at + step
        within = True
        yield member.decompress(held, most)
        held = member.unconsumed_tail
        if member.eof:
            held, member, within = member.unused_data, zlib.decompressobj(31), False
    while within and not member.eof:
        rest = member.decompress(b"", most)
        if not rest and not member.eof:
            raise ValueError("a gzip member ends too early")
        yield rest


def parse_warc(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names, with the version under '') and blocks of uncompressed records.

    Holds a record and a chunk at a time.
    """
    chunks, held, at, passed = iter(chunks), bytearray(), 0, 0

    def fill(n: int) -> bool:
        """Read on until ``n`` bytes are held beyond ``at``, if there are so many."""
        nonlocal at, passed
        if len(held) - at < n and at:
            del held[:at]
            passed, at = passed + at, 0
        while len(held) - at < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(held) - at - 3)
            if not fill(len(held) - at + 1):
                break
        if end < 0 or not held.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {passed + at}")
        version, *lines = held[at:end].decode("utf-8", "replace").split("\r\n")
        head = {"": version}
        for line in lines:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        skip, n = end + 4 - at, int(head["content-length"])
        fill(skip + n + 4)
        start = at + skip
        if held[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {passed + at} does not end where its length says")
        yield head, bytes(memoryview(held)[start : start + n])
        at = start + n + 4


_FIELDS = [
    ("kind", pa.string(), "string"),
    ("record_id", pa.string(), "string"),
    ("concurrent_to", pa.string(), "string"),
    ("refers_to_id", pa.string(), "string"),
    ("target_uri", pa.string(), "string"),
    ("first_line", pa.string(), "string"),
    ("page_id", pa.int64(), "long"),
    ("payload_bytes", pa.int64(), "long"),
    ("payload_digest", pa.string(), "string"),
    ("payload", pa.binary(), "binary"),
]


def _row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = head.get("warc-type", "")
    page, size, digest, payload, line = None, None, None, None, None
    if head.get("content-type", "").startswith("application/http"):
        top, _, body = block.partition(b"\r\n\r\n")
        line, *lines = top.decode("utf-8", "replace").split("\r\n")
        if kind == "response":
            size, digest, payload = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), body
            if head.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                raise ValueError(f"payload of {head.get('warc-record-id')} does not have its digest")
        elif kind == "revisit":
            digest = head.get("warc-payload-digest", "").partition(":")[2] or None
            size = next((int(x.partition(":")[2]) for x in lines if x.lower().startswith("content-length:")), None)
    elif kind == "metadata":
        for x in block.decode("utf-8", "replace").split("\r\n"):
            if x.startswith("page-id:"):
                page = int(x[8:])
    cells = (kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), line, page, size, digest)
    return (*cells, payload if with_payload else None)


def read_records(spark: SparkSession, path: str, with_payload: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """A row for each record of the archives below ``path``.

    A task holds the compressed files of its scan partition, a record and a
    batch of results of some ``batch_bytes``.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=[f[0] for f in _FIELDS])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for head, block in parse_warc(gunzipped(data.as_py())):
                    rows.append(_row(head, block, with_payload))
                    held += 500 + (len(block) if with_payload else 0)
                    if held >= batch_bytes:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, ", ".join(f"{n} {t}" for n, _, t in _FIELDS))


def assemble(records: DataFrame, params: WarcParams = PRODUCTION) -> DataFrame:
    """One row for each capture: page_id, record_type, payload_bytes, payload_digest, refers_to, and the three records nested.

    ``records`` are read twice.  A payload that a third of all captures revisit
    is one row of the table of stored captures that others refer to; that table
    is broadcast up to ``broadcast_rows`` rows, so the revisits stay where they are.
    """
    key = F.coalesce("concurrent_to", "record_id")
    main = F.col("kind").isin("response", "revisit")
    nested = lambda when, *cols: F.first(F.when(when, F.struct(*cols)), ignorenulls=True)
    captures = records.groupBy(key.alias("capture_id")).agg(
        F.count_if(main).alias("copies"),
        nested(F.col("kind") == "request", "record_id", "target_uri", "first_line").alias("request"),
        nested(main, "kind", "record_id", "target_uri", "first_line", "payload_bytes", "payload_digest", "refers_to_id", "payload").alias("response"),
        nested(F.col("kind") == "metadata", "record_id", "page_id").alias("metadata"),
    )
    captures = captures.where("copies > 0")
    referred = records.where("kind = 'revisit'").select(F.col("refers_to_id").alias("stored_id")).distinct()
    told = records.where("kind = 'metadata'").select(F.col("concurrent_to").alias("stored_id"), "page_id")
    stored = told.join(referred, "stored_id", "left_semi").groupBy("stored_id").agg(F.max("page_id").alias("refers_to"))
    stored = checkpointed(stored)
    if stored.count() <= params.broadcast_rows:
        stored = F.broadcast(stored)
    joined = captures.join(stored, F.col("response.refers_to_id") == F.col("stored_id"), "left")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return joined.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        "refers_to",
        "capture_id",
        "request",
        "response",
        "metadata",
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives, in the shared one."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = write_archives(pages, archive_folder(spark))
    captures = assemble(checkpointed(read_records(spark, path, with_payload=False)))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("request.target_uri").alias("target_uri"))
