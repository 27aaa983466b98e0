import base64
import gzip
import hashlib
from collections import Counter

import pytest

from tasklattice.llm import warc

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "https://a.example.com/x?y=1#z", "<p>one</p>"),
    (2, "https://a.example.com/2", "<p>one</p>"),
    (3, None, None),
    (4, "", ""),
    (5, "no scheme", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nGrüße \U0001f600"),
    (6, "http://b.example/\r\nX: 1", "z" * 200_000),
    (7, "http://c.example/7", "twice"),
    (7, "http://c.example/7", "twice"),
    (7, "http://c.example/other", "twice"),
]


def expected(pages, least=0):
    groups = {}
    for k, u, h in pages:
        groups.setdefault((h or "").encode(), []).append((k, u or ""))
    out = []
    for k, u, h in pages:
        data = (h or "").encode()
        lead = max(groups[data])
        stored = len(data) < least or (k, u or "") == lead
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if stored else "revisit", None if stored else lead[0]))
    return Counter(out)


def got(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.mark.parametrize("least", [0, 5])
def test_captures_of_awkward_pages(spark, least):
    p = warc.WarcParams(min_revisit_bytes=least, records_per_file=5)
    path = warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), warc.archive_folder(spark), p)
    rows = warc.assemble(warc.read_records(spark, path))
    assert got(rows) == expected(PAGES, least)
    five = rows.where("page_id = 5").first()
    assert bytes(five.response.payload) == PAGES[4][2].encode()
    one = rows.where("page_id = 1").first()
    assert one.request.first_line == "GET /x?y=1 HTTP/1.1" and one.request.target_uri == PAGES[0][1]
    assert rows.where("page_id = 6").first().request.target_uri == "http://b.example/%0D%0AX: 1"


def test_table(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(warc.query(spark, sf)) == expected(pages)


def test_empty_table_and_null_id(spark):
    path = warc.write_archives(spark.createDataFrame([], SCHEMA), warc.archive_folder(spark))
    assert warc.assemble(warc.read_records(spark, path)).count() == 0
    path = warc.write_archives(spark.createDataFrame([(None, "http://x/", "a")], SCHEMA), warc.archive_folder(spark))
    row = warc.assemble(warc.read_records(spark, path)).first()
    assert row.page_id is None and row.record_type == "response" and row.payload_bytes == 1


def test_parser_reads_members_and_refuses_damage():
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = gzip.compress(one) + gzip.compress(one)
    for chunks in (warc.gunzipped(data), warc.gunzipped(data, 1, 1), warc.gunzipped(one + one)):
        assert [(h["warc-type"], b) for h, b in warc.parse_warc(chunks)] == [("warcinfo", b"abc")] * 2
    assert b"".join(warc.gunzipped(gzip.compress(b"z" * 5_000_000))) == b"z" * 5_000_000
    with pytest.raises(ValueError):
        list(warc.gunzipped(data[:-9]))
    for bad in (one[:-1], b"x" + one, one.replace(b": 3", b": 2")):
        with pytest.raises(ValueError):
            list(warc.parse_warc([bad]))


def test_parser_at_every_split():
    """Records and marks that straddle chunks are found wherever the chunks end."""
    blocks = [b"", b"\r\n\r\n", b"a\r\n\r\nWARC/1.1\r\n\r\n", bytes(range(256))]
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(b), b) for b in blocks)
    for k in range(len(data)):
        assert [b for _, b in warc.parse_warc([data[:k], b"", data[k:]])] == blocks
    assert [b for _, b in warc.parse_warc(data[k : k + 1] for k in range(len(data)))] == blocks


def test_large_pages_share_no_file(spark):
    """Files are bounded by bytes: pages of 2 MB have one each, smaller ones share some."""
    pages = [(k, f"http://x/{k}", chr(97 + k) * n) for k, n in enumerate([10, 20, 70_000, 80_000, 2_000_000, 2_000_001, 2_000_002])]
    path = warc.write_archives(spark.createDataFrame(pages, SCHEMA).coalesce(1), warc.archive_folder(spark))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(path)
    held = sorted(sum(len(x) for x in warc.gunzipped(bytes(r.content))) // 1_000 for r in files.collect())
    assert [x // 1_000 for x in held if x > 1_000] == [2, 2, 2] and len(held) == 5
    assert got(warc.assemble(warc.read_records(spark, path))) == expected(pages)
