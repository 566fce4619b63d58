import base64
import hashlib
import struct
import sys
from pathlib import Path

import pytest
import zstandard

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import both  # noqa: E402

from tracewell.llm import warc  # noqa: E402

COLUMNS = "page_id long, url string, html string, key string, first long, digest string, length string"


def table(spark, pages):
    return spark.createDataFrame([(*p, "k", 7, "d", "l") for p in pages], COLUMNS)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/archives"


def brute(pages, least=0):
    out = []
    for i, _, html in pages:
        p = (html or "").encode()
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        first = max(same, default=None)
        revisit = len(p) >= least and i != first
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def digests(df):
    return sorted(map(tuple, warc.digests(df).drop("url").collect()), key=str)


def pages(n=300):
    body = "<html><head><title>Page {0}</title></head><body><p>Common words of every page, then number {0}.</p>" + "<div class='row'>cell</div>" * 5
    out = [(i, f"http://h{i % 3}/p/{i}", body.format(i)) for i in range(n)]
    out += [(1000 + i, "http://copy", body.format(5)) for i in range(n // 2)]  # a third of all
    out += [(2000 + i, "http://copy", body.format(i)) for i in range(0, 40, 2)]
    return out + [(-3, None, None), (-2, "http://a b\r\nX-Evil: 1", ""), (None, "u", "no id"), (None, "u", body.format(7)), (2**63 - 1, "u", "é😀\r\n\r\nWARC/1.1"), (-(2**63), "u", "x" * 500_000)]


def test_round_trip(spark, folder):
    warc.write_archives(table(spark, pages()), folder, archive_bytes=4000)
    back = warc.read_archives(spark, folder)
    assert digests(back) == brute(pages())
    full = {(r.page_id, bytes(r.payload)) for r in warc.with_payloads(back).collect()}
    assert full == {(i, (h or "").encode()) for i, _, h in pages()}
    urls = {r.page_id: r.url for r in back.collect()}
    assert urls[3] == "http://h0/p/3" and urls[-3] is None and "\r" not in urls[-2] and urls[-2] == "http://a%20b%0D%0AX-Evil:%201"


@pytest.mark.parametrize("least", [1, 3, 10**9])
def test_small_payloads_are_responses(spark, folder, least):
    some = pages(20) + [(5000, "u", "ab"), (5001, "u", "ab")]
    warc.write_archives(table(spark, some), folder, least_bytes=least)
    assert digests(warc.read_archives(spark, folder)) == brute(some, least)


def test_query_reads_every_page(spark):
    from tracewell.llm import queries

    sf = "/root/testdata/sf0.001"
    want = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert digests(queries.op13_warc(spark, sf)) == brute(want)


def test_equals_sql(spark):
    from tracewell.llm import queries

    ours, theirs = both(spark, queries.QUERIES["op13_warc"], queries.ORACLES["op13_warc"], "/root/testdata/sf0.001")
    assert ours == theirs and ours


def test_form_of_archives(spark, folder):
    """A leading dictionary frame, one frame a record, each readable by itself; many archives, none without records."""
    warc.write_archives(table(spark, pages()), folder, archive_bytes=4000)
    files = sorted(Path(folder.removeprefix("file://")).glob("*.warc.zst"))
    assert len(files) > 4
    total = 0
    for f in files:
        data = f.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and size > 256
        shared, at, kinds = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size, []
        while data[at : at + 4] != b"P*M\x18":
            d = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
            kinds.append(d.decompress(data[at:]).split(b"\r\n")[1])
            at = len(data) - len(d.unused_data)
        assert data[at:] == b"P*M\x18\0\0\0\0" and kinds[0] == b"WARC-Type: warcinfo" and b"WARC-Type: warcinfo" not in kinds[1:]
        total += len(kinds) - 1
    assert total == len(pages())


def test_damage_is_noticed(spark, folder):
    warc.write_archives(table(spark, [(1, "u", "some page"), (2, "u", "other")]), folder)
    f = next(Path(folder.removeprefix("file://")).glob("*.warc.zst"))
    headers, block = list(warc.read_records(f.read_bytes()))[1]
    with pytest.raises(ValueError, match="does not hold"):
        warc.page(headers, block + b"x")
    with pytest.raises(ValueError, match="cut short|not a WARC"):
        list(warc.read_records(zstandard.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def test_ids_carry_pages():
    for i in (0, 1, -1, 2**63 - 1, -(2**63), None, 12345678901234):
        urn = warc.record_id(i, "ABC")
        assert warc.page_of(urn) == i and urn != warc.record_id(i, "ABD")
        assert urn[len("<urn:uuid:") + 14] == "8"


def test_empty_and_few(spark, folder):
    warc.write_archives(table(spark, []), folder)
    assert warc.read_archives(spark, folder).collect() == []
    warc.write_archives(table(spark, [(1, None, None)]), f"{folder}2")
    assert digests(warc.read_archives(spark, f"{folder}2")) == brute([(1, None, None)])
