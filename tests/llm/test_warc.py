import base64
import gzip
import hashlib
import io
import re
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import warc

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("most", [100_000, 0])
def test_round_trip_of_odd_pages(spark, monkeypatch, most):
    long = "<p>" + "x\r\n\r\ny" * 50_000
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "u\nv", None), (2, "", ""), (None, "http://c", "same"), (None, "http://d", "alone"), (7, "l", long), (8, " é b ", "ünï")]
    clashes = ("original", "id", "digest", "named", "repeated", "payload", "refers_to", "n", "value")
    pages = spark.createDataFrame(rows, PAGES).withColumns({name: F.lit("clash") for name in clashes})
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", most)
    found = warc.archive_round_trip(pages).collect()
    assert len(found) == len(rows) and all(row["intact"] is True for row in found)
    assert {row["target"] for row in found} >= {"%20%C3%A9%20b%20", "u%0Av", "http://a"}
    by_id = {row["page_id"]: row for row in found if row["page_id"] is not None}
    assert {i: (row["record_type"], row["refers_to"]) for i, row in by_id.items()} == {
        3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), 1: ("response", None), 2: ("revisit", 1), 7: ("response", None), 8: ("response", None),
    }
    assert sorted(row["record_type"] for row in found if row["page_id"] is None) == ["response", "revisit"]
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None:
            assert by_id[i]["payload_bytes"] == len(data) and by_id[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], PAGES)
    found = {row["page_id"]: row["record_type"] for row in warc.archive_round_trip(pages, min_bytes=5).collect()}
    assert found == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_repeated_rows_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "a", "p"), (1, "a", "p")], PAGES)
    assert [row["record_type"] for row in warc.archive_round_trip(pages).collect()] == ["response", "response"]
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).collect() == []


def members(data: bytes) -> list[bytes]:
    """The gzip members of a file, each decompressed by itself."""
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        assert one.eof
        data = one.unused_data
    return out


def test_archives_member_by_member(spark, tmp_path):
    """Each record is a member of its own with fresh headers; archives keep to their bytes; large records and repeated rows are whole."""
    big = "".join(chr(33 + k * k % 89) for k in range(70_000)) * 260  # more than 16 MB
    rows = [(k, f"http://h/{k}", f"page {k % 30} " * 40) for k in range(90)] + [(500, "http://big", big), (3, "http://h/3", "page 3 " * 40), (501, None, big)]
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    warc.write_archives(warc.resolve(pages), str(tmp_path / "out"), "2020-02-02T00:00:00Z", 4000)
    files = sorted((tmp_path / "out").glob("*.warc.gz"))
    ids, types, refers = [], [], []
    for file in files:
        data = file.read_bytes()
        records = [record for record in members(data) if record]
        assert len(data) <= 4400 or len(records) == 2
        assert records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        assert b"".join(records) == gzip.decompress(data)
        for record in records:
            head, _, rest = record.partition(b"\r\n\r\n")
            lines = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert len(rest) == int(lines["Content-Length"]) + 4 and lines["WARC-Date"] == "2020-02-02T00:00:00Z"
            assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", lines["WARC-Record-ID"])
            ids.append(lines["WARC-Record-ID"])
            types.append(lines["WARC-Type"])
            if lines["WARC-Type"] == "revisit":
                assert lines["WARC-Refers-To-Date"] == lines["WARC-Date"]
                refers.append((int(lines["X-Page-ID"]), lines["WARC-Refers-To-Target-URI"], lines.get("WARC-Refers-To")))
    assert len(files) > 3 and len(set(ids)) == len(ids) and types.count("warcinfo") == len(files) and len(ids) == len(rows) + len(files)
    assert types.count("revisit") == 61 and all(url == ("http://big" if i == 501 else f"http://h/{i % 30}") for i, url, _ in refers)
    assert all((record is None) == (i % 30 == 3 and i < 90) and (record is None or record in ids) for i, _, record in refers)
    assert warc.read_archives(spark, str(tmp_path / "out")).where("intact or record_type = 'revisit'").count() == len(rows)


def test_only_headers_are_shuffled(spark):
    """With few revisits no exchange of the plan that writes holds a payload."""
    pages = spark.createDataFrame([(k, "u", f"text {k % 7}") for k in range(50)], PAGES)
    plan = warc.resolve(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_pages_alone_with_their_payload_stay_in_their_task(spark, monkeypatch):
    """Beyond the broadcast a filter of bounded size tells them: only pages that it lets through enter an exchange, and results are the same."""
    pages = spark.createDataFrame([(k, f"u{k}", f"text {k if k % 4 else k % 40}") for k in range(2000)], PAGES)
    want = sorted(map(repr, warc.resolve(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 0)
    moved = []
    original = warc._resolved
    monkeypatch.setattr(warc, "_resolved", lambda full, found: (moved.append(full.count()), original(full, found))[1])
    for bits in (1 << 27, 64):
        monkeypatch.setattr(warc, "FILTER_BITS", bits)
        made = warc.resolve(pages)
        assert sorted(map(repr, made.collect())) == want
    repeated = 500
    assert repeated <= moved[0] < repeated + 20 and moved[1] > moved[0]


def test_filters_of_digests(spark):
    digests = spark.range(5000).select(warc.payload_digest(F.col("id").cast("string")).alias("payload_digest"))
    known = digests.limit(2500)
    made = warc.DigestFilter(known, 2500)
    found = digests.select("payload_digest", made.holds(spark, "payload_digest").alias("may")).collect()
    inside = {row["payload_digest"] for row in known.collect()}
    assert all(row["may"] for row in found if row["payload_digest"] in inside) and sum(row["may"] for row in found) < 2600


def test_broken_archives_are_refused():
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(io.BytesIO(b"junk\r\n")))
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 50\r\n\r\nshort"
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(io.BytesIO(record)))
