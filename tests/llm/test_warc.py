"""Archives: written, read back, and read past magic lines in payloads."""

import base64
import hashlib

import pytest

from marketgrade.llm import warc

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def expected(rows, least=0):
    """Per row: id, bytes, digest, type, refers_to."""
    first = {}
    for key, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and key is not None:
            first[data] = min(key, first.get(data, key))
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        other = first.get(data, key)
        again = key is not None and other != key
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", other if again else None))
    return sorted(out, key=str)


def round_trip(spark, rows, folder, **options):
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, **options)
    found = warc.read_archives(spark, folder).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str)


def test_given_pages(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html").collect()]
    assert round_trip(spark, rows, str(tmp_path / "a")) == expected(rows)


@pytest.mark.parametrize("split", ["64", "1000", "10m"])
def test_magic_lines_in_payloads(spark, tmp_path, split):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [
        (1, "http://a/", "before " + fake + " after"),
        (2, "http://b/\r\nContent-Length: 3", fake),
        (3, None, "WARC/1.1\r\n"),
        (4, "http://d/", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\n"),
        (5, "http://e/", None),
        (6, "http://f/", ""),
        (7, "http://g/", "été 你好 \U0001f600 \r\n\r\n"),
        (9, "http://h/", "before " + fake + " after"),
        (None, "http://i/", "no id"),
        (11, "http://j/", "x" * 5000 + fake * 40),
        (12, "http://k/", "plain"),
        (12, "http://k/", "plain"),
    ]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        assert round_trip(spark, rows, str(tmp_path / "a")) == expected(rows)
        assert round_trip(spark, rows, str(tmp_path / "b"), least_payload=6) == expected(rows, 6)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_splits_may_change_before_the_rows_are_read(spark, tmp_path):
    rows = [(i, "http://a/", f"page {i} WARC/1.1\r\n {i % 7} WARC/1.1\r\n" + "x" * (37 * i)) for i in range(60)]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "a"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        found = warc.read_archives(spark, str(tmp_path / "a"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        got = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_files_are_whole_records(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "<p>é</p>")], SCHEMA), str(tmp_path / "a"))
    (file,) = [p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    data = file.read_bytes()
    head, _, rest = data.partition(b"\r\n\r\n")
    size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split()[1])
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and rest[size:] == b"\r\n\r\n"
    assert rest[:size].endswith("\r\n\r\n<p>é</p>".encode())


def test_damage_ends_the_chain(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(i, "http://a/", f"page {i}") for i in range(4)], SCHEMA).coalesce(1), str(tmp_path / "a"))
    (file,) = [p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    parts = file.read_bytes().split(b"WARC/1.1\r\n")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(b"WARC/1.1\r\n".join([*parts[:3], parts[3] + b"x", *parts[4:]]))
    assert [r.page_id for r in warc.read_archives(spark, str(tmp_path / "b")).collect()] == [0, 1]


def test_no_pages_and_no_folder(spark, tmp_path):
    assert round_trip(spark, [], str(tmp_path / "a")) == []
    assert warc.read_archives(spark, str(tmp_path / "none")).collect() == []
