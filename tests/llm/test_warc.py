import base64
import hashlib

import pytest
import zstandard

from reviewmill.llm import warc
from tests.llm import frames

PAGES = [
    (3, "http://a/3", "<p>same</p>"), (1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (4, "http://a/4", None),
    (5, "bad\r\nurl", ""), (6, "http://a/6", "x" * 200_000), (7, "http://ä/7", "Grüße\r\n\r\n日本"), (1, "http://a/1", "<p>same</p>"),
    (None, "http://a/none", "<p>same</p>"), (None, "http://a/own", "<p>only</p>"),
]


def round_trip(spark, rows, **options):
    pages = frames.with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).drop("url_")
    return warc.read_archives(warc.write_archives(pages, warc.archive_folder(spark), **options)).collect()


@pytest.fixture(autouse=True)
def own_columns(monkeypatch):
    monkeypatch.setattr(frames, "CLASHING", [c for c in frames.CLASHING if c != "url"])


@pytest.mark.parametrize("options", [{}, {"roll_bytes": 1}, {"min_bytes": 5}])
def test_round_trip(spark, options):
    got = round_trip(spark, PAGES, **options)
    least = options.get("min_bytes", 0)
    wanted = []
    for key, _, html in PAGES:
        payload = (html or "").encode()
        first = min((k for k, _, h in PAGES if (h or "") == (html or "") and k is not None), default=None)
        revisit = len(payload) >= least and first is not None and first != key
        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        wanted.append((key, len(payload), sha1, "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(wanted, key=repr)
    assert all(r.error is None for r in got)
    assert all(r.payload == next((h or "").encode() for k, _, h in PAGES if k == r.page_id) for r in got if r.record_type == "response" and r.page_id)
    if options.get("roll_bytes"):
        assert len({r.archive for r in got}) == len(PAGES)


def test_dictionary_is_used(spark):
    rows = [(i, f"http://a/{i}", f"<html><body><p>page {i * 7919 % 1000}</p><footer>all the same text here</footer></body></html>" * 3) for i in range(400)]
    got = round_trip(spark, rows)
    assert len(got) == 400 and not any(r.error for r in got)
    with open(got[0].archive.removeprefix("file://"), "rb") as stream:
        assert next(warc.frames(stream))[0] == warc.DICTIONARY_MAGIC


def test_empty_table(spark):
    assert round_trip(spark, []) == []


def record(n=5):
    return warc.record(n, "http://x", b"payload", False, None, "2024-01-01T00:00:00Z")


def read(tmp_path, data):
    path = tmp_path / "a.warc.zst"
    path.write_bytes(data)
    return list(warc.records_of(f"file://{path}"))


def test_broken_records_and_frames(tmp_path):
    press = zstandard.ZstdCompressor().compress
    good = press(record())
    wrong = [
        record().replace(b"Content-Length: 7\r\n", b"Content-Length: 8\r\n"), record().replace(b"payload\r\n", b"payloaf\r\n"), record()[:-3],
        b"nothing", record().replace(b"WARC-Date", b"X-Date"), record().replace(b"WARC/1.1", b"HTTP/1.1"),
    ]
    rows = read(tmp_path, good + b"".join(map(press, wrong)) + good)
    assert [bool(r.get("error")) for r in rows] == [False] + [True] * len(wrong) + [False]
    assert read(tmp_path, good + good[:-5])[-1]["error"] == "archive ends within a frame"
    assert "no frame" in read(tmp_path, good + b"plain text")[-1]["error"]
    assert read(tmp_path, b"") == []


def test_raw_and_packed_dictionaries_and_other_frames(tmp_path):
    known = warc.train([f"<html>{i * 7919 % 1000} some words {i}</html>".encode() * 4 for i in range(300)])
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(known), write_content_size=False).compress(record())
    raw = warc.struct.pack("<II", warc.DICTIONARY_MAGIC, len(known)) + known
    other = warc.struct.pack("<II", 0x184D2A50, 3) + b"abc"
    for start in (raw, warc.leading_frame(known)):
        assert [r["payload"] for r in read(tmp_path, start + frame + other + frame)] == [b"payload"] * 2
    assert all("decoded" in r["error"] for r in read(tmp_path, frame))


def test_listing_a_folder(spark, tmp_path):
    (tmp_path / "x.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(record(9)))
    found = warc.read_archives(warc.list_archives(spark, str(tmp_path))).collect()
    assert [r.page_id for r in found] == [9]


def test_schemes_that_spark_and_pyarrow_name_differently():
    assert warc.arrow_uri("s3a://bucket/a/b") == "s3://bucket/a/b" and warc.arrow_uri("dbfs:/a/b") == "file:///dbfs/a/b"
    for uri in ("file:///a/b", "hdfs://host/a", "gs://bucket/a", "/plain/path"):
        assert warc.arrow_uri(uri) == uri
    assert warc.open_uri("dbfs:/a/b")[1] == "/dbfs/a/b"
    assert warc.open_uri("s3a://bucket/a/b?region=us-east-1")[1] == "bucket/a/b"
