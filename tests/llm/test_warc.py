"""WARC archives and their index: round trips, searches against a plain list, edge rows."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from webmetrics.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, file string, offset string, salt string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, *["x"] * 4) for i, u, h in rows], SCHEMA)


def expected(rows):
    held = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if len(body) >= 100 and i is not None:
            held[body] = min(i, held.get(body, i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        refers = held.get(body)
        refers = None if refers == i else refers
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


LONG = "<p>é</p>" * 20
ROWS = [
    (7, "http://a.example/x", LONG), (3, "https://b.example/y?q=1#f", LONG), (9, None, LONG), (None, "http://a.example/z", LONG),
    (4, "http://a.example/x", "short"), (5, "http://a.example/x", "short"), (6, "no url at all\n\there", None), (8, "", ""),
    (10, "HTTP://user@Sub.A.Example:80/p\r\nX: y", "x" * 99), (11, "http://é.example/ü", "x" * 99), (12, "http://a.example/x", "y" * 100),
    (13, "http://a.example/x", "y" * 2_000_000), (14, "http://a.example/x", "\r\n\r\n" * 40), (15, None, "\r\n\r\n" * 40),
    (None, None, "z" * 200), (None, None, "z" * 200), (16, "u", "w" * 150), (16, "u", "w" * 150),
]


def test_round_trip(spark):
    assert found(warc.round_trip(pages(spark, ROWS).repartition(4))) == expected(ROWS)


def test_no_rows(spark):
    assert warc.round_trip(pages(spark, ROWS).where("page_id < 0")).count() == 0


def test_a_hot_payload_and_small_blocks(spark, monkeypatch):
    """Thousands of copies, one URL over many blocks, several archives."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = [(k, f"http://h{k % 3}.example/{'same' if k % 2 else k}", LONG if k % 3 else f"{k} {LONG}") for k in range(2000)]
    assert found(warc.round_trip(pages(spark, rows))) == expected(rows)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    df = pages(spark, ROWS)
    captures = warc.write_archives(df, f"{folder}/archives")
    return df, captures, warc.write_index(captures, f"{folder}/archives", f"{folder}/index"), folder


def test_search_by_url(spark, archive):
    df, _, index, _ = archive
    lookups = spark.createDataFrame([("http://a.example/x",), ("http://a.example/",), ("http://zzz",), ("no url at all\n\there",)], "url string")
    places = warc.locate(lookups.select(warc.url_key(F.col("url")).alias("key")), index, "key")
    ids = sorted(r["page_id"] for r in warc.read_captures(places, index.archives).collect())
    assert ids == [4, 5, 6, 7, 12, 13, 14]  # prefixes of a key find nothing


def test_payloads_are_whole(spark, archive):
    _, captures, index, _ = archive
    read = warc.read_captures(captures, index.archives, payloads=True).collect()
    assert len(read) == len(ROWS)
    bodies = {(r["page_id"], bytes(r["payload"])) for r in read if r["record_type"] == "response"}
    assert bodies == {(i, (h or "").encode()) for i, _, h in ROWS if (i, h) not in [(7, LONG), (9, LONG), (None, LONG), (15, "\r\n\r\n" * 40)]}


def test_archives_are_plain_gzip(archive, tmp_path):
    """Any reader of gzip sees the records one after the other, in the form of the standard."""
    import pathlib

    files = list(pathlib.Path(archive[3], "archives").glob("*.warc.gz"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: re") == len(ROWS)
    assert b"WARC-Target-URI: HTTP://user@Sub.A.Example:80/p%0D%0AX: y\r\n" in text


@pytest.mark.parametrize("url, key", [
    ("https://www.Example.org/a?b=c#d", "org,example,www)/a?b=c"), ("http://x", "x)"), ("http://u:p@h.example:8080/", "example,h:8080)/"),
    ("mailto:x", "mailto:x"), (None, ""), ("a b\tc", "a%20b%20c"),
])
def test_keys(spark, url, key):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(warc.url_key(F.col("url"))).first()[0] == key
