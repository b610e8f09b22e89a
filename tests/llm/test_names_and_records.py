"""Columns whose names differ from the operators' in case, and records with encodings, charsets and digests of all kinds."""

import base64
import gzip
import hashlib
import zlib

import pytest
from codeweave.llm import html_text, lm, sharding, simhash, warc
from pyspark.sql import functions as F


def test_names_that_differ_in_case(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i} and more of them", "mine", 1.0) for i in range(6)], "doc_id long, text string, Component string, Score double")
    assert simhash.near_duplicates(docs, keep=["Component"]).columns == ["doc_id", "simhash", "component"]
    assert [c.lower() for c in lm.score(docs, keep=["Score"]).columns].count("score") == 1
    odd = docs.select("doc_id", "text", F.lit(1).alias("Shard"), F.col("text").alias("Main_Text"))
    assert [c.lower() for c in sharding.shard(odd, 2, key=F.col("text"), size=F.octet_length("text")).columns].count("shard") == 1
    pages = odd.select("doc_id", F.col("text").alias("html"), "Main_Text")
    assert [c.lower() for c in html_text.extract(pages).columns].count("main_text") == 1


PAGE = "<p>Ein Satz über Öl.</p>"


def one(payload, http="HTTP/1.1 200 OK\r\nContent-Type: text/html", declared=None):
    meta, text = warc.derive_one("<r>", "http://a", "d", http, payload, declared)
    return meta[7], text[10]


def test_digests_by_their_own_algorithm():
    data = PAGE.encode()
    for name in ("md5", "sha1", "sha256", "sha512"):
        made = hashlib.new(name, data).digest()
        assert one(data, declared=f"{name}:{made.hex()}")[0] is True
        assert one(data, declared=f"{name}:{base64.b32encode(made).decode()}")[0] is True
        assert one(data + b"x", declared=f"{name}:{made.hex()}")[0] is False
    assert one(data, declared="blake9:abc")[0] is None and one(data)[0] is True
    chunked = b"5\r\n" + data[:5] + b"\r\n" + f"{len(data) - 5:x}".encode() + b"\r\n" + data[5:] + b"\r\n0\r\n\r\n"
    assert one(chunked, "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked", warc.digest(data)) == (True, "Ein Satz über Öl.")


@pytest.mark.parametrize("payload,headers", [
    (PAGE.encode("iso-8859-1"), "Content-Type: text/html; charset=iso-8859-1"), (('<meta charset="windows-1252">' + PAGE).encode("cp1252"), "Content-Type: text/html"), (gzip.compress(PAGE.encode()), "Content-Encoding: gzip"),
    (zlib.compress(PAGE.encode()), "Content-Encoding: deflate"), (PAGE.encode(), "Content-Type: text/html; charset=no-such-charset"), (PAGE.encode(), ""),
])
def test_texts_by_their_encoding(payload, headers):
    assert one(payload, f"HTTP/1.1 200 OK\r\n{headers}")[1] == "Ein Satz über Öl."


def test_damaged_tails_end_the_records():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    whole = gzip.compress(record) + gzip.compress(record)
    assert [b for _, b in warc.parse_warc(whole)] == [b"abc", b"abc"]
    assert [b for _, b in warc.parse_warc(whole[: len(gzip.compress(record)) + 12])][0] == b"abc"
    assert list(warc.parse_warc(b"\x1f\x8b\x08broken")) == []


def test_only_responses_are_derived(spark):
    rows = [("response", "<1>", b"<p>x</p>"), ("request", "<2>", b"GET"), ("metadata", "<3>", b"a: b"), (None, "<4>", b"<p>y</p>")]
    df = spark.createDataFrame(rows, "record_type string, record_id string, payload binary")
    assert sorted(r.refers_to for r in warc.derive(df).collect()) == ["<1>", "<1>", "<4>", "<4>"]
