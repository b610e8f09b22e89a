"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import sys
from pathlib import Path

import pytest

from codeweave.llm import bpe, decontaminate, html_text, lm, lz, quality, sharding, simhash, substrings, warc
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, component string, score double, log_weight double, n_tokens string, cosine string"
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and looked at the dog in the garden"), (2, None), (3, ""), (4, LONG), (4, LONG), (None, "no id at all"), (5, "the cat sat on the mat and looked at the dog in the garden"), (6, " \t\n "), (7, "x" * 100_000), (8, "Ünï çødé 漢字 🙂 text"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 9, "c", 0.5, 0.1, "n", "k") for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "cat sat on the mat and looked at the dog"), (2, None), (3, "")], "item_id long, text string")


def pages(spark, df):
    return df.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))


def test_each_runs(spark, odd, empty, labels, benchmark):
    rank, n = P.path("byte_bpe_50k.tiktoken"), len(ROWS)
    runs = {
        "shard": (lambda d: sharding.shard(d, 4, key=F.xxhash64("text"), size=F.octet_length("text")), n), "quality": (lambda d: quality.resample(d, labels), n), "chunks": (lambda d: substrings.remove_repeats(d), n), "lz": (lambda d: lz.compare_neighbours(d), n),
        "simhash": (lambda d: simhash.near_duplicates(d), n), "html": (lambda d: html_text.extract(pages(spark, d)), n), "bpe": (lambda d: bpe.decode(bpe.encode(d, rank, P.PATTERN), rank, P.PATTERN), n), "leaks": (lambda d: decontaminate.contamination(d, benchmark), 2),
        "lm": (lambda d: lm.score(d), n), "warc": (lambda d: warc.derive(warc.from_pages(pages(spark, d))), 2 * n),
    }
    for name, (f, rows) in runs.items():
        assert len(f(odd).collect()) == rows, name
        assert f(empty).count() == 0, name


def test_own_names_may_clash(spark, labels, benchmark):
    names = ["__text", "__hash", "__key", "__html", "__spans", "__payload", "__id", "__n", "__found", "__mark"]
    docs = spark.createDataFrame([(i, f"some words of text number {i} cat sat on the mat and looked at the dog", *["mine"] * len(names)) for i in range(6)], ["doc_id", "text", *names])
    as_pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *names)
    rank = P.path("byte_bpe_50k.tiktoken")
    runs = {
        "shard": sharding.shard(docs, 2, key=F.col("text"), size=F.octet_length("text")), "quality": quality.keep_sample(docs, labels), "weigh": quality.weigh(docs, labels, keep=names), "chunks": substrings.remove_repeats(docs),
        "simhash": simhash.keep_first(docs), "shingles": simhash.keep_first(docs, words=5, similarity=0.8), "near": simhash.near_duplicates(docs, keep=names), "html": html_text.extract(as_pages), "bpe": bpe.encode(docs, rank, P.PATTERN),
        "leaks": decontaminate.contamination(docs, benchmark, keep=names), "clean": decontaminate.drop_contaminated(docs, benchmark), "lm": lm.score(docs, keep=names), "warc": warc.derive(warc.from_pages(as_pages), keep=names), "lz": lz.fingerprint(docs),
    }
    for name, out in runs.items():
        assert all(r[c] == "mine" for r in out.collect() for c in names), name


def test_stages(spark, odd, empty, labels, benchmark, tmp_path):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "tokenize":
                assert out.columns == docs.columns, name
            assert out.count() <= docs.count(), name
    kept = corpus_pipeline.near_dedup(spark, odd, str(tmp_path)).select("doc_id").collect()
    assert sorted(str(r[0]) for r in kept) == ["1", "2", "4", "7", "8", "None"]  # of 2, 3, 6 without words the first


def test_shards(spark, odd):
    out = sharding.shard(odd, 3, key=F.lit(1), size=F.octet_length("text")).collect()
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_bytes_near_equal_with_a_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (100 + F.col("id") % 50).alias("b"))
    sums = [r[1] for r in sharding.shard(df, 8, key=F.col("k"), size=F.col("b")).groupBy("shard").agg(F.sum("b")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) < 0.02 * max(sums)


def test_bpe_is_exact(spark, odd):
    import base64

    import tiktoken

    rank = P.path("byte_bpe_50k.tiktoken")
    with open(rank, "rb") as f:
        plain = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    for r in bpe.encode(odd.select("doc_id", "text", F.col("text").alias("kept")), rank, P.PATTERN, decode=True, cut=50).collect():
        ids = plain.encode_ordinary(r.kept or "")
        assert r.n_tokens == len(ids) and bytes(r.token_ids) == b"".join(i.to_bytes(4, "little") for i in ids) and bytes(r.decoded).decode() == (r.kept or "")


def test_lz_edits(spark):
    docs = spark.createDataFrame([(i, f"document {i} says " + "abc def "[: 3 + i] * (5 * i)) for i in range(40)], "doc_id long, text string")
    texts = {r[0]: r[1] for r in docs.collect()}
    for r in lz.compare_neighbours(docs).collect():
        after, mine = texts[(r.doc_id - 1) % 40], texts[r.doc_id]
        k = len(mine) // 3
        edited = mine[: len(mine) - k] + after[:k]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(mine)
        assert r.fingerprint == lz.pack_sketch(lz.parsed(mine).sketch) and r.edited_fingerprint == lz.pack_sketch(lz.parsed(edited).sketch)
        assert r.near_next == lz.likeness(lz.unpack_sketch(r.fingerprint), lz.parsed(after).sketch)
