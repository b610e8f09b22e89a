"""Substring dedup by content-defined chunking.

A gear rolling hash over the bytes cuts texts where the hash of the last 16 bytes says so, and only after white space; where it says so nowhere
in the greatest size (in periodic texts, say), the place of the largest hash is cut. So an insertion moves the cuts near it and no others. Chunks are
deduplicated by digest: the occurrence of the smallest id, text hash and place stays, others are extra. Extra
chunks that lie end to end are runs. A run's ends are then moved outwards, byte by byte, as far as its text and the one where the chunk stays agree (512 bytes at most, which
is several chunks) and back to whole words, so a passage is found with its edges however the cuts fell (of a passage that repeats
within itself, up to a chunk may stay at either end). Runs that meet are one span; spans of
`min_words` words or more count.

Nulls and empty texts have no chunks; shorter repeats stay. Rows that repeat an id and text are one
document: they keep or lose the same spans. Texts that are all repeats become empty, rows never go. Very long texts are chunked like others; the runs of one text meet in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from .common import SPACE, Tables, slices, text_bytes, unused

_GEAR = np.random.default_rng(11).integers(0, 1 << 16, 256, np.uint16)
LEAST, MOST = 24, 96
#: Bytes on either side of a run that are compared.
_AROUND = 512


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + G[byte] of 16 bits after each byte, so over the last 16 bytes, by doubling the span."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint16(k)
        h = longer
    return h


def cuts(raw: np.ndarray, offsets: np.ndarray, bits: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of all chunks of the texts raw[offsets[i]:offsets[i + 1]]; begin and end count from the text's first byte."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    after_space = SPACE[raw]
    after_space[:-1] &= ~SPACE[raw[1:]]
    hashes = gear(raw)
    places = np.flatnonzero(after_space & (hashes >> np.uint16(16 - bits) == 0)) + 1
    first = np.searchsorted(places, offsets[:-1], side="right").tolist()
    last = np.searchsorted(places, offsets[1:], side="left").tolist()
    every = places.tolist()
    texts, begins, ends = [], [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at, count = a, len(begins)
        for p in [*every[first[i] : last[i]], b]:
            while p - at > MOST:
                low = at + LEAST - 1
                able = after_space[low : at + MOST]
                if not able.any():
                    able = raw[low + 1 : at + MOST + 1] & 0xC0 != 0x80  # at a character
                rank = np.where(able, hashes[low : at + MOST].astype(np.int32), -1)[::-1]
                cut = at + MOST - int(rank.argmax())
                begins.append(at - a)
                ends.append(cut - a)
                at = cut
            if p - at >= LEAST or p == b and p > at:
                begins.append(at - a)
                ends.append(p - a)
                at = p
        texts += [i] * (len(begins) - count)
    return np.array(texts, np.int64), np.array(begins, np.int64), np.array(ends, np.int64)


def chunks(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """(id, text_hash, digest, begin, size) of all chunks; bytes."""
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    schema = source.drop("text").schema.add("digest", "long").add("begin", "long").add("size", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, offsets = text_bytes(batch.column("text"))
                text, begin, end = cuts(raw, offsets, bits)
                data, base = raw.tobytes(), offsets[text]
                digests = np.array([digest(data[a:b]) for a, b in zip((begin + base).tolist(), (end + base).tolist(), strict=True)], np.uint64).view(np.int64)
                which = pa.array(text)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(which), batch.column("text_hash").take(which), pa.array(digests), pa.array(begin), pa.array(end - begin)], names=schema.names)

    return source.mapInArrow(run, schema)


def _kept_words(own: bytes, other: bytes, left: bool) -> int:
    """Bytes at the end (left) or the beginning of own that other has as well, back to whole words of own. Texts end words."""
    n = min(len(own), len(other))
    a, b = (np.frombuffer(x, np.uint8)[len(x) - n :][::-1] if left else np.frombuffer(x, np.uint8)[:n] for x in (own, other))
    apart = np.flatnonzero(a != b)
    n = int(apart[0]) if len(apart) else n
    edge = np.frombuffer(own, np.uint8)[::-1] if left else np.frombuffer(own, np.uint8)
    # a whole word goes up to white space, which may lie just beyond
    while n and n < len(edge) and not SPACE[edge[n]] and not SPACE[edge[n - 1]]:
        n -= 1
    while left and n and SPACE[edge[n - 1]]:  # the white space before a span stays
        n -= 1
    return n


def _starts(text: bytes) -> np.ndarray:
    """Where the words of a text begin."""
    solid = ~SPACE[np.frombuffer(text, np.uint8)]
    solid[1:] &= ~solid[:-1].copy()
    return np.flatnonzero(solid)


def _with_surroundings(runs: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: runs (run: their columns, own contexts and the words before their ends) and places asked for (at, left, context)."""
    own = runs.select("id", "text_hash", F.struct("begin", "end", "n_chunks", "left", "right").alias("run"), F.lit(None).cast("struct<at:bigint,left:boolean>").alias("ask"))
    asked = runs.select(F.explode(F.array(F.struct(F.col("left.*"), F.lit(True).alias("side")), F.struct(F.col("right.*"), F.lit(False).alias("side")))).alias("p")).select("p.*").distinct()
    asked = asked.select("id", "text_hash", F.lit(None).cast(own.schema["run"].dataType).alias("run"), F.struct("at", F.col("side").alias("left")).alias("ask"))
    wanted = own.unionByName(asked).groupBy("id", "text_hash").agg(F.collect_list("run").alias("runs"), F.collect_list("ask").alias("asks"))
    source = df.select(F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text"))
    both = source.join(wanted, source["i"].eqNullSafe(wanted["id"]) & (source["h"] == wanted["text_hash"])).select("id", "text_hash", "runs", "asks", "text")
    kind = runs.select("id", "text_hash", "begin", "end", "n_chunks", "left", "right").schema.add("first_word", "long").add("last_word", "long").add("at", "long").add("is_left", "boolean").add("before", "binary").add("after", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = {f.name: f.type for f in to_arrow_schema(kind)}
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, out = [], []
                for i, (runs_, asks, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("runs", "asks", "text")), strict=True)):
                    data = text.encode()
                    starts = _starts(data)
                    for r in runs_:
                        b, e = r["begin"], r["end"]
                        first, last = np.searchsorted(starts, (b, e)).tolist()
                        out.append((b, e, r["n_chunks"], r["left"], r["right"], first, last, None, None, data[max(0, b - _AROUND) : b], data[e : e + _AROUND]))
                    for x in asks:
                        at = x["at"]
                        out.append((None, None, None, None, None, None, None, at, x["left"], data[max(0, at - _AROUND) : at] if x["left"] else None, None if x["left"] else data[at : at + _AROUND]))
                    rows += [i] * (len(runs_) + len(asks))
                which = pa.array(rows, pa.int64())
                columns = zip(list(wide)[2:], zip(*out, strict=True), strict=True) if out else ((n, []) for n in list(wide)[2:])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(which) for c in ("id", "text_hash")], *[pa.array(c, wide[n]) for n, c in columns]], names=list(wide))

    return both.mapInArrow(run, kind)


def repeated_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, bits: int = 2) -> DataFrame:
    """Spans that repeat what stands elsewhere: id, text_hash, begin, end (bytes), n_chunks, n_words, first_id (where the first chunk stays).

    Two shuffles of chunks (digest, place): one, partially aggregated, finds the digests that repeat; the other joins them back, where a
    very common digest is split as a skewed join. Only extra chunks are then gathered by document, and only the texts with runs are read again, for what surrounds those."""
    tables = Tables(df.sparkSession, "chunks")
    every = chunks(df, id_col=id_col, text_col=text_col, bits=bits)
    place = F.struct("id", "text_hash", "begin")
    several = every.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("digest", "first")
    several = tables.put(several, "several")
    extra = every.join(several, "digest").where(~place.eqNullSafe(F.col("first")))
    size = F.col("size")
    extra = extra.select("id", "text_hash", "begin", (F.col("begin") + size).alias("end"), *[F.struct(F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"), at.alias("at")).alias(n) for n, at in (("left", F.col("first.begin")), ("right", F.col("first.begin") + size))])
    order = W.partitionBy("id", "text_hash").orderBy("begin")
    extra = extra.withColumn("opens", (F.col("begin") > F.coalesce(F.lag("end").over(order), F.lit(-1))).cast("int")).withColumn("again", F.coalesce(F.col("begin") == F.lag("begin").over(order), F.lit(False)))
    extra = extra.withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = extra.groupBy("id", "text_hash", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count_if(~F.col("again")).alias("n_chunks"), F.min_by("left", "begin").alias("left"), F.max_by("right", "end").alias("right"))
    runs = tables.put(runs.drop("run"), "runs")
    seen = tables.put(_with_surroundings(runs, df, id_col, text_col), "surroundings")
    asked = seen.where("at is not null").dropDuplicates(["id", "text_hash", "at", "is_left"])
    asked = tables.put(asked.select("id", "text_hash", "at", "is_left", "before", "after"), "asked")
    own = seen.where("at is null").drop("at", "is_left").dropDuplicates(["id", "text_hash", "begin"])
    for side, name, context in (("left", "other_before", "before"), ("right", "other_after", "after")):
        other = asked.where(F.col("is_left") == (side == "left")).select(F.struct("id", "text_hash", "at").alias("of"), F.col(context).alias(name))
        other = other.select(F.xxhash64("of").alias(f"k_{side}"), "of", name)
        own = own.withColumn(f"k_{side}", F.xxhash64(side))
        own = own.join(other, f"k_{side}").where(F.col("of").eqNullSafe(F.col(side))).drop("of", f"k_{side}")

    @F.arrow_udf("before long, after long, words_before long, words_after long")
    def grown(before: pa.Array, after: pa.Array, other_before: pa.Array, other_after: pa.Array) -> pa.Array:
        out = []
        for a, b, x, y in zip(*(c.to_pylist() for c in (before, after, other_before, other_after)), strict=True):
            n, m = _kept_words(a, x, True), _kept_words(b, y, False)
            # a word that goes on from the context into the run, or from the run into what follows, has begun before
            out.append((n, m, len(_starts(a[len(a) - n :])), int((_starts(b"x" + b[:m]) > 0).sum())))
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4, names=["before", "after", "words_before", "words_after"])

    own = own.withColumn("g", grown("before", "after", "other_before", "other_after"))
    spans = own.select(
        "id", "text_hash", (F.col("begin") - F.col("g.before")).alias("begin"), (F.col("end") + F.col("g.after")).alias("end"), "n_chunks", F.col("left.id").alias("first_id"),
        (F.col("first_word") - F.col("g.words_before")).alias("first_word"), (F.col("last_word") + F.col("g.words_after")).alias("last_word"),
    )
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("opens", (F.col("begin") > F.coalesce(reach, F.lit(-1))).cast("int")).withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy("id", "text_hash", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("n_chunks").alias("n_chunks"), (F.max("last_word") - F.min("first_word")).alias("n_words"), F.min_by("first_id", "begin").alias("first_id"))
    return spans.where(F.col("n_words") >= min_words).drop("run")


def without(text: str | None, spans: list[tuple[int, int]] | None) -> str | None:
    """The text without the byte spans."""
    if not spans or not text:
        return text
    data, at, out = text.encode(), 0, []
    for a, b in sorted(spans):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, bits: int = 2) -> DataFrame:
    """df with the repeated spans cut out of the texts; all rows and columns stay."""
    mark, cut, own, of = unused(df.columns, "hash", "spans", "id", "of")
    spans = repeated_spans(df, id_col=id_col, text_col=text_col, min_words=min_words, bits=bits).groupBy("id", "text_hash").agg(F.collect_list(F.struct("begin", "end")).alias(cut))
    spans = spans.select(F.col("id").alias(own), F.col("text_hash").alias(of), cut)
    hashed = df.withColumn(mark, F.xxhash64(F.col(f"`{text_col}`")))
    both = hashed.join(spans, hashed[id_col].eqNullSafe(spans[own]) & (hashed[mark] == spans[of]), "left").select(*[F.col(f"`{c}`") for c in df.columns], cut)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                texts, lists = batch.column(text_col), batch.column(cut)
                if lists.null_count < len(lists):
                    texts = pa.array([without(t, s and [(x["begin"], x["end"]) for x in s]) for t, s in zip(texts.to_pylist(), lists.to_pylist(), strict=True)], texts.type)
                yield pa.RecordBatch.from_arrays([texts if c == text_col else batch.column(c) for c in names], names=names)

    return both.mapInArrow(run, df.schema)
