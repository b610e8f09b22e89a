"""Lempel-Ziv phrase fingerprints.

A document is parsed into dictionary phrases: each is the shortest piece that isn't in
the dictionary yet, and joins it. The set of phrases, hashed, is sketched by minimum
hashes; the share of equal minima estimates the likeness of two sets, which follows
that of compression. Nulls count as empty texts; a text without phrases has the
all-ones sketch and likeness 1 to another such one. Equal texts have equal sketches. Very long texts are
parsed whole, a text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, span_hashes, tasks_for

#: Minimum hashes in a sketch, 16 bits of each are kept.
MINIMA = 128
_RANDOM = np.random.default_rng(7)
_A = (_RANDOM.integers(1 << 16, 1 << 32, MINIMA, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
NONE = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)


def parse(text: str, begin: int, known: set[str], ends: list[int], stop: int | None = None) -> int:
    """Phrases from `begin`: adds them to `known` and their ends to `ends`; ends before the first phrase that passes `stop`.
    The dictionary holds every prefix of its phrases, so the longest match is sought up or down from the last one's length."""
    i, n = begin, len(text)
    stop = n if stop is None else stop
    add, append = known.add, ends.append
    j = i + 1
    while j <= n:
        phrase = text[i:j]
        if phrase in known:
            j += 1
            phrase = text[i:j]
            while j <= n and phrase in known:
                j += 1
                phrase = text[i:j]
            if j > n:
                break
        else:
            shorter = text[i : j - 1]
            while shorter and shorter not in known:
                phrase = shorter
                j -= 1
                shorter = text[i : j - 1]
        if j > stop:
            return i
        add(phrase)
        append(j)
        j, i = j + j - i, j
    while i < n:  # the rest is short, or known
        j = i + 1
        while j <= n and text[i:j] in known:
            j += 1
        j = min(j, n)
        if j > stop:
            return i
        add(text[i:j])
        append(j)
        i = j
    return i


def minima(text: str, begin: int, ends: list[int]) -> np.ndarray:
    """Minimum hashes of the phrases that lie end to end from `begin`."""
    if not ends:
        return NONE
    codes = np.frombuffer(text[begin : ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.array(ends, np.int64) - begin
    h = (span_hashes(codes, np.concatenate([[0], stops[:-1]]), stops) >> np.uint64(32)).astype(np.uint32)
    out = NONE
    for i in range(0, len(h), 1024):
        out = np.minimum(out, (h[None, i : i + 1024] * _A).min(axis=1))
    return out


@dataclass(slots=True)
class Parsed:
    text: str
    cut: int  # where the parts that all versions share end
    known: set
    head: np.ndarray
    sketch: np.ndarray


def parsed(text: str, share: int | None = None) -> Parsed:
    """The sketch of a text; `share`: code points that an edited version will have in common, which are parsed once."""
    known: set[str] = set()
    ends: list[int] = []
    cut = parse(text, 0, known, ends, share)
    head = minima(text, 0, ends)
    if cut == len(text):
        return Parsed(text, cut, known, head, head)
    tail: list[int] = []
    parse(text, cut, set(known), tail)
    return Parsed(text, cut, known, head, np.minimum(head, minima(text, cut, tail)))


def edited_sketch(p: Parsed, edited: str) -> np.ndarray:
    """The sketch of a text that equals p's up to p.cut at least; p's dictionary is used up."""
    tail: list[int] = []
    parse(edited, p.cut, p.known, tail)
    return np.minimum(p.head, minima(edited, p.cut, tail))


def pack_sketch(sketch: np.ndarray) -> str:
    return (sketch & np.uint32(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima, over the bits that a packed sketch keeps."""
    return float(((a ^ b) & np.uint32(0xFFFF) == 0).mean())


def unpack_sketch(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint32)


def fingerprint(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """df with lz_fingerprint string; one narrow pass."""
    kept = [c for c in df.columns if c != "lz_fingerprint"]
    source = df.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pack_sketch(parsed(t or "").sketch) for t in batch.column(text_col).to_pylist()], pa.string())], names=[*kept, "lz_fingerprint"])

    return source.mapInArrow(run, df.select(*source.columns).schema.add("lz_fingerprint", "string"))


def compare_neighbours(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against an edited version of itself and against its neighbour, by descending id (last: nulls; then the first again).

    The edited version has its last third replaced by as many code points (or all) of the next document. Documents are dealt by
    ranges of ids; the first of each range is also lent to the range before, so no window spans the table and texts move once.
    The driver learns one id for each range. Rows with equal ids follow by the hash of the text. Ids are whole numbers, else TypeError."""
    ident = df.schema[id_col].dataType
    if not isinstance(ident, T.IntegralType):
        raise TypeError(f"{id_col} must be of whole numbers, not {ident.simpleString()}")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType().add(id_col, ident).add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")
    parts = tasks_for(df)
    share = 4 * parts
    quantiles = rows.agg(F.percentile_approx("id", [i / share for i in range(1, share)], 100 * share)).first()[0] or []
    cuts = np.array(sorted(set(quantiles)), np.int64)

    @F.arrow_udf(T.IntegerType())
    def deal(ids: pa.Array) -> pa.Array:
        # descending: range 0 has the largest ids; nulls come last
        at = len(cuts) - np.searchsorted(cuts, np.asarray(ids.fill_null(0)), side="left")
        return pa.array(np.where(np.asarray(ids.is_null()), len(cuts) + 1, at).astype(np.int32))

    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("range", deal("id"))
    first = {r[0]: (r[1]["id"], r[1]["h"]) for r in rows.groupBy("range").agg(F.max(F.struct("id", "h"))).collect()}
    order = sorted(first)
    lend = {first[r]: order[i - 1] for i, r in enumerate(order)}
    if not order:
        return df.sparkSession.createDataFrame([], schema)

    @F.arrow_udf(T.IntegerType())
    def lent_to(ids: pa.Array, hs: pa.Array) -> pa.Array:
        return pa.array([lend.get(x) for x in zip(ids.to_pylist(), hs.to_pylist(), strict=True)], pa.int32())

    copies = F.filter(F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("lent")), F.struct(F.col("to").alias("r"), F.lit(True).alias("lent"))), lambda x: x["r"].isNotNull())
    dealt = rows.withColumn("to", lent_to("id", "h")).select("id", "h", "text", F.explode(copies).alias("c")).select("id", "h", "text", "c.r", "c.lent")
    dealt = dealt.repartition(parts, "r").sortWithinPartitions("r", "lent", F.desc_nulls_last("id"), F.desc("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: tuple | None = None
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, text, r, lent in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "r", "lent")), strict=True):
                    if lent and (held is None or held[0] != r):
                        continue  # a copy of the lent row
                    third = len(text) // 3
                    now = parsed(text, len(text) - third) if third else parsed(text)
                    if held is not None and held[0] == r:
                        out.append(_row(held[1], held[2], now))
                        held = None
                    if not lent:
                        held = (r, doc, now)
                if len(out) >= 1000:
                    yield _table(out, schema)
                    out = []
        if out:
            yield _table(out, schema)

    return dealt.mapInArrow(run, schema)


def _row(doc, p: Parsed, after: Parsed) -> tuple:
    n = len(p.text)
    third = n // 3
    edited = p.text[: n - third] + after.text[:third]
    sketch = edited_sketch(p, edited) if third else p.sketch
    return doc, n, hashlib.sha256(edited.encode()).hexdigest(), pack_sketch(p.sketch), pack_sketch(sketch), likeness(p.sketch, sketch), likeness(p.sketch, after.sketch)


def _table(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), wanted, strict=True)], schema=wanted)
