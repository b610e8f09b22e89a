"""Near-duplicates by the Jaccard similarity of word shingles, for similarities that a fingerprint's few bits can't tell.

Texts with the same set of shingles are one node. What the fingerprints' grid join links is held against the whole sets first. For what lies beyond
the fingerprints' reach, nodes that share a band of minimum hashes (45 bands of 6: a pair of similarity
0.8 is missed with a chance of (1 - 0.8**6)**45 = 1e-6) share a cell. All work on cells is joins and partial aggregates, so a cell is never gathered
in one task: each cell's nodes are held against one of them (a star): those whose sizes and
128 parity bits (which differ in as many places as the sets do, at most) allow it by their whole sets; links join components; cells whose nodes
are all connected are done. What is left of a small cell is compared across its components. What is left of a large
one is dealt anew by its texts' rarest shingles: of two texts that are similar enough one of the rarest 1 - similarity of either stands in both
(prefix filtering), so a passage that very many texts share doesn't bring them together. Large cells of those take more and more centres, until their
nodes are connected or all have been one. No pair of a cell is left out but those that the components or the sizes decide. After a cell's first
centre a pair only counts in the first of the cells that it shares: not where one of the few cells before (`before`) is the same, nor, among the
rarest shingles, where more shingles stand before (`at`) than two sets of that similarity differ in; in its first cell neither can be.

Words are those between white space with A-Z lower-cased; a text of fewer words than a shingle is one shingle. Nulls and
texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import LOWER, Tables, mix, slices, span_hashes, text_bytes, unused, word_bounds
from .components import components

_BANDS, _ROWS = 45, 6
_RANDOM = np.random.default_rng(5)
_FACTORS = _RANDOM.integers(0, 1 << 31, _BANDS * _ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _RANDOM.integers(0, 1 << 32, _BANDS * _ROWS, np.uint32)
_SALTS = _RANDOM.integers(0, 1 << 63, _BANDS, np.uint64)
_CHAIN = np.uint64(0x9E3779B97F4A7C15)
#: Nodes of a cell whose pairs are listed across components; more are dealt anew.
_SMALL = 32
#: Centres of a large cell in the first turn; each turn has eight times as many.
_CENTRES = 8
#: Cells before its own that a row knows.
_BEFORE = 4
#: Columns of a cell's row.
_MEMBER = ["cell", "digest", "n", "p", "q", "at", "before"]


def sets(texts: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """The sorted hashes of every text's shingles."""
    raw, offsets = text_bytes(texts)
    begin, end, first = word_bounds(raw, offsets)
    h = span_hashes(LOWER[raw], begin, end) if len(begin) else np.zeros(0, np.uint64)
    chained = h.copy()
    for k in range(1, words):
        if len(h) > k:
            chained[:-k] = mix(chained[:-k] * _CHAIN + h[k:])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(chained[a : b - words + 1])
        elif b > a:
            s = h[a : a + 1]
            for k in range(1, b - a):
                s = mix(s * _CHAIN + h[a + k : a + k + 1])
            yield s
        else:
            yield h[:0]


def minima(s: np.ndarray) -> np.ndarray:
    """The minimum of each of the 270 hash functions over a set that isn't empty."""
    least = np.full(_BANDS * _ROWS, 0xFFFFFFFF, np.uint32)
    units = (mix(s) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(s), 512):
        part = units[None, at : at + 512] * _FACTORS[:, None]
        part += _TERMS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A hash for each band of the rows of minima."""
    out = np.broadcast_to(_SALTS, (len(least), _BANDS)).copy()
    parts = mix(least.astype(np.uint64).reshape(-1, _BANDS, _ROWS))
    for i in range(_ROWS):
        out = mix(out * _CHAIN + parts[:, :, i])
    return out


def digest(s: np.ndarray) -> int:
    """64 bits of a set, as a signed number; 0 for the empty set."""
    return int(mix(s ^ _CHAIN).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0


def parity(s: np.ndarray) -> np.ndarray:
    """128 bits, each whether an odd number of the set's shingles falls on it: two sets differ in as many shingles at least as their bits differ."""
    return np.packbits(np.bincount((s & np.uint64(127)).astype(np.int64), minlength=128) & 1 == 1).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both >= similarity * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of pairs (u, v) those of at least `similarity`, by their whole sets; texts: (digest, __text). A node in very many pairs is u's part
    of a join that can be split; its set is made once for each task."""
    both = pairs.join(texts.select(F.col("digest").alias("v"), F.col("__text").alias("__b")), "v").join(texts.select(F.col("digest").alias("u"), F.col("__text").alias("__a")), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for whole in batches:
            for batch in slices(whole, "__b"):
                u, keep = batch.column("u").to_pylist(), []
                for i, (x, other) in enumerate(zip(u, sets(batch.column("__b"), words), strict=True)):
                    if x != known[0]:
                        known = (x, next(sets(batch.column("__a").slice(i, 1), words)))
                    keep.append(similar(known[1], other, similarity))
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "__a", "__b").mapInArrow(run, "u long, v long")


def _rare(members: DataFrame, texts: DataFrame, tables: Tables, words: int, similarity: float) -> DataFrame:
    """_MEMBER: the nodes again, in a cell for each of their rarest shingles, as many as two similar sets can't both avoid. Shingles are in one order for all
    nodes; at: how many of the node's come before, before: the last of these that other nodes have."""
    nodes = members.select("digest", "n", "p", "q").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                found = [s.view(np.int64) for s in sets(batch.column("__text"), words)]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(s) for s in found]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in ("digest", "n", "p", "q")], pa.array(np.concatenate(found))], names=["digest", "n", "p", "q", "cell"])

    every = nodes.join(texts, "digest").select("digest", "n", "p", "q", "__text").mapInArrow(run, "digest long, n long, p long, q long, cell long")
    every = tables.put(every, "every")
    counts = tables.put(every.groupBy("cell").agg(F.count("*").alias("df")), "counts")
    order = F.row_number().over(W.partitionBy("digest").orderBy("df", "cell"))
    prefix = every.join(counts, "cell").withColumn("r", order).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1)
    last = F.collect_list("cell").over(W.partitionBy("digest").orderBy("r").rowsBetween(-_BEFORE, -1))
    return prefix.where("df > 1").withColumns({"at": F.col("r") - 1, "before": last}).select(*_MEMBER)


def _candidates(now: DataFrame, similarity: float, stars: bool) -> DataFrame:
    """(digest, d, ...): the rows of now (_MEMBER, label, centre) with the centres of their cells, as far as labels and sizes allow. Unless they are `stars` (a cell's first
    centre is its own, so the star around it takes all cells) a pair counts in few cells, and in the first that it shares in any case."""
    apart = (F.col("n") + F.col("m")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    able = F.bit_count(F.col("p").bitwiseXOR(F.col("r"))) + F.bit_count(F.col("q").bitwiseXOR(F.col("s"))) <= apart
    if not stars:
        able = able & (F.col("at") + F.col("o") <= apart) & ~F.arrays_overlap("before", "b")
    names = {"digest": "d", "n": "m", "p": "r", "q": "s", "at": "o", "before": "b", "label": "l"}
    middle = now.where("centre").select("cell", *[F.col(c).alias(x) for c, x in names.items()])
    return now.join(middle, "cell").where((F.col("label") != F.col("l")) & (F.least("n", "m") >= similarity * F.greatest("n", "m")) & able)


def _connect(members: DataFrame, known: DataFrame, texts: DataFrame, tables: Tables, words: int, similarity: float, level: int = 0) -> DataFrame:
    """(u, v): a star for each component, v its smallest node, of the known links and all that similar pairs of members (_MEMBER, p and q the
    parity bits) of one cell connect."""
    links, fresh = known, not level
    now = members.select(*_MEMBER, F.lit(False).alias("done"))
    turn = 0
    while True:
        name = f"{level}-{turn}"
        if fresh:  # what is linked so far, as stars again; without new links they stand
            links = tables.put(components(links).where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")), f"stars-{name}")
        if turn:
            for old in (f"links-{level}-{turn - 1}", f"cells-{level}-{turn - 1}"):
                tables.drop(old)
        label = links.select(F.col("u").alias("digest"), F.col("v").alias("label"))
        now = now.join(label, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        cells = now.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.count_if(~F.col("done")).alias("left"), F.min("digest").alias("c")).where("low != high and left > 0").select("cell", "size", "left", "c")
        cells = tables.put(cells, f"cells-{name}")  # so that the join below has shuffles of its own, and a hot cell is split
        now = tables.put(now.join(cells, "cell").select(*_MEMBER, "done", "label", "size", "left", "c"), f"members-{name}")
        if turn:
            tables.drop(f"members-{level}-{turn - 1}")
        state = now.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
        if not state[0]:
            return links
        if turn and state[1] > _SMALL and not level:
            links = _connect(tables.put(_rare(now.where(F.col("size") > _SMALL), texts, tables, words, similarity), "rare"), links, texts, tables, words, similarity, 1)
            for old in ("rare", "every", "counts"):
                tables.drop(old)
            now = now.where(F.col("size") <= _SMALL)
        place = F.shiftrightunsigned(F.xxhash64("digest", F.lit(turn)), 11) / float(1 << 53)  # the same nodes come first in all cells
        chance = place * F.col("left") < _CENTRES << 3 * (turn - 1) if turn else F.lit(False)
        centre = (F.col("digest") == F.col("c")) if not turn else ~F.col("done") & ((F.col("size") <= _SMALL) | chance)
        now = now.withColumn("centre", centre)
        pairs = _candidates(now, similarity, not turn)
        pairs = pairs.select(F.least("digest", "d").alias("u"), F.greatest("digest", "d").alias("v")).distinct()
        found = tables.put(_verified(pairs, texts, words, similarity), f"links-{name}")
        fresh = not found.isEmpty()
        if fresh:
            links = links.unionByName(found)
        now = now.select(*_MEMBER, (F.col("done") | F.col("centre")).alias("done"))
        turn += 1


def _near(least: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v): nodes (digest, simhash) whose fingerprints are the same or linked, a star for each fingerprint and a pair for each link."""
    first = least.groupBy("simhash").agg(F.min("digest").alias("first"), F.count("*").alias("size"))
    same = least.join(first.where("size > 1"), "simhash").where("digest != first").select(F.col("first").alias("a"), F.col("digest").alias("b"))
    end = lambda c, to: first.select(F.col("simhash").alias(c), F.col("first").alias(to))
    linked = near(least).join(end("u", "a"), "u").join(end("v", "b"), "v").select("a", "b")
    return same.unionByName(linked).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def keep_first(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, fingerprint: Callable[[str | None, int], int], near: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """One row of each component, all columns as they are: the row of the smallest id (of the smallest text hash, if ids repeat;
    of repeated rows one). fingerprint (of a text and a shingle's words) and near (the links of a table's fingerprints) give the first candidates."""
    tables = Tables(df.sparkSession, "shingles")
    mark, own, of = unused(df.columns, "hash", "id", "of")
    hashed = df.withColumn(mark, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    source = hashed.select(F.col(f"`{id_col}`").alias("__id"), F.col(mark).alias("__h"), F.col(f"`{text_col}`").alias("__text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                found = list(sets(batch.column(2), words))
                sizes = np.array([len(s) for s in found], np.int64)
                least = np.array([minima(s) for s in found if len(s)], np.uint32).reshape(-1, _BANDS * _ROWS)
                cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((sizes > 0) * _BANDS)]).astype(np.int32)), pa.array(bands(least).ravel().view(np.int64)))
                bits = np.array([parity(s) for s in found], np.int64).reshape(-1, 2)
                prints = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([digest(s) for s in found], pa.int64()), pa.array(sizes), *[pa.array(bits[:, i].copy()) for i in (0, 1)], pa.array(prints), cells], names=["__id", "__h", "digest", "n", "p", "q", "simhash", "cells"])

    rows = source.mapInArrow(sketch, source.drop("__text").schema.add("digest", "long").add("n", "long").add("p", "long").add("q", "long").add("simhash", "long").add("cells", T.ArrayType(T.LongType())))
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__h").alias("h"))
    least = tables.put(rows.groupBy("digest").agg(F.min(order).alias("k"), *[F.any_value(c).alias(c) for c in ("n", "p", "q")], F.min("simhash").alias("simhash"), F.any_value("cells").alias("cells")), "least")
    cells = least.select("digest", "n", "p", "q", F.posexplode("cells").alias("i", "cell"), "cells")
    before = F.when(F.col("i") > 0, F.slice("cells", F.greatest(F.col("i") + 1 - _BEFORE, F.lit(1)), F.least("i", F.lit(_BEFORE)))).otherwise(F.array().cast("array<long>"))
    cells = cells.select("cell", "digest", "n", "p", "q", F.lit(0).alias("at"), before.alias("before"))
    shared = tables.put(cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1").select("cell"), "shared")
    members = tables.put(cells.join(shared, "cell").select(*_MEMBER), "members")
    pairs = tables.put(_near(least.select("digest", "simhash"), near), "near")
    nodes = members.select("digest").unionByName(pairs.select(F.col("u").alias("digest"))).unionByName(pairs.select(F.col("v").alias("digest"))).distinct().join(least, "digest").select("digest", F.col("k.id").alias("__i"), F.col("k.h").alias("__k"))
    texts = source.join(nodes, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__k"))).select("digest", "__text").dropDuplicates(["digest"])
    texts = tables.put(texts, "texts")
    known = tables.put(_verified(pairs, texts, words, similarity), "known")
    roots = _connect(members, known, texts, tables, words, similarity).select(F.col("u").alias("digest"), F.col("v").alias("root"))
    best = least.join(roots, "digest", "left").groupBy(F.coalesce("root", "digest").alias("component")).agg(F.min("k").alias("k"))
    best = best.select(F.col("k.id").alias(own), F.col("k.h").alias(of))
    kept = hashed.join(best, hashed[id_col].eqNullSafe(best[own]) & (hashed[mark] == best[of]), "left_semi")
    return kept.dropDuplicates([id_col, mark]).select(*[F.col(f"`{c}`") for c in df.columns])
