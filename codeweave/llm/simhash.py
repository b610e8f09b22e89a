"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 32 two-bit segments are mapped to their bit counts. The Manhattan distance
of two such vectors is at most the Hamming distance of the fingerprints, so fingerprints
within `distance` bits lie within that range on the grid of counts. The range join
cuts the grid into blocks of segments: of b blocks at most `distance` can differ, so the pair shares
a cell of the grid over some b - distance whole blocks. Pairs within a cell are held against
the lower bound, then verified exactly. Cells of many fingerprints are joined through pivots,
so links are found without listing all pairs; only links that connect something are kept.

Nulls and texts without words have fingerprint zero and are linked like any other. Repeated
rows keep their rows. An empty table gives an empty table. Very long texts are read whole; what
moves afterwards doesn't depend on their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import Tables, mix, passing, slices, tasks_for, unused
from .components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bits set in over half the hashes are counted over blocks of so many.
_BLOCK = 1 << 16
#: Places where the fingerprints of one component meet its smallest id.
_SALTS = 16


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64 bits, each set if it is in over half of the XXH64 hashes of the shingles, repeats included."""
    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = [digest(line[a:b], seed) for a, b in zip(begins[at : min(n, at + _BLOCK)].tolist(), ends[min(len(found), words) - 1 + at :][:_BLOCK].tolist(), strict=False)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, words: int = 4) -> DataFrame:
    """Columns `keep` (default: all) with simhash long; one narrow pass."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != "simhash"]
    text = unused(keep, "text")[0]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                got = np.array([fingerprint(t, words) for t in batch.column(text).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(got)], names=[*keep, "simhash"])

    return source.mapInArrow(run, source.drop(text).schema.add("simhash", "long"))


def embed(f: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each written as so many ones (00, 01, 11): the Manhattan
    distance of the count vectors is then the number of bits in which two embeddings differ."""
    odd = np.uint64(0x5555555555555555)
    high = f >> np.uint64(1)
    return ((f | high) & odd) | ((f & high & odd) << np.uint64(1))


def cells(count: int, distance: int) -> list[int]:
    """Masks of the grids to join over: all choices of b - distance of b blocks of segments, with the smallest b whose
    cells hold few strangers (a segment has 1.5 bits of entropy). Every choice of b finds every pair."""
    for b in range(distance + 2, 17):
        strangers = comb(b, distance) * count * 2.0 ** (-48 * (b - distance) / b)
        if strangers <= 12 or comb(b + 1, distance) > 800:
            break
    edges = [round(32 * i / b) for i in range(b + 1)]
    blocks = [((1 << 2 * edges[i + 1]) - 1) ^ ((1 << 2 * edges[i]) - 1) for i in range(b)]
    return [sum(blocks[i] for i in kept) for kept in combinations(range(b), b - distance)]


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _apart(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def span(f: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (indices) that connect what all pairs within `distance` would: stars around pivots, then, for stars not yet
    connected whose pivots are near enough, the first link between them. Memory is linear."""
    rest = np.arange(len(f))
    stars: list[np.ndarray] = []
    links: list[tuple[int, int]] = []
    while len(rest):
        near = _apart(f[rest], f[rest[0]]) <= distance
        star = rest[near]
        links += [(int(star[0]), int(x)) for x in star[1:]]
        stars.append(star)
        rest = rest[~near]
    forest = Forest(len(stars))
    pivots = np.array([f[s[0]] for s in stars], np.uint64)
    for i in range(len(stars)):
        for j in (np.flatnonzero(_apart(pivots[i + 1 :], pivots[i]) <= 3 * distance) + i + 1).tolist():
            if forest.find(i) == forest.find(j):
                continue
            small, big = sorted((stars[i], stars[j]), key=len)
            for x in small.tolist():
                hit = np.flatnonzero(_apart(f[big], f[x]) <= distance)
                if len(hit):
                    links.append((x, int(big[hit[0]])))
                    forest.join(i, j)
                    break
    return links


def links(prints: DataFrame, *, distance: int = 4, count: int | None = None) -> DataFrame:
    """(u, v) long: links between different fingerprints of column simhash, enough to connect all that are linked."""
    prints = prints.select("simhash").distinct()
    if count is None:
        with passing(prints.sparkSession):
            count = prints.count()
    masks = np.array(cells(count, distance), np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, len(masks) + 1, dtype=np.uint64))
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 4096):
                f = every[at : at + 4096]
                cell = mix((embed(f.view(np.uint64))[None, :] & masks[:, None]) ^ salts[:, None]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), pa.array(np.tile(f, len(masks)))], names=["cell", "f"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of a cell that goes on
        for batch in batches:
            cell, f = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            done = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if held and len(cell) and held[0][0][0] != cell[-1]:
                held.append((cell[:done], f[:done]))
                yield from _within(np.concatenate([c for c, _ in held]), np.concatenate([x for _, x in held]), distance)
                held = []
            elif done:
                yield from _within(cell[:done], f[:done], distance)
            if len(cell):
                held.append((cell[done:], f[done:]))
        if held:
            yield from _within(np.concatenate([c for c, _ in held]), np.concatenate([x for _, x in held]), distance)

    dealt = prints.mapInArrow(spread, "cell long, f long").repartition(max(tasks_for(prints), 1), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(join, "u long, v long").distinct()


def _within(cell: np.ndarray, f: np.ndarray, distance: int, many: int = 48) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal cells."""
    if len(cell) < 2:
        return
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(begins, len(cell)))
    us, vs = [], []
    for b, n in zip(begins[sizes > many].tolist(), sizes[sizes > many].tolist(), strict=True):
        own = f[b : b + n]
        pairs = np.array(span(own, distance), np.int64).reshape(-1, 2)
        us.append(own[pairs[:, 0]])
        vs.append(own[pairs[:, 1]])
    few = np.repeat((sizes <= many) & (sizes > 1), sizes)
    cell, f = cell[few], f[few]
    e = embed(f)
    for step in range(1, many):
        if len(f) <= step:
            break
        at = np.flatnonzero((cell[step:] == cell[:-step]))
        if not len(at):
            break
        at = at[_apart(e[at], e[at + step]) <= distance]
        at = at[_apart(f[at], f[at + step]) <= distance]
        us.append(f[at])
        vs.append(f[at + step])
    if us:
        a, b = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        for at in range(0, len(pairs), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 18), 0].copy()), pa.array(pairs[at : at + (1 << 18), 1].copy())], names=["u", "v"])


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, words: int = 4, distance: int = 4) -> DataFrame:
    """Columns `keep` (default: the id) with simhash long and component: the smallest id (nulls never) of all rows that links reach.
    Kept columns named like these are replaced.

    Texts are read once; afterwards only ids and fingerprints move. Copies are one fingerprint, however many they are."""
    keep = [c for c in dict.fromkeys([id_col] if keep is None else [id_col, *keep]) if c.lower() not in ("simhash", "component")]
    tables = Tables(df.sparkSession, "simhash")
    rows = tables.put(fingerprints(df, text_col=text_col, keep=keep, words=words), "rows")
    least = tables.put(rows.groupBy("simhash").agg(F.min(F.col(f"`{id_col}`")).alias("least")), "least")
    roots = components(links(least, distance=distance, count=least.count()))
    linked = least.join(roots.withColumnRenamed("node", "simhash"), "simhash")
    # only fingerprints with links meet their component's smallest id, and a large component's in several places
    first = linked.groupBy("root").agg(F.min("least").alias("first")).withColumn("salt", F.explode(F.lit(list(range(_SALTS)))))
    linked = linked.withColumn("salt", F.pmod(F.xxhash64("simhash"), F.lit(_SALTS)).cast("int")).join(first, ["root", "salt"]).select("simhash", "first")
    classes = least.join(linked, "simhash", "left").select("simhash", F.coalesce("first", "least").alias("component"))
    classes = tables.put(classes, "classes")  # its own shuffle below, so that a fingerprint of very many rows is split as a skewed join
    return rows.join(classes, "simhash").select(*[F.col(f"`{c}`") for c in keep], "simhash", "component")


def keep_first(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, similarity: float | None = None) -> DataFrame:
    """One row of each component, all columns as they are: the row of the smallest id (of the smallest text hash, if ids repeat;
    of repeated rows one). With `similarity`, texts are linked by the Jaccard similarity of their shingles: the fingerprints' links are the first candidates,
    held against the whole sets. At 0.8, fingerprints differ in up to 16 of 64 bits and more, which leaves a grid join keys of a few bits, so `shingles` has candidates of its own beside them."""
    if similarity is not None:
        return shingles.keep_first(df, id_col=id_col, text_col=text_col, words=words, similarity=similarity, fingerprint=fingerprint, near=lambda prints: links(prints, distance=distance))
    mark, own, of = unused(df.columns, "hash", "id", "of")
    hashed = df.withColumn(mark, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    found = near_duplicates(hashed, id_col=id_col, text_col=text_col, keep=[mark], words=words, distance=distance)
    found = found.withColumn("component", F.coalesce(F.col("component").cast("string"), F.concat(F.lit("null "), "simhash")))
    order = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(mark).alias("h"))
    best = found.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.id").alias(own), F.col("k.h").alias(of))
    kept = hashed.join(best, hashed[id_col].eqNullSafe(best[own]) & (hashed[mark] == best[of]), "left_semi")
    return kept.dropDuplicates([id_col, mark]).select(*[F.col(f"`{c}`") for c in df.columns])
