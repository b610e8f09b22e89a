"""Sharding by sampled splitters.

Size-weighted key samples give quantile boundaries; records are range-partitioned
into pieces of near-equal bytes, overfull pieces are subdivided by samples of their
own, and pieces go to shards longest first. Equal keys are told apart by a salt, so a hot key
is cut like any other range. Null keys come first, null sizes count as 0, an empty
table gives an empty table; repeated rows are rows of their own; equal sizes need no order, since
keys and salts give one. A row larger than a piece's share is a piece alone, or with its small neighbours; texts
of any length are only measured. Columns named like the new ones are replaced, in whatever case.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import Tables, unused


def _entry(key, salt: int) -> tuple:
    return (key is not None, key if key is not None else 0, salt)


def boundaries(sample: list[tuple], sizes: list[float], pieces: int) -> list[tuple]:
    """At most pieces - 1 keys that cut the weighted sample into parts of near-equal weight."""
    if not sample:
        return []
    order = sorted(range(len(sample)), key=lambda i: sample[i])
    total, seen, out = sum(sizes), 0.0, []
    for i in order:
        seen += sizes[i]
        if len(out) < pieces - 1 and seen >= total * (len(out) + 1) / pieces and (not out or sample[i] > out[-1]):
            out.append(sample[i])
    return out


def pack(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Shard of each piece: longest first, to the lightest shard (lowest number on ties)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for piece in sorted(sizes, key=lambda p: (-sizes[p], p)):
        load, shard = heapq.heappop(heap)
        out[piece] = shard
        heapq.heappush(heap, (load + sizes[piece], shard))
    return out


def _piece(cuts: list[tuple]):
    @F.arrow_udf(T.IntegerType())
    def piece(key: pa.Array, salt: pa.Array) -> pa.Array:
        return pa.array([bisect_right(cuts, _entry(k, s)) for k, s in zip(key.to_pylist(), salt.to_pylist(), strict=True)], pa.int32())

    return piece


def shard(df: DataFrame, n_shards: int, *, key: Column, size: Column, pieces_per_shard: int = 32, samples_per_piece: int = 8, rounds: int = 8, seed: int = 42) -> DataFrame:
    """df with shard int (0 to n_shards - 1), slot long (gapless from 0 within a shard) and piece int.

    Pieces of over twice their share of the bytes are subdivided until none is left (but single rows), in `rounds` rounds at most.

    The driver holds n_shards * pieces_per_shard * samples_per_piece sampled keys, about, and a few numbers for each piece,
    whatever the input's size. The rows are written once to the shared folder with their salt, then shuffled once, by piece."""
    spark, new = df.sparkSession, ["shard", "slot", "piece"]
    kept = [c for c in df.columns if c.lower() not in new]
    key_, size_, salt_, n_ = unused([*kept, *new], "key", "size", "salt", "n")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], key.alias(key_), F.coalesce(size, F.lit(0)).cast("long").alias(size_), F.xxhash64(F.rand(seed), F.lit(seed)).alias(salt_))
    rows = Tables(spark, "shard").put(rows, "rows")
    total, count = rows.agg(F.coalesce(F.sum(size_), F.lit(0)), F.count("*")).first()
    pieces = max(1, min(n_shards * pieces_per_shard, count))
    wanted = pieces * samples_per_piece
    chance = (F.xxhash64(salt_, F.lit(seed + 1)).cast("double") + 2.0**63) / 2.0**64

    def sample(where: Column, bytes_there: int, n: int, turn: int) -> tuple[list[tuple], list[float]]:
        step = max(1.0, bytes_there / max(1, n))
        u = F.pmod(chance + F.lit(turn * 0.6180339887), F.lit(1.0))
        got = rows.where(where & (u < (F.col(size_) + 1) / F.lit(step))).select(key_, salt_, size_).collect()
        return [_entry(r[0], r[1]) for r in got], [max(step, r[2]) for r in got]

    cuts = boundaries(*sample(F.lit(True), total, wanted, 0), pieces)
    for turn in range(1, rounds + 1):
        placed = rows.withColumn("piece", _piece(cuts)(key_, salt_))
        held = {r[0]: (r[1], r[2]) for r in placed.groupBy("piece").agg(F.sum(size_), F.count("*")).collect()}
        full = {p: b for p, (b, n) in held.items() if n > 1 and b > 2 * total / pieces}
        if not full or turn == rounds:
            break
        at = _piece(cuts)(key_, salt_)
        got, sizes = sample(at.isin(list(full)), sum(full.values()), samples_per_piece * sum(1 + int(b * pieces / total) for b in full.values()), turn)
        inside: dict[int, list[int]] = {}
        for i, entry in enumerate(got):
            inside.setdefault(bisect_right(cuts, entry), []).append(i)
        cuts = sorted({*cuts, *(c for p, ids in inside.items() if p in full for c in boundaries([got[i] for i in ids], [sizes[i] for i in ids], 1 + int(full[p] * pieces / total)))})
    to = pack({p: b for p, (b, _) in held.items()}, n_shards)
    first, filled = {}, dict.fromkeys(range(n_shards), 0)
    for p in sorted(held):
        first[p] = filled[to[p]]
        filled[to[p]] += held[p][1]
    last = max(held, default=0) + 1
    shard_of, slot_of = (F.lit([d.get(p, 0) for p in range(last)]).cast(f"array<{k}>") for d, k in ((to, "int"), (first, "bigint")))
    in_piece = F.row_number().over(W.partitionBy("piece").orderBy(key_, salt_)).cast("long") - 1
    out = placed.withColumn(n_, in_piece)
    return out.select(*[F.col(f"`{c}`") for c in kept], F.get(shard_of, F.col("piece")).alias("shard"), (F.get(slot_of, F.col("piece")) + F.col(n_)).alias("slot"), "piece")
