"""Prefix trie of conversations by prefix doubling.

Equal turns get one dense name. Two neighbouring blocks of 2^k turns make one of 2^(k+1): a round for each power of two names the distinct pairs of names, so
rounds are logarithmic in the longest conversation. The first d turns are the blocks of d's binary digits, largest first; their names, at most one a digit,
name the prefix. Prefixes with one name are one node of the trie.

A node is told by its depth and its smallest member, since members of different nodes of one depth differ. So sums over subtrees need no walk: a node below
belongs, with its own smallest member, to a member of the node above.

No group is gathered in one task: places and sums along a conversation are running sums over ranges of rows, names of frequent keys are looked up from a
broadcast table (at most 4 keys a task can stand for over 1 / (4 tasks) of the rows), all others by a join, and lists of members are hashed from pieces of 256
ids in order. A digest is one chain, so a node's pieces are read by one task, as a stream.

Ordering: null turns come first, equal turns go by the content's digest. Null roles and texts are empty, rows without a conversation's id are left out.
Repeated rows are turns of their own. Contents are compared by SHA-256. Very long texts are only ever digested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Tables, tasks_for, unused

#: Member ids of one piece of a node's list.
PIECE = 256


def running(df: DataFrame, group: list[str], order: list[Column], values: list[str], tables: Tables, label: str) -> DataFrame:
    """df with `values` (longs) replaced by their running sums within the group, each row's own included; ties in an order that is kept.

    Rows are dealt by ranges of (group, order) and summed within a range; groups that span ranges, at most two a range, get the sums of the ranges before."""
    part, tie, parts, *before = unused(df.columns, "part", "tie", "parts", *[f"before_{v}" for v in values])
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(tasks_for(df), *group, *order, tie)
    dealt = tables.put(dealt.withColumn(part, F.spark_partition_id()), label)
    inside = W.partitionBy(part, *group).orderBy(*order, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(part, *group).agg(*[F.sum(v).alias(v) for v in values]).withColumn(parts, F.count("*").over(W.partitionBy(*group))).where(F.col(parts) > 1)
    starts = totals.select(part, *group, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(b) for v, b in zip(values, before, strict=True)])
    sums = dealt.withColumns({v: F.sum(v).over(inside) for v in values}).join(F.broadcast(starts), [part, *group], "left")
    return sums.withColumns({v: F.col(v) + F.coalesce(b, F.lit(0)) for v, b in zip(values, before, strict=True)}).drop(part, tie, *before)


def attach(left: DataFrame, right: DataFrame, key: list[str], uses: str) -> DataFrame:
    """left with right's columns by key; right, a stored table, has each key once and in `uses` at least its number of rows in left.

    Keys of over a 4 tasks-th of all uses, of which there are fewer than 4 a task, are broadcast; the others are joined."""
    total, most = right.agg(F.sum(uses), F.max(uses)).first()
    limit = (total or 0) // (4 * tasks_for(left))
    if (most or 0) <= limit:
        return left.join(right.drop(uses), key)
    hot = F.broadcast(right.where(F.col(uses) > limit).drop(uses))
    rest = left.join(hot.select(*key), key, "left_anti").join(right.where(F.col(uses) <= limit).drop(uses), key)
    return left.join(hot, key).unionByName(rest)


def dense(keys: DataFrame, name: str, tables: Tables, label: str) -> DataFrame:
    """keys with the column `name`: 0 to their number less 1. The counts of a table's parts, one row a task, are summed in order."""
    (mark,) = unused(keys.columns, "mark")
    stored = tables.put(keys.withColumn(mark, F.monotonically_increasing_id()), label)
    part = F.shiftright(F.col(mark), 33)
    sizes = stored.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    named = stored.join(F.broadcast(starts), part == F.col("part"))
    return named.withColumn(name, F.col("start") + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start", mark)


def ordered(df: DataFrame, tables: Tables, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place from 0, content, bytes) of all turns."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    content = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256))
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), content.alias("content"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("place"))
    placed = running(rows, ["conv"], [F.asc_nulls_first("turn"), F.asc("content")], ["place"], tables, "turns")
    return placed.select("conv", (F.col("place") - 1).alias("place"), "content", "bytes")


def rebuild(turns: DataFrame, tables: Tables, *, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where conversation c begins with the first h turns of c - c % group, then has its own after its first h; h = crc32(c) % heads.

    turns: (conv, place, length, content, bytes); conversations: (conv, length), turnless ones too."""
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % heads
    counts = turns.groupBy("conv").agg(F.count("*").alias("own"))
    first = counts.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = counts.withColumns({"head": head(F.col("conv")), "base": F.col("conv") - F.col("conv") % group}).join(first, "base", "left")
    taken = F.least("head", F.coalesce("base_own", F.lit(0)))
    convs = tables.put(convs.select("conv", "base", "head", "own", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length")), "rebuilt")
    heads_ = turns.where(F.col("place") < heads - 1).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "head", "length"), "base").where("place < head")
    tails = attach(turns.where(F.col("place") >= head(F.col("conv"))), convs.select("conv", "head", "taken", "length", "own"), ["conv"], "own")
    columns = ["conv", "place", "length", "content", "bytes"]
    return heads_.select(*columns).unionByName(tails.withColumn("place", F.col("taken") + F.col("place") - F.col("head")).select(*columns)), convs.select("conv", "length")


def _prefixes(turns: DataFrame, convs: DataFrame, tables: Tables) -> DataFrame:
    """(conv, depth, length, bytes, key) of every prefix, the empty one too: names of its blocks by descending powers of two."""
    turns = tables.put(turns, "contents")
    names = dense(turns.groupBy("content").agg(F.count("*").alias("uses")), "name", tables, "names_0")
    named = tables.put(attach(turns, names, ["content"], "uses").drop("content"), "named")
    longest = convs.agg(F.max("length")).first()[0] or 0
    level = named.select("conv", F.col("place").alias("block"), "name")
    blocks, k = level.withColumn("level", F.lit(0)), 0
    while 2 << k <= longest:
        k += 1
        side = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.col("name")))
        pairs = level.groupBy("conv", F.shiftright("block", 1).alias("half")).agg(side(0).alias("a"), side(1).alias("b")).where("b is not null")
        pairs = tables.put(pairs.withColumnRenamed("half", "block"), f"pairs_{k}")
        names = dense(pairs.groupBy("a", "b").agg(F.count("*").alias("uses")), "name", tables, f"names_{k}")
        level = tables.put(attach(pairs, names, ["a", "b"], "uses").select("conv", "block", "name"), f"level_{k}")
        blocks = blocks.unionByName(level.withColumn("level", F.lit(k)))
    depths = named.select("conv", "length", "bytes", (F.col("place") + 1).alias("depth")).withColumn("level", F.expr(f"explode(filter(sequence(0, {k}), k -> (depth & shiftleft(1L, k)) != 0))"))
    depths = depths.withColumn("block", F.expr("shiftright(depth, level + 1) * 2"))
    # a prefix only needs blocks of an even place; one of 2^k turns stands in up to 2^k prefixes
    even = blocks.where(F.col("block") % 2 == 0).withColumn("uses", F.expr("shiftleft(1L, level)"))
    parts = attach(depths, even, ["conv", "level", "block"], "uses")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("down"), "name"))), lambda x: x["name"])
    prefixes = parts.groupBy("conv", "depth").agg(F.max("length").alias("length"), F.max("bytes").alias("bytes"), in_order.alias("key"))
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), "length", F.lit(0).cast("long").alias("bytes"), F.array().cast("array<bigint>").alias("key"))
    return prefixes.unionByName(root)


def _digests(ends: DataFrame, tables: Tables) -> DataFrame:
    """(rep, depth, ends_sha256) of (rep, depth, conv): the digest of the ids in order, comma-joined."""
    ranked = running(ends.withColumn("rank", F.lit(1).cast("long")), ["rep", "depth"], [F.asc("conv")], ["rank"], tables, "ends")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    pieces = ranked.groupBy("rep", "depth", F.floor((F.col("rank") - 1) / PIECE).alias("piece")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, chain = None, None
        for batch in batches:
            done = []
            for rep, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "ids")), strict=True):
                if node != (rep, depth):
                    if node is not None:
                        done.append((*node, chain.hexdigest()))
                    node, chain = (rep, depth), hashlib.sha256(ids.encode())
                else:
                    chain.update(f",{ids}".encode())
            if done:
                yield _rows(done)
        if node is not None:
            yield _rows([(*node, chain.hexdigest())])

    return pieces.repartition(tasks_for(ends), "rep", "depth").sortWithinPartitions("rep", "depth", "piece").mapInArrow(run, "rep long, depth long, ends_sha256 string")


def _rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["rep", "depth", "ends_sha256"])


def nodes(turns: DataFrame, convs: DataFrame, tables: Tables) -> DataFrame:
    """A row for each node of the trie of conversations; turns and convs as `rebuild` gives them.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves and saved_tokens (over the subtree), ends_sha256."""
    prefixes = tables.put(_prefixes(turns, convs, tables), "prefixes")
    keys = tables.put(prefixes.groupBy("depth", "key").agg(F.min("conv").alias("rep"), F.count("*").alias("n")).withColumn("uses", F.col("n")), "keys")
    members = tables.put(attach(prefixes, keys, ["depth", "key"], "uses").select("conv", "depth", "length", "bytes", "rep", "n"), "members")
    own = members.where("conv = rep")
    above = members.select("conv", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent"))
    found = tables.put(own.join(above, ["conv", "depth"], "left").select("rep", "depth", "parent", "n", "length", ((F.col("n") - 1) * F.col("bytes")).alias("saved")), "nodes")
    children = found.where("parent is not null").groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    found = tables.put(found.join(children, ["rep", "depth"], "left").fillna(0, subset=["n_children"]), "with_children")
    # what each conversation brings to the nodes it belongs to: all that is saved at nodes of which it is the smallest member, and whether it ends in a leaf
    brought = found.groupBy(F.col("rep").alias("conv")).agg(F.sum("saved").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), (F.max("length") + 1).alias("uses"))
    brought = tables.put(brought, "brought")
    sums = attach(members.select("conv", "depth", "rep"), brought, ["conv"], "uses")
    sums = sums.groupBy("rep", "depth").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.when(F.col("conv") != F.col("rep"), F.col("saved")).otherwise(0)).alias("others"))
    below = running(found.select("rep", "depth", "saved"), ["rep"], [F.desc("depth")], ["saved"], tables, "below")
    digests = _digests(members.where("depth = length").select("rep", "depth", "conv"), tables)
    out = found.drop("saved").join(below, ["rep", "depth"]).join(sums, ["rep", "depth"]).join(digests, ["rep", "depth"], "left")
    return out.select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves",
        (F.col("saved") + F.col("others")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt_nodes(df: DataFrame, **columns: str) -> DataFrame:
    """The trie of rebuilt conversations; `columns` names conv_col, turn_col, role_col and text_col where they differ."""
    tables = Tables(df.sparkSession, "trie")
    turns, convs = rebuild(tables.put(ordered(df, tables, **columns), "ordered"), tables)
    return nodes(turns, convs, tables)
