"""The conversations' trie against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

from codeweave.llm import trie
from codeweave.llm.common import Tables
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, Place int, name string"


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            content = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0, content), role, text))
    for c in turns:
        turns[c] = [x[1:] for x in sorted(turns[c])]
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        leaves, saved = 0 if kids[p] else 1, (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for k in kids[p]:
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rebuilt_trie(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(-7, 60), 10**12, 10**12 + 3]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 12])):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "", None, "é" * 5]), 1, "x"))
    rows += [(31, 0, "user", "same", 1, "x")] * 3 + [(None, 0, "user", "lost", 1, "x"), (33, 4, "user", "w " * 200_000, 1, "x")]
    rows += [(c, i, "user", f"copy {i}", 1, "x") for c in range(200, 300) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rebuilt(rows))
    assert any(r[1] == 0 and r[3] > 100 for r in want) and max(r[1] for r in want) > 8
    out = trie.rebuilt_nodes(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found(out) == want


def test_one_conversation_may_hold_most_rows(spark):
    rows = [(7, i, "user", str(i % 3)) for i in range(900)] + [(c, 0, "user", "0") for c in range(100, 130)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    tables = Tables(spark, "test")
    turns = tables.put(trie.ordered(df, tables), "ordered")
    convs = turns.groupBy("conv").agg(F.count("*").alias("length"))
    convs_of = defaultdict(list)
    for c, _, role, text in rows:
        convs_of[c].append((role, text))
    import sys

    sys.setrecursionlimit(10_000)
    assert found(trie.nodes(turns.join(convs, "conv"), convs, tables)) == plain(convs_of)


def test_no_conversation_no_node(spark):
    assert trie.rebuilt_nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_running_sums_over_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(20), rng.randrange(5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(5)
    out = trie.running(df.withColumn("k", F.lit(1).cast("long")), ["g"], [F.asc("o")], ["v", "k"], Tables(spark, "test"), "x").collect()
    for g in (1, 2, 3):
        mine = sorted((r for r in out if r.g == g), key=lambda r: r.k)
        assert [r.k for r in mine] == list(range(1, len(mine) + 1))
        assert [r.o for r in mine] == sorted(x[1] for x in rows if x[0] == g)
        assert mine[-1].v == sum(x[2] for x in rows if x[0] == g)


def test_names_are_dense(spark):
    names = trie.dense(spark.range(0, 100).repartition(7), "name", Tables(spark, "test"), "names")
    assert sorted(r["name"] for r in names.collect()) == list(range(100))
