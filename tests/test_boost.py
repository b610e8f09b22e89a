"""Boosted trees against a plain version, and by levels against in memory."""

import random

import numpy as np
import pytest
from codeweave.operators import boost
from codeweave.operators.boost import Boost, Fit
from pyspark.sql import functions as F

FEATURES = ["a", "b", "c"]


def plain_trees(x, y, key, setting):
    """Trees by loops over rows: lists of {node: (feature, bin, value)}."""
    trees, margin = [], [0.0] * len(y)
    for turn in range(setting.rounds):
        cols, seen = boost.drawn(len(x[0]), turn, setting).tolist(), boost.sampled(np.array(key), turn, setting)
        p = [1 / (1 + np.exp(-m)) for m in margin]
        g, h = [round((a - b) * boost.UNIT) / boost.UNIT for a, b in zip(p, y)], [round(a * (1 - a) * boost.UNIT) / boost.UNIT for a in p]
        tree, todo = {}, [(0, 0, [i for i in range(len(y)) if seen[i]])]
        while todo:
            node, level, rows = todo.pop(0)
            gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
            best = (1e-6, -1, 0)
            if level < setting.depth:
                for f in cols:
                    for cut in range(setting.bins - 1):
                        left = [i for i in rows if x[i][f] <= cut]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        gr, hr = gs - gl, hs - hl
                        if hl < setting.least or hr < setting.least:
                            continue
                        gain = gl**2 / (hl + setting.l2) + gr**2 / (hr + setting.l2) - gs**2 / (hs + setting.l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
            tree[node] = (best[1], best[2], -setting.rate * gs / (hs + setting.l2))
            if best[1] >= 0:
                todo += [(2 * node + 1, level + 1, [i for i in rows if x[i][best[1]] <= best[2]]), (2 * node + 2, level + 1, [i for i in rows if x[i][best[1]] > best[2]])]
        for i in range(len(y)):
            node = 0
            while tree[node][0] >= 0:
                node = 2 * node + 1 + (x[i][tree[node][0]] > tree[node][1])
            margin[i] += tree[node][2]
        trees.append(tree)
    return trees


def as_dict(tree, node=0):
    out = {node: (int(tree.feature[node]), int(tree.bin[node]), float(tree.value[node]))}
    if tree.feature[node] >= 0:
        out |= as_dict(tree, 2 * node + 1) | as_dict(tree, 2 * node + 2)
    return out


def rows_of(bins, y, key, starts):
    n = len(y)
    return boost.Rows(np.array(bins, np.uint8).T.copy(), np.array(y), np.array(key), np.zeros(n, np.int64), np.ones(n, np.uint64), np.ones(n, np.uint64), np.array(starts))


def test_splits_equal_plain_ones():
    rng = random.Random(1)
    x = [[rng.randrange(8), rng.randrange(8), rng.randrange(8)] for _ in range(150)]
    y = [int(a[0] + a[1] + rng.randrange(4) > 9) for a in x]
    key = [rng.getrandbits(60) for _ in y]
    setting = Boost(depth=3, rounds=4, bins=8, least=1.5, columns=0.7, rate=0.3)
    got = [as_dict(t) for t in boost.grow(rows_of(x, y, key, [0, 100]), setting)]
    want = plain_trees(x, y, key, setting)
    for a, b in zip(got, want, strict=True):
        assert {n: v[:2] for n, v in a.items() if v[0] >= 0} == {n: v[:2] for n, v in b.items() if v[0] >= 0}
        assert set(a) == set(b) and all(a[n][2] == pytest.approx(b[n][2], abs=1e-9) for n in a)


@pytest.mark.parametrize("objective", ["pairwise", "ndcg"])
def test_ranking_gradients_equal_plain_ones(objective):
    rng = random.Random(2)
    y = [rng.randrange(2) for _ in range(30)]
    margin = np.array([rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in y])
    starts = [0, 7, 8, 20]
    g, h = boost.gradients(margin, rows_of([[0]] * 30, y, [0] * 30, starts), objective)
    wg, wh = [0.0] * 30, [0.0] * 30
    for a, b in zip(starts, [*starts[1:], 30]):
        order = sorted(range(a, b), key=lambda i: (-margin[i], i))
        place = {i: r for r, i in enumerate(order)}
        ideal = sum(1 / np.log2(r + 2) for r in range(sum(y[a:b])))
        for i in range(a, b):
            for j in range(a, b):
                if y[i] > y[j]:
                    p = 1 / (1 + np.exp(margin[i] - margin[j]))
                    w = abs(1 / np.log2(place[i] + 2) - 1 / np.log2(place[j] + 2)) / ideal if objective == "ndcg" else 1.0
                    wg[i], wg[j], wh[i], wh[j] = wg[i] - p * w, wg[j] + p * w, wh[i] + p * (1 - p) * w, wh[j] + p * (1 - p) * w
    assert np.allclose(g / boost.UNIT, wg, atol=2e-6) and np.allclose(h / boost.UNIT, wh, atol=2e-6)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for s in range(40):
        for t in range(12):
            a, b, c = rng.random(), rng.randrange(5), rng.choice([None, float("nan"), 1.0, 2.0])
            rows.append((s, t, a, b, c, int(a + b / 5 + (s % 3 == t % 3) > 1.8), (s % 3) * 3 + t % 3, s % 4))
    df = spark.createDataFrame(rows, "source long, target long, a double, b int, c double, y int, pair int, fold int")
    return boost.binned(df, FEATURES, bins=16, keep=["source", "target", "y", "pair", "fold"]).cache()


def fits(objectives=("logistic", "pairwise", "ndcg")):
    small = dict(depth=3, rounds=5, bins=16, least=0.5)
    return [Fit(f"{o}{k}", F.col("fold") != k, F.col("fold") == k, FEATURES[: 3 - k], encoded=k == 0, setting=Boost(objective=o, **small)) for o in objectives for k in (0, 1)]


def test_levels_and_memory_grow_the_same_trees(table):
    near = boost.fit_all(table, FEATURES, fits(), category="pair")
    far = boost.fit_all(table.repartition(5), FEATURES, fits(), category="pair", memory=0, every=2)
    for a, b in zip(near.trees, far.trees, strict=True):
        assert [as_dict(t) for t in a] == [as_dict(t) for t in b]
    found = {(r.fit, r.source, r.target): r.score for r in near.scores().collect()}
    assert found == {(r.fit, r.source, r.target): r.score for r in far.scores().collect()}
    assert len(found) == 6 * 10 * 12


def test_it_learns_and_explains(table):
    run = boost.fit_all(table, FEATURES, [Fit("x", F.col("fold") != 0, F.col("fold") == 0, FEATURES, setting=Boost(rounds=60, bins=16, least=1.0))], category="pair")
    rows = run.scores().collect()
    good, bad = [r.score for r in rows if r.y == 1], [r.score for r in rows if r.y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    gains = {r.feature: r.gain for r in run.importance().collect()}
    assert set(gains) <= {*FEATURES, "category_rate"} and sum(gains.values()) == pytest.approx(1) and gains["a"] > 0.1 and gains["category_rate"] > 0.1


def test_nothing_to_learn(table):
    run = boost.fit_all(table, FEATURES, [Fit("x", F.lit(False), F.lit(True), FEATURES, setting=Boost(rounds=2, bins=16))], category="pair")
    assert {r.score for r in run.scores().collect()} == {0.5}
    with pytest.raises(ValueError):
        boost.fit_all(table, FEATURES, [Fit("x", F.lit(True), F.lit(True), FEATURES)] * 64)


def test_only_the_rows_that_a_fit_learns_from_count(table, monkeypatch):
    """The table is far larger than the bound, the rows of the fit are not: no job for each level."""

    def never(*_):
        raise AssertionError("grown by levels")

    monkeypatch.setattr(boost, "_grown_by_levels", never)
    few = [Fit("x", F.col("source") < 6, F.lit(True), FEATURES, setting=Boost(depth=3, rounds=3, bins=16, least=0.5))]
    run = boost.fit_all(table, FEATURES, few, category="pair", memory=6 * 12 * 40)
    assert run.scores().count() == 40 * 12 and any(t.feature[0] >= 0 for t in run.trees[0])


def test_joint_sums_and_pairs_in_parts_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    n, starts = 900, np.arange(0, 900, 30)
    bins = np.stack([rng.integers(0, w, n) for w in (2, 16, 16, 5, 1, 16)]).astype(np.uint8)
    y = ((bins[1] + bins[2] + rng.integers(0, 9, n)) > 27).astype(int)
    key = rng.integers(0, 1 << 60, n)
    for objective in ("logistic", "pairwise", "ndcg"):
        setting, found = Boost(depth=4, rounds=6, bins=16, least=1.0, objective=objective), []
        for joint, pairs in ((1, 1 << 20), (100, 50), (10_000, 1)):
            monkeypatch.setattr(boost, "JOINT", joint)
            monkeypatch.setattr(boost, "PAIRS", pairs)
            rows = rows_of(bins.T, y, key, starts)
            trees = boost.grow(rows, setting)
            found.append(([as_dict(t) for t in trees], boost.margins(trees, rows.bins, 4).tolist()))
        assert found[0] == found[1] == found[2] and len(found[0][0][0]) > 1


def test_the_learners_table_begins_its_own_plan(spark):
    from codeweave.plans.standins import Data

    plan = Data(spark, "/root/testdata/sf0.001").candidates._jdf.queryExecution().analyzed().toString()
    assert "Window" not in plan and "Join" not in plan
