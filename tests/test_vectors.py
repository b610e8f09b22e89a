"""Products that keep all pairs inside their blocks, against plain windows over all pairs; few digits make many ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweave.operators.vectors import cosine_counts, cosine_lists, cosine_places

CUTS = {"a": slice(0, 3), "b": slice(1, 4)}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    s, t = rng.normal(size=(700, 4)).astype(np.float32), rng.normal(size=(90, 4)).astype(np.float32)
    table = lambda v, step: spark.createDataFrame([(step * i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>").repartition(3)
    unit = lambda v: v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    values = {m: np.rint(unit(s[:, c]) @ unit(t[:, c]).T * 10).astype(int) for m, c in CUTS.items()}
    return table(s, 2), table(t, 5), values


def places(v, axis):
    first = np.argsort(-v, axis=axis, kind="stable")
    return np.argsort(first, axis=axis) + 1


@pytest.mark.parametrize("side", ["source", "target"])
def test_lists(spark, data, side):
    s, t, values = data
    listed = spark.createDataFrame([(0, 0), (0, 0), (1398, 445), (4, 35), (3, 0), (0, 7)], "source long, target long")
    got = {(r.source, r.target): r for r in cosine_lists(s, t, CUTS, k=4, side=side, pairs=listed, digits=1).collect()}
    axis = 1 if side == "source" else 0
    place = {m: places(v, axis) for m, v in values.items()}
    want = {(2 * i, 5 * j) for m in CUTS for i, j in np.argwhere(place[m] <= 4)}
    assert set(got) == want | {(0, 0), (1398, 445), (4, 35)}
    for (i, j), r in got.items():
        assert r.listed == ((i, j) in {(0, 0), (1398, 445), (4, 35)})
        for m in CUTS:
            at = place[m][i // 2, j // 5]
            assert (r[m], r[f"rank_{m}"]) == (values[m][i // 2, j // 5] / 10, at if at <= 4 else None)
            assert r[f"best_{m}"] == values[m].max(axis, keepdims=True)[i // 2 if axis else 0, 0 if axis else j // 5] / 10


@pytest.mark.parametrize("side", ["source", "target"])
def test_places(spark, data, side):
    s, t, values = data
    pairs = [(2 * i, 5 * j, float(values["a"][i, j] / 10), float(values["b"][i, j] / 10), i + 0.5) for i in range(0, 700, 3) for j in range(0, 90, 7)]
    out = cosine_places(spark.createDataFrame(pairs, "source long, target long, a double, b double, more double"), s, t, CUTS, side=side, digits=1).collect()
    assert len(out) == len(pairs)
    axis = 1 if side == "source" else 0
    place = {m: places(v, axis) for m, v in values.items()}
    for r in out:
        i, j = r.source // 2, r.target // 5
        assert r.more == i + 0.5
        for m in CUTS:
            all_of = (values[m][i] if axis else values[m][:, j]) / 10
            assert r[f"place_{m}"] == place[m][i, j]
            assert (r[f"best_{m}"], r[f"mean_{m}"], r[f"sd_{m}"]) == pytest.approx((all_of.max(), all_of.mean(), all_of.std(ddof=1)), abs=1e-12)


def test_counts(spark, data):
    s, t, values = data
    got = {r.source: (r.n, r.best) for r in cosine_counts(s, t, CUTS["a"], digits=1).collect()}
    assert got == {2 * i: (int((v >= 0).sum()), v.max() / 10) for i, v in enumerate(values["a"]) if (v >= 0).any()}


def test_all_pairs_stay_in_their_blocks(spark):
    """Scores and features shuffle vectors and kept pairs only: the rows that leave the products are far fewer than all pairs."""
    from codeweave.plans.standins import Data

    d = Data(spark, "/root/testdata/sf0.001")
    n = d.sources.count() * d.targets.count()
    assert d.lists("sim", "sim_a", "sim_b", k=2).count() < n / 20
    for query in (d.scored, d.pool_features(10, 10)):
        plan = query._jdf.queryExecution().optimizedPlan().toString()
        assert "rank_" in plan and "Window" not in "".join(x for x in plan.splitlines() if "sim_a" in x)


def test_empty_sides(spark, data):
    s, t, _ = data
    none = s.where(F.lit(False))
    assert cosine_lists(none, t, CUTS, k=2).count() == cosine_lists(s, none, CUTS, k=2).count() == cosine_counts(none, t, CUTS["a"]).count() == 0


def test_lists_take_the_exact_best_of_close_cosines(spark):
    """Cosines that short floats can't tell apart: all units of the last digits decide, ties go by id; blocks of several stripes."""
    from codeweave.operators.vectors import cosine_best

    rng = np.random.default_rng(9)
    base = rng.normal(size=8)
    s = (base + 1e-3 * rng.normal(size=(200, 8))).astype(np.float32)
    t = (base + 1e-3 * rng.normal(size=(5000, 8))).astype(np.float32)
    table = lambda v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>")
    unit = lambda v: v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    v = np.rint(unit(s) @ unit(t).T * 10**6).astype(int)
    place = places(v, 1)
    got = {(r.source, r.target): (round(r.x * 10**6), r.rank_x) for r in cosine_lists(table(s), table(t), {"x": slice(0, 8)}, k=5).collect()}
    assert got == {(i, j): (v[i, j], place[i, j]) for i, j in np.argwhere(place <= 5)}
    best = {(r.source, r.target): r["rank"] for r in cosine_best(table(s), table(t), slice(0, 8), k=5).collect()}
    assert best == {(i, j): place[i, j] for i, j in np.argwhere(place <= 5)}
    back = places(v, 0)
    pairs = spark.createDataFrame([(int(i), int(j), float(v[i, j] / 10**6)) for i, j in np.argwhere(place <= 5)], "source long, target long, x double")
    for side, all_of in (("source", place), ("target", back)):
        for r in cosine_places(pairs, table(s), table(t), {"x": slice(0, 8)}, side=side, spread=side == "source").collect():
            assert r.place_x == all_of[r.source, r.target]


def test_scores_are_kept(spark):
    """Queries that look at the scores several times compute the product once."""
    from codeweave.plans.standins import Data

    d = Data(spark, "/root/testdata/sf0.001")
    assert d.scored.storageLevel.useMemory
    d.scored.unpersist()


def test_the_study_looks_at_its_pool_once(spark):
    """Label pairs and features come from one kept pool, so each product of the vectors stands once in the study's plan."""
    from codeweave.plans.standins import Data

    d = Data(spark, "/root/testdata/sf0.001")
    plan = d.study._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation") >= 2 and "place_sim_a" not in plan.split("InMemoryRelation")[0]
    d.study_pool.unpersist()
