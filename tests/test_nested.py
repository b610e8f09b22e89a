"""The inner choice against a plain loop over all settings, folds against a plain deal, and small whole runs."""

import hashlib
import random

import pytest
from codeweave.operators import boost, nested, rerank
from codeweave.operators.boost import Boost
from codeweave.operators.nested import Retrieval
from pyspark.sql import functions as F

SMALL = Boost(depth=3, rounds=6, bins=16, least=0.5)
RETRIEVALS = [Retrieval(k, n, c) for k in (2, 4) for n in (1, 3) for c in (True, False)]
FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = []
    for s in range(30):
        for t in range(8):
            a = rng.random()
            out.append((s, t, int(a > 0.8), a, rng.random(), rng.randrange(1, 9), rng.choice([1, 2, 3, 999]), rng.randrange(2), rng.randrange(4), round(0.6 * a + 0.4 * rng.random(), 2)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, "source long, target long, y int, a double, b double, best_rank int, cooc_rank int, chapter_ok int, pair int, score double")
    keep = ["source", "target", "y", "best_rank", "cooc_rank", "chapter_ok", "pair", "score"]
    return boost.binned(df, FEATURES, bins=16, keep=keep).join(nested.deal(df.select("source").distinct(), 5, 3), "source").cache()


def test_folds_are_dealt_in_the_order_of_a_hash(spark):
    codes = spark.createDataFrame([(i,) for i in range(500)], "source long").repartition(7)
    got = {r.source: r.fold for r in rerank.folds(codes, 5).collect()}
    order = sorted(range(500), key=lambda i: (hashlib.md5(f"{i}:{rerank.SEED}".encode()).hexdigest(), i))
    assert got == {c: i % 5 for i, c in enumerate(order)}
    assert "SinglePartition" not in rerank.ranks(codes, F.md5(F.col("source").cast("string")), "source", by=["source"])._jdf.queryExecution().executedPlan().toString()
    dealt = nested.deal(codes, 5, 3).collect()
    for o in range(5):
        assert all((r.inner[o] is None) == (r.fold == o) for r in dealt)
        sizes = [sum(r.inner[o] == i for r in dealt) for i in range(3)]
        assert sum(sizes) == 400 and max(sizes) - min(sizes) <= 1


def plain_f1(rows, known, r, tau, rho):
    kept = [x for x in rows if (x[5] <= r.k or x[6] <= r.n) and (not r.chapter or x[7])]
    best = {}
    for x in kept:
        best[x[0]] = max(best.get(x[0], -1), x[9])
    out = [x for x in kept if x[9] >= tau or x[9] >= rho * best[x[0]] or x[9] == best[x[0]]]
    return round(2 * sum(x[2] for x in out) / (len(out) + known), 9) if len(out) + known else 0.0


def test_choice_equals_a_loop_over_all_settings(spark, rows, table):
    fold = {r.source: r.fold for r in table.select("source", "fold").distinct().collect()}
    inside = table.withColumn("outer", F.explode(F.array(*map(F.lit, range(5))))).where("outer <> fold")
    known = table.where("y = 1").select("source", "target")
    chosen = nested.with_taus(nested.choose_setting(inside, nested.inner_totals(known, table.select("source", "fold").distinct()), RETRIEVALS))
    got = {r.outer: r for r in nested.spelled_out(chosen, RETRIEVALS, nested.RHOS).collect()}
    for o in range(5):
        mine = [x for x in rows if fold[x[0]] != o]
        best = None
        for r in RETRIEVALS:
            for tau in nested.TAUS:
                for rho in nested.RHOS:
                    f1 = plain_f1(mine, sum(x[2] for x in mine), r, tau, rho)
                    if best is None or f1 > best[0]:
                        best = (f1, r.k, r.n, r.chapter, tau, rho)
        assert (got[o].inner_f1, got[o].k, got[o].n, got[o].chapter, got[o].tau, got[o].rho) == best


def test_negative_scores_are_emitted_by_the_same_rule(spark):
    rows = [(1, -4.0, 1), (1, -2.0, 0), (1, -1.0, 1), (2, 0.5, 1), (2, -3.0, 0)]
    df = spark.createDataFrame([(s, x, y, [-2.5, -1.5]) for s, x, y in rows], "source long, score double, y int, taus array<double>")
    got = {(r.tau_at, r.rho_at): (r.tp, r.n_emitted) for r in nested.emission_grid(df.withColumn("g", F.lit(0)), ["g"], [0.5, 3.0], taus_col="taus").collect() if r.tau_at < 2}
    for i, tau in enumerate([-2.5, -1.5]):
        for j, rho in enumerate([0.5, 3.0]):
            best = {1: -1.0, 2: 0.5}
            out = [y for s, x, y in rows if x >= tau or x >= rho * best[s] or x == best[s]]
            assert got[i, j] == (sum(out), len(out))


def test_nested_validation_scores_every_source_out_of_fold(spark, table):
    known = table.where("y = 1").select("source", "target")
    run = nested.validate(table, FEATURES, known, retrievals=RETRIEVALS, setting=SMALL)
    folds = run.folds.collect()
    assert len(folds) == 5 and sum(r.n_true for r in folds) == known.count()
    assert {r.source for r in run.emitted.select("source").distinct().collect()} <= set(range(30))
    # a fifth of the pairs are true, so emitting all of them gives 0.33
    assert run.pooled().first().f1 > 0.5
    rank = nested.validate(table, FEATURES, known, retrievals=RETRIEVALS[-1:], before=RETRIEVALS[-1], setting=Boost(depth=2, rounds=4, bins=16, least=0.1, objective="ndcg"))
    assert rank.pooled().first().f1 > 0.4


def test_studies_return_a_row_for_each_point(spark, table):
    known = table.where("y = 1").select("source", "target")
    sweep = nested.retrieval_sweep(table, FEATURES, known, RETRIEVALS[:3], SMALL)
    alone = nested.retrieval_sweep(table, FEATURES, known, RETRIEVALS[:3], SMALL, most=1)
    assert sweep.count() == 3 and sorted(map(str, sweep.collect())) == sorted(map(str, alone.collect()))
    variants = {"full": (lambda f: True, "logistic", True), "no_b": (lambda f: f != "b", "logistic", True), "pairwise": (lambda f: True, "pairwise", False)}
    found = {r.variant: r for r in nested.ablation(table, FEATURES, known, variants, RETRIEVALS[-1], SMALL).collect()}
    assert {v: r.n_features for v, r in found.items()} == {"full": 3, "no_b": 2, "pairwise": 2}
    curve = {r.n: r for r in nested.learning_curve(table, FEATURES, known, [5, 20, 30], 2, RETRIEVALS[-1], 0.5, 0.9, SMALL).collect()}
    assert curve[30].f1 is None and curve[5].repeats == 2 and curve[20].f1 > 0.5
    cost = nested.holdout_cost(table, FEATURES, known, spark.createDataFrame([(s, s % 7) for s in range(30)], "source long, ccs_id int"), 2, RETRIEVALS[-1], 0.5, 0.9, SMALL).collect()
    assert {r.split for r in cost} == {"code", "category"} and all(r.repeats == 2 for r in cost)


def test_fixed_scores_are_looked_at_once(spark, rows, table):
    """The choice equals that over copies for each outer fold, and no shuffle carries copies for each retrieval."""
    fold = table.select("source", "fold").distinct()
    known = table.where("y = 1").select("source", "target")
    totals = nested.inner_totals(known, fold)
    inside = table.withColumn("outer", F.explode(F.array(*map(F.lit, range(5))))).where("outer <> fold")
    want = {tuple(r) for r in nested.choose_setting(inside, totals, RETRIEVALS).collect()}
    assert {tuple(r) for r in nested.choose_fixed(table, totals, RETRIEVALS).collect()} == want and len(want) == 5
    plan = nested.cells(nested.eligible_copies(table.repartition(3), RETRIEVALS, []), ["fold", "retrieval"], F.array(F.lit(0.5)), [0.5])._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate") :]
    assert "Window" in below and "Window" not in plan[: plan.index("Generate")]
