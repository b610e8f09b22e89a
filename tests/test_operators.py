import pytest
from pyspark.sql import functions as F

from codeweave.functions import metrics
from codeweave.operators import evaluate, features, rerank, retrieve, rules, sweep, triage
from codeweave.operators.vectors import cosine_best, cosine_pairs
from codeweave.sources import files


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def sims(spark, *values):
    return spark.createDataFrame([("s1", f"t{i + 1}", v) for i, v in enumerate(values)], "source string, target string, sim double")


def test_relative_threshold(spark):
    assert rows(retrieve.relative_threshold(sims(spark, 0.90, 0.86, 0.85, None), 0.95), "target") == [("t1",), ("t2",)]
    assert rows(retrieve.relative_threshold(sims(spark, -0.5, -0.6), 0.95), "target") == []
    assert rows(retrieve.universe(sims(spark, 0.3, 0.0, -0.1)), "target") == [("t1",), ("t2",)]


def test_top_ties_by_code(spark):
    df = spark.createDataFrame([("s", t, 5) for t in ("t3", "t1", "t2")], "source string, target string, freq int")
    assert rows(retrieve.top(df, 2, "freq"), "target") == [("t1",), ("t2",)]


def test_flags_after_chapter_filter(spark):
    pool = spark.createDataFrame([("a", "x", 0.9, None, 2), ("a", "y", 0.8, 3, 1), ("a", "z", 0.8, 1, 1)], "source string, target string, sim double, freq int, ch int")
    out = rules.flag(pool, F.lit(1), F.col("ch"), {1: [1]})
    assert rows(out, "target", "top_sim", "top_cooc", "in_both") == [("y", 1, 1, 1), ("z", 1, 0, 1)]


def test_merge_null_codes_match(spark):
    a = spark.createDataFrame([(None, "x", 0.5)], "source string, target string, sim double")
    b = spark.createDataFrame([(None, "x", 3)], "source string, target string, freq int")
    assert rules.merge(a, b).count() == 1


def test_validate(spark):
    manual = spark.createDataFrame([("a", "x"), ("b", "y")], "source string, target string")
    auto = spark.createDataFrame([("a", "x"), ("a", "z"), (None, "q")], "source string, target string")
    ccs = spark.createDataFrame([("a", "1")], "source string, ccs_id string")
    none = spark.createDataFrame([("c",)], "source string")
    row = evaluate.performance(evaluate.validate(manual, auto, ccs, none)).first()
    assert (row.tp, row.fp, row.fn) == (1, 2, 1)  # the null source isn't excluded


def test_reverse_quirk(spark):
    manual = spark.createDataFrame([("a", "x")], "source string, target string")
    auto = spark.createDataFrame([("b", "x")], "source string, target string")
    ccs = spark.createDataFrame([("a", "1")], "source string, ccs_id string")
    row = evaluate.performance(evaluate.validate_reverse(manual, auto, ccs, None)).first()
    assert (row.tp, row.fp, row.fn) == (0, 0, 0)


def test_roundtrip(spark):
    f = spark.createDataFrame([("a", "x"), ("b", "x")], "source string, target string")
    r = spark.createDataFrame([("a", "x")], "source string, target string")
    assert tuple(evaluate.roundtrip(f, r).first()) == (2, 1, 0.5)


def test_oracle(spark):
    emitted = spark.createDataFrame([("a", str(i)) for i in range(313)], "source string, target string")
    truth = spark.createDataFrame([("a", str(i)) for i in range(500)], "source string, target string")
    assert round(evaluate.oracle(emitted, truth).first().oracle_f1, 3) == 0.770


def test_emission(spark):
    df = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("a", "z", 0.2), ("b", "x", 0.1)], "source string, target string, score double")
    assert rows(rerank.emit(df, 0.95, 0.85), "source", "target") == [("a", "x"), ("a", "y"), ("b", "x")]


def test_margin_and_encoding(spark):
    df = spark.createDataFrame([("a", "x", 0.9, 1.0), ("a", "y", 0.9, 0.5), ("a", "z", 0.7, 0.2), ("b", "x", 0.9, 1.0)], "source string, target string, ens_mean_rel double, ens_rrf double")
    got = {(r.source, r.target): round(r.ens_margin, 6) for r in features.context(df).collect()}
    assert got == {("a", "x"): 0.2, ("a", "y"): 0.2, ("a", "z"): 0.0, ("b", "x"): 1.9}
    train = spark.createDataFrame([("p", 1)] * 5 + [("p", 0)] * 5 + [("q", 0)] * 40, "chapter_pair string, y int")
    rate = {r[0]: r[1] for r in rerank.target_encoding(train).collect()}
    assert round(rate["p"], 6) == round((5 + 2) / 30, 6)
    unseen = spark.createDataFrame([("new",)], "chapter_pair string")
    assert rerank.encode(unseen, train).first().chapter_rate == 0.1


def test_single_similarity_has_z_zero(spark):
    assert features.similarity_windows(sims(spark, 0.9), "m", "sim").first().simz_m == 0.0


def test_folds(spark):
    cats = spark.createDataFrame([(f"c{k}{i}", k) for k, n in zip("abcde", (5, 4, 3, 3, 1), strict=True) for i in range(n)], "source string, ccs_id string")
    sizes = {r[0]: r[1] for r in rerank.category_folds(cats, 2).collect()}
    load = [sum(n for k, n in zip("abcde", (5, 4, 3, 3, 1), strict=True) if sizes[k] == f) for f in (0, 1)]
    assert sorted(load) == [8, 8]
    dealt = rerank.folds(cats, 3).groupBy("fold").count().collect()
    assert max(r["count"] for r in dealt) - min(r["count"] for r in dealt) <= 1


def test_expansion_takes_near_candidates_of_accepted_pairs(spark):
    import random

    rng = random.Random(7)
    pairs = [(s, t, rng.choice([0.02, 0.06, 0.15, 0.5, 0.95]), rng.randrange(2), f"{rng.choice('AB')}{rng.randrange(30)}") for s in range(12) for t in range(15)]
    df = spark.createDataFrame(pairs, "source int, target int, score double, y int, code string").repartition(3)
    got = {(r.floor, r.span): tuple(r)[2:] for r in triage.expand(df, 0.9).collect()}
    n_true = sum(p[3] for p in pairs)
    for floor, span in [(None, None), *[(f, s) for f in (0.05, 0.1, 0.2) for s in (2, 5)]]:
        out = [p for p in pairs if p[2] >= 0.9]
        if floor is not None:
            out += [p for p in pairs if floor <= p[2] < 0.9 and any(a[0] == p[0] and a[2] >= 0.9 and a[4][0] == p[4][0] and abs(int(a[4][1:]) - int(p[4][1:])) <= span for a in pairs)]
        tp = sum(p[3] for p in out)
        assert got[floor, span] == (len(out), tp, round(tp / len(out), 6), round(tp / n_true, 6))


def test_operating_point_prefers_smaller_tau(spark):
    points = spark.createDataFrame([(0.5, 10, 0.9), (0.6, 10, 0.95)], "tau double, n_emitted long, precision double")
    assert triage.operating_points(points, [0.8]).first().tau == 0.5


def test_competition_rank(spark):
    grid = spark.createDataFrame([("g", m, f) for m, f in (("a", 0.53), ("b", 0.53), ("c", 0.52))], "g string, model string, f1 double")
    assert sorted(r.rank_best for r in sweep.sensitivity(grid, ["g", "model"], ["g"]).collect()) == [1, 1, 3]


def test_cosine_blocks_agree_with_plain(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((30, 4)).astype(np.float32)
    s = spark.createDataFrame([(2 * i, x[i].tolist()) for i in range(15)], "id long, vec array<float>")
    t = spark.createDataFrame([(2 * i + 1, x[15 + i].tolist()) for i in range(15)], "id long, vec array<float>")
    got = {(r.source, r.target): r.m for r in cosine_pairs(s, t, {"m": slice(0, 4)}, block=4).collect()}
    assert len(got) == 225
    for (a, b), v in got.items():
        p, q = x[a // 2].astype(float), x[15 + b // 2].astype(float)
        assert abs(v - p @ q / np.linalg.norm(p) / np.linalg.norm(q)) < 1e-6


def test_best_cosines_equal_those_of_all_pairs(spark):
    import numpy as np

    x = np.random.default_rng(1).integers(-2, 3, (60, 3)).astype(np.float32)  # many ties, zero vectors, negative bests
    s = spark.createDataFrame([(2 * i, x[i].tolist()) for i in range(30)] + [(None, [1.0, 1.0, 1.0]), (1000, None)], "id long, vec array<float>")
    t = spark.createDataFrame([(2 * i + 1, x[30 + i].tolist()) for i in range(30)], "id long, vec array<float>")
    every = [tuple(r) for r in cosine_pairs(s, t, {"m": slice(0, 3)}, block=7).collect()]
    assert len(every) == 900
    for side, at, other in (("source", 0, 1), ("target", 1, 0)):
        for k, threshold in ((0, 0.9), (3, None), (2, 0.5), (40, None)):
            want = set()
            for code in {p[at] for p in every}:
                mine = sorted((p for p in every if p[at] == code), key=lambda p: (-p[2], p[other]))
                want |= {p for i, p in enumerate(mine) if i < k or threshold is not None and p[2] >= threshold * mine[0][2]}
            got = cosine_best(s, t, slice(0, 3), k=k, threshold=threshold, side=side, block=7)
            assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
            assert {(r.source, r.target, r.sim) for r in got.collect()} == want


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("m", "a", "x", 0.5)], files.SIMILARITY)
    files.write_csv(df, str(tmp_path / "s.csv"))
    assert files.read_table(spark, str(tmp_path / "s.csv"), files.SIMILARITY).collect() == df.collect()
    assert files.read_table(spark, str(tmp_path / "none.csv"), required=False) is None
    files.write_parts(df, str(tmp_path / "p"), ["model"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    (tmp_path / "wide.csv").write_text("target,a,b\nx,0.5,\ny,0.1,0.2\n")
    assert files.read_wide(spark, str(tmp_path / "wide.csv"), "m").count() == 3
    (tmp_path / "words.json").write_text('{"filler_words": ["and", "due to"]}')
    assert files.read_words(spark, str(tmp_path / "words.json")) == ["and", "due to"]


def test_setting_is_one_row(spark):
    grid = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.6), ("b", 3, 0.4)], "model string, n int, f1 double")
    assert sweep.setting(grid, model="a")["n"] == 1
    with pytest.raises(LookupError, match="no row"):
        sweep.setting(grid, model="c")
    with pytest.raises(LookupError, match="more than one"):
        sweep.setting(grid, model="b")


def test_tags_alike_but_for_case():
    assert sweep.unique_tags(["A", "b"]) == ["A", "b"]
    with pytest.raises(ValueError, match="alike"):
        sweep.unique_tags(["A", "b", "a"])


def test_settings_are_chosen_on_the_other_folds(spark):
    # setting 1 is best in fold 0 alone, so fold 0 itself must not get it
    rows = [(1, 0, 10, 10, 10), (1, 1, 0, 10, 10), (2, 0, 5, 10, 10), (2, 1, 5, 10, 10)]
    out = sweep.choose_by_fold(spark.createDataFrame(rows, "n int, fold int, tp long, n_emitted long, n_true long"), ["n"])
    assert {(r["fold"], r["n"], r["train_f1"]) for r in out.collect()} == {(0, 2, 0.5), (1, 1, 1.0)}
    empty = sweep.choose_by_fold(spark.createDataFrame([(1, 0, 0, 0, 0)], "n int, fold int, tp long, n_emitted long, n_true long"), ["n"]).first()
    assert (empty["train_f1"], empty["f1"]) == (0.0, 0.0)


def test_first_rows_with_and_without_ties(spark):
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate([3.0, 2.0, 2.0, None])], "g string, id int, v double")
    assert sorted(r["id"] for r in triage.first_by(df, ["g"], F.col("v"), ["id"], 2).collect()) == [0, 1]
    assert sorted(r["id"] for r in triage.first_by(df, ["g"], F.col("v"), ["id"], 2, ties=True).collect()) == [0, 1, 2]


def test_compacted_values_keep_their_order(spark):
    df = spark.createDataFrame([(None, 1.0, None, 2.0), (None, None, None, None)], "a double, b double, c double, d double")
    assert [tuple(r) for r in df.select(*metrics.compact(["a", "b", "c", "d"], ["x", "y", "z"])).collect()] == [(1.0, 2.0, None), (None, None, None)]


def test_slope_of_the_last_points(spark):
    points = spark.createDataFrame([(float(x), 100.0 if x < 4 else 2.0 * x) for x in range(1, 7)], "x double, y double")
    assert tuple(triage.last_slope(points, "x", "y").first()) == (3, 2.0)


def test_settings_have_one_name_each(spark):
    df = spark.createDataFrame([("a", 0.95, 10, None)], "m string, t double, n int, r int")
    assert df.select(sweep.setting_key("m", "t", "n", "r")).first()[0] == "a|0.95|10|none"


def test_grids_by_first_entry_equal_a_loop(spark):
    import random

    from codeweave.operators import rules
    from pyspark.sql import functions as F

    rng = random.Random(9)
    sims = [(s, t, round(rng.random(), 2)) for s in range(12) for t in range(10) if rng.random() < 0.7]
    cooc = [(s, t, rng.randrange(1, 5)) for s in range(12) for t in range(10) if rng.random() < 0.5]
    truth = [(s, rng.randrange(10)) for s in range(12)]
    frame = lambda rows, last: spark.createDataFrame(rows, f"source long, target long{last}").repartition(3)
    chapters, align = (F.col("source") % 3 + 1, F.col("target") % 3 + 1), {1: [1, 2], 2: [2], 3: [3]}
    excluded = spark.createDataFrame([(4,)], "source long")
    thresholds, tops = [0.9, 0.5, 0.7], [1, 3, 5]
    s, c, t = frame(sims, ", sim double"), frame(cooc, ", freq long"), frame(truth, "")
    got = {(r.threshold, r.top_n, r.rule): (r.tp, r.fp, r.fn) for r in sweep.rule_grid(s, c, t, excluded, chapters, align, thresholds, tops).collect()}
    known = {p for p in truth if p[0] != 4}
    assert len(got) == 36
    for thr in thresholds:
        for n in tops:
            near = lambda a, b: (b % 3 + 1) in align[a % 3 + 1]
            best = {a: max(x[2] for x in sims if x[0] == a) for a in {x[0] for x in sims}}
            in_sim = {(a, b): v for a, b, v in sims if v >= thr * best[a] and near(a, b)}
            in_cooc = {}
            for a in range(12):
                first = sorted((x for x in cooc if x[0] == a), key=lambda x: (-x[2], x[1]))[:n]
                in_cooc |= {(a, b): v for _, b, v in first if near(a, b)}
            top_sim = {p for p, v in in_sim.items() if v == max(x for q, x in in_sim.items() if q[0] == p[0])}
            top_cooc = {p for p, v in in_cooc.items() if v == max(x for q, x in in_cooc.items() if q[0] == p[0])}
            flags = {"top_sim": top_sim, "top_cooc": top_cooc, "in_both": in_sim.keys() & in_cooc.keys()}
            for rule, names in rules.RULES.items():
                out = {p for name in names for p in flags[name] if p[0] != 4}
                assert got[thr, n, rule] == (len(out & known), len(out - known), len(known - out))
