"""Nested cross-validation of rerankers: inner folds choose retrieval, tau and rho, outer folds judge the choice.

Every fold's scores are rows of one table. Settings are judged by counts: a row's place among the taus and the set of rhos that emit it go into small cells, and
the grid is summed over cells, so what is shuffled doesn't grow with the number of settings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import metrics
from . import rerank
from .boost import Boost, Fit, Fitted, fit_all

TAUS = [round(0.05 * i, 2) for i in range(1, 20)]
RHOS = [0.3, 0.5, 0.7, 0.85, 1.0]


@dataclass(frozen=True)
class Retrieval:
    """Which candidates are eligible: a similarity rank within k or a count rank within n, and the chapter if asked."""

    k: int
    n: int
    chapter: bool

    def eligible(self) -> Column:
        keep = (F.col("best_rank") <= self.k) | (F.col("cooc_rank") <= self.n)
        return keep & (F.col("chapter_ok") == 1) if self.chapter else keep


#: What the inner folds pick between, in order: the first of equals wins.
RETRIEVALS = [Retrieval(k, n, c) for k in (10, 25, 50) for n in (10, 30, 50) for c in (True, False)]
#: The retrieval sweep with a refit each.
SWEEP = [Retrieval(k, n, c) for k in (5, 10, 25, 50) for n in (10, 30, 50) for c in (True, False)]


def deal(codes: DataFrame, outer: int, inner: int, *, column: str = "source", seed: int = rerank.SEED) -> DataFrame:
    """(code, fold, inner): the code's outer fold and, for each outer fold but its own, its inner fold among that one's training codes (null in its own place)."""
    folds = rerank.folds(codes, outer, seed=seed, column=column)
    each = folds.withColumn("o", F.explode(F.array(*map(F.lit, range(outer))))).where("o <> fold")
    ranks = rerank.ranks(each, F.md5(F.concat_ws(":", F.col(column).cast("string"), "o", F.lit(seed))), column, by=["o"])
    dealt = ranks.groupBy(column, "fold").agg(F.map_from_entries(F.collect_list(F.struct("o", ((F.col("rank") - 1) % inner).cast("int")))).alias("m"))
    return dealt.select(column, "fold", F.array(*[F.try_element_at("m", F.lit(o)) for o in range(outer)]).alias("inner"))


def cells(scored: DataFrame, by: list[str], taus: Column, rhos: list[float]) -> DataFrame:
    """(by, above, mask, tp, n): rows by how many taus (an ascending array) their score reaches and by which rhos emit them; a source's best rows reach all.
    A column best, where there is one, is the largest score of the row's source and group."""
    best = F.col("best") if "best" in scored.columns else F.max("score").over(W.partitionBy(*by, "source"))
    top = F.col("score") == F.col("best")
    mask = sum((F.when(F.col("score") >= F.lit(r) * F.col("best"), 1 << i).otherwise(0) for i, r in enumerate(rhos)), F.lit(0))
    rows = scored.withColumn("best", best)
    return rows.groupBy(*by, F.when(top, F.size(taus)).otherwise(F.size(F.filter(taus, lambda t: t <= F.col("score")))).alias("above"), mask.alias("mask")).agg(F.sum("y").alias("tp"), F.count("*").alias("n"))


def emission_grid(scored: DataFrame, by: list[str], rhos: list[float] = RHOS, *, taus: list[float] | None = None, taus_col: str | None = None) -> DataFrame:
    """(by, tau_at, rho_at, tp, n_emitted) of every setting: rows of score >= tau, or >= rho * their source's best, or the best itself. taus: numbers, or an array
    column that is one for each group; tau_at and rho_at are places in them."""
    n_taus = len(taus) if taus is not None else 19
    small = cells(scored, by, F.array(*map(F.lit, taus)) if taus is not None else F.col(taus_col), rhos)
    small = small.withColumn("rho_at", F.explode(F.sequence(F.lit(0), F.lit(len(rhos) - 1))))
    reach = F.when(F.expr("(mask & shiftleft(1, rho_at)) != 0"), n_taus).otherwise(F.col("above"))
    small = small.groupBy(*by, "rho_at", reach.alias("reach")).agg(F.sum("tp").alias("tp"), F.sum("n").alias("n")).where("reach > 0")
    each = small.withColumn("tau_at", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)))
    return each.groupBy(*by, "tau_at", "rho_at").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n_emitted"))


def eligible_copies(scored: DataFrame, retrievals: list[Retrieval], by: list[str]) -> DataFrame:
    """A copy for each retrieval (its place as column retrieval) that a row is eligible under, with the best score of its source (and `by`) under it. The best ones are
    found before rows are copied, so copies are neither shuffled nor sorted."""
    w = W.partitionBy(*by, "source")
    bests = scored.withColumn("__bests", F.array(*[F.max(F.when(r.eligible(), F.col("score"))).over(w) for r in retrievals]))
    options = F.array_compact(F.array(*[F.when(r.eligible(), F.struct(F.lit(i).alias("retrieval"), F.col("__bests")[i].alias("best"))) for i, r in enumerate(retrievals)]))
    return bests.withColumn("__option", F.explode(options)).select(*scored.columns, "__option.retrieval", "__option.best")


def choose(counts: DataFrame, totals: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The setting of the largest F1 of each group, the first in `order` on ties; totals: (by, n_true)."""
    f1 = F.when(F.col("n_emitted") + F.col("n_true") > 0, 2 * F.col("tp") / (F.col("n_emitted") + F.col("n_true"))).otherwise(0.0)
    both = counts.join(F.broadcast(totals), by).withColumn("inner_f1", F.round(f1, 9))
    first = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("inner_f1"), *order))
    return both.withColumn("rn", first).where("rn = 1").select(*by, *order, "inner_f1")


def choose_setting(inner: DataFrame, truth: DataFrame, retrievals: list[Retrieval], taus: list[float] = TAUS, rhos: list[float] = RHOS) -> DataFrame:
    """(outer, retrieval, tau_at, rho_at, inner_f1): the first of the best of all settings for each outer fold.

    inner: (outer, source, target, y, score, best_rank, cooc_rank, chapter_ok) of training sources; truth: (outer, n_true) over them."""
    grid = emission_grid(eligible_copies(inner, retrievals, ["outer"]), ["outer", "retrieval"], rhos, taus=taus)
    return choose(grid, truth, ["outer"], ["retrieval", "tau_at", "rho_at"])


def choose_fixed(rows: DataFrame, truth: DataFrame, retrievals: list[Retrieval], taus: list[float] = TAUS, rhos: list[float] = RHOS) -> DataFrame:
    """`choose_setting` where scores are the same for every outer fold: rows have their source's fold, each is looked at once, and an outer fold's counts are those of all
    the other folds."""
    own = emission_grid(eligible_copies(rows, retrievals, []), ["fold", "retrieval"], rhos, taus=taus)
    setting = ["retrieval", "tau_at", "rho_at"]
    grid = own.join(F.broadcast(truth.select("outer")), F.col("fold") != F.col("outer")).groupBy("outer", *setting).agg(F.sum("tp").alias("tp"), F.sum("n_emitted").alias("n_emitted"))
    return choose(grid, truth, ["outer"], setting)


def inner_totals(known: DataFrame, folds: DataFrame) -> DataFrame:
    """(outer, n_true): true pairs of each outer fold's training sources."""
    per = known.join(folds.select("source", "fold"), "source").groupBy("fold").agg(F.count("*").alias("n"))
    every = per.agg(F.sum("n").alias("all"))
    return per.crossJoin(F.broadcast(every)).select(F.col("fold").alias("outer"), (F.col("all") - F.col("n")).alias("n_true"))


def fold_fits(features: list[str], outer: int, inner: int, setting: Boost, encoded: bool = True) -> list[Fit]:
    """inner + 1 fits for each outer fold: those that score its training sources out of fold, then the one that scores its own."""
    out = []
    for o in range(outer):
        mine = F.col("fold") != o
        for i in range(inner):
            at = F.col("inner")[o] == i
            out.append(Fit(f"{o}/{i}", mine & ~at, mine & at, features, encoded, setting))
        out.append(Fit(f"{o}", mine, ~mine, features, encoded, setting))
    return out


@dataclass
class Validated:
    """Result of a nested cross-validation: chosen settings, emitted pairs with their fold, counts and metrics by fold, out-of-fold scores, and the fits."""

    chosen: DataFrame
    scored: DataFrame
    emitted: DataFrame
    folds: DataFrame
    fitted: Fitted

    def pooled(self) -> DataFrame:
        sums = self.folds.agg(*[F.sum(c).alias(c) for c in ("tp", "n_emitted", "n_true")])
        return sums.withColumns(metrics.exact(F.col("tp"), F.col("n_emitted"), F.col("n_true")))


def validate(
    table: DataFrame, features: list[str], known: DataFrame, *, use: list[str] | None = None, outer: int = 5, inner: int = 3, retrievals: list[Retrieval] = RETRIEVALS, before: Retrieval | None = None,
    setting: Boost = Boost(), category: str | None = "pair", encoded: bool = True, rhos: list[float] = RHOS,
) -> Validated:
    """Nested cross-validation over a binned table with source, target, y, fold, inner, best_rank, cooc_rank, chapter_ok and the category.

    use: the features looked at (all); before: a retrieval that filters rows before anything is learnt, else it only filters what is scored. known: true pairs
    (source, target) that recall counts. Ranking objectives have unbounded scores, so their taus are quantiles of the inner scores."""
    rows = table if before is None else table.where(before.eligible())
    fits = fold_fits(use or features, outer, inner, setting, encoded)
    fitted = fit_all(rows, features, fits, category=category)
    ranks = table.select("source", "target", "best_rank", "cooc_rank", "chapter_ok")
    scored = fitted.scores().join(ranks, ["source", "target"]).withColumns({"outer": F.floor(F.col("fit") / (inner + 1)).cast("int"), "part": (F.col("fit") % (inner + 1)).cast("int")})
    scored = scored.drop("fit").persist()
    inside, outside = scored.where(F.col("part") < inner), scored.where(F.col("part") == inner)
    folds = table.select("source", "fold").distinct()
    totals = inner_totals(known, folds)
    if setting.objective == "logistic":
        chosen = with_taus(choose_setting(inside, totals, retrievals, rhos=rhos))
    else:
        at = F.array(*[F.lit(0.5 + 0.495 * i / 18) for i in range(19)])
        quantiles = inside.groupBy("outer").agg(F.percentile("score", at).alias("taus"))
        copies = eligible_copies(inside.join(F.broadcast(quantiles), "outer"), retrievals, ["outer"])
        chosen = choose(emission_grid(copies, ["outer", "retrieval"], rhos, taus_col="taus"), totals, ["outer"], ["retrieval", "tau_at", "rho_at"])
        chosen = chosen.join(quantiles, "outer").withColumn("tau", F.col("taus")[F.col("tau_at")]).drop("taus")
    chosen = spelled_out(chosen, retrievals, rhos).persist()
    mine, emitted, by_fold = judge(outside, chosen, known, folds)
    return Validated(chosen, mine, emitted, by_fold, fitted)


def spelled_out(chosen: DataFrame, retrievals: list[Retrieval], rhos: list[float]) -> DataFrame:
    """(outer, k, n, chapter, tau, rho, inner_f1) from the settings' places."""
    named = F.array(*[F.struct(F.lit(r.k).alias("k"), F.lit(r.n).alias("n"), F.lit(r.chapter).alias("chapter")) for r in retrievals])[F.col("retrieval")]
    return chosen.withColumns({"r": named, "rho": F.array(*map(F.lit, rhos))[F.col("rho_at")]}).select("outer", "r.k", "r.n", "r.chapter", "tau", "rho", "inner_f1")


def judge(outside: DataFrame, chosen: DataFrame, known: DataFrame, folds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(eligible rows, emitted rows, counts and metrics by fold) of each outer fold's own rows under its chosen setting."""
    mine = outside.join(F.broadcast(chosen), "outer")
    mine = mine.where(((F.col("best_rank") <= F.col("k")) | (F.col("cooc_rank") <= F.col("n"))) & (~F.col("chapter") | (F.col("chapter_ok") == 1)))
    emitted = rerank.emit(mine, F.col("tau"), F.col("rho"), ["outer"])
    counts = emitted.groupBy("outer").agg(F.sum("y").alias("tp"), F.count("*").alias("n_emitted"))
    truth = known.join(folds, "source").groupBy(F.col("fold").alias("outer")).agg(F.count("*").alias("n_true"))
    by_fold = chosen.join(truth, "outer", "left").join(counts, "outer", "left").fillna(0, subset=["tp", "n_emitted", "n_true"])
    return mine, emitted, by_fold.withColumns(metrics.exact(F.col("tp"), F.col("n_emitted"), F.col("n_true")))


def with_taus(chosen: DataFrame, taus: list[float] = TAUS) -> DataFrame:
    return chosen.withColumn("tau", F.array(*map(F.lit, taus))[F.col("tau_at")])


def in_flight(jobs: Iterable[Callable[[], DataFrame]], most: int = 3) -> list[DataFrame]:
    """Results of jobs of one session, at most `most` at a time, in their order."""
    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(lambda job: job(), jobs))


def ablation(table: DataFrame, features: list[str], known: DataFrame, variants: dict[str, tuple[Callable[[str], bool], str, bool]], at: Retrieval, setting: Boost = Boost(), **more) -> DataFrame:
    """(variant, objective, n_features, metrics): nested cross-validation of each variant: (which features stay, objective, whether the category's rate stays)."""

    def run(name: str) -> Callable[[], tuple]:
        keep, objective, encoded = variants[name]
        use = [f for f in features if keep(f)]

        def job() -> tuple:
            row = validate(table, features, known, use=use, retrievals=[at], before=at, setting=replace(setting, objective=objective), encoded=encoded, **more).pooled().first()
            return name, objective, len(use) + encoded, row["tp"], row["n_emitted"], row["n_true"], row["precision"], row["recall"], row["f1"], row["accuracy"]

        return job

    rows = in_flight([run(name) for name in variants])
    return table.sparkSession.createDataFrame(rows, "variant string, objective string, n_features int, tp long, n_emitted long, n_true long, precision double, recall double, f1 double, accuracy double")


def retrieval_sweep(table: DataFrame, features: list[str], known: DataFrame, retrievals: list[Retrieval] = SWEEP, setting: Boost = Boost(), most: int = 3, **more) -> DataFrame:
    """(k, n, chapter, metrics): every retrieval refitted, its tau and rho chosen inside."""

    def run(r: Retrieval) -> Callable[[], tuple]:
        def job() -> tuple:
            row = validate(table, features, known, retrievals=[r], before=r, setting=setting, **more).pooled().first()
            return r.k, r.n, r.chapter, row["tp"], row["n_emitted"], row["n_true"], row["precision"], row["recall"], row["f1"], row["accuracy"]

        return job

    rows = in_flight([run(r) for r in retrievals], most)
    return table.sparkSession.createDataFrame(rows, "k int, n int, chapter boolean, tp long, n_emitted long, n_true long, precision double, recall double, f1 double, accuracy double")


def held_out_metrics(scored: DataFrame, known: DataFrame, by: list[str], tau: float, rho: float) -> DataFrame:
    """(by, tp, n_emitted, n_true, metrics) of rows emitted at a fixed setting against all known pairs."""
    sums = rerank.emit(scored, tau, rho, by).groupBy(*by).agg(F.sum("y").alias("tp"), F.count("*").alias("n_emitted"))
    out = sums.crossJoin(F.broadcast(known.agg(F.count("*").alias("n_true"))))
    return out.withColumns(metrics.exact(F.col("tp"), F.col("n_emitted"), F.col("n_true")))


def learning_curve(table: DataFrame, features: list[str], known: DataFrame, sizes: list[int], repeats: int, at: Retrieval, tau: float, rho: float, setting: Boost = Boost(), outer: int = 5, most: int = 3) -> DataFrame:
    """(n, f1, sd, repeats): mean F1 over repeats of fits on n training sources of each outer fold; null for sizes beyond the sources there are.

    table has fold; a repeat takes the first n of the fold's training sources by a seeded hash, so sizes are nested."""
    sources = table.select("source", "fold").distinct()
    each = sources.withColumn("o", F.explode(F.array(*map(F.lit, range(outer))))).where("o <> fold").withColumn("rep", F.explode(F.array(*map(F.lit, range(repeats)))))
    ranks = rerank.ranks(each, F.md5(F.concat_ws(":", F.col("source").cast("string"), "o", "rep", F.lit(setting.seed))), "source", by=["o", "rep"])
    turn = ranks.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct((F.col("o") * repeats + F.col("rep")).cast("int"), "rank"))).alias("turns"))
    least = min((r["n"] for r in ranks.groupBy("o", "rep").agg(F.count("*").alias("n")).collect()), default=0)
    rows = table.where(at.eligible()).join(turn, "source").persist()

    def run(n: int) -> Callable[[], list[tuple]]:
        def job() -> list[tuple]:
            fits = []
            for o in range(outer):
                for rep in range(repeats):
                    place = F.try_element_at("turns", F.lit(o * repeats + rep))
                    fits.append(Fit(f"{o}/{rep}", F.coalesce(place <= n, F.lit(False)), F.col("fold") == o, features, True, setting))
            scored = fit_all(rows, features, fits, category="pair").scores().withColumn("rep", F.col("fit") % repeats)
            found = held_out_metrics(scored, known, ["rep"], tau, rho).agg(F.round(F.avg("f1"), 6).alias("f1"), F.round(F.stddev_samp("f1"), 6).alias("sd"), F.count("*").alias("repeats")).first()
            return [(n, found["f1"], found["sd"], found["repeats"])]

        return job

    done = [x for part in in_flight([run(n) for n in sizes if n <= least], most) for x in part]
    done += [(n, None, None, 0) for n in sizes if n > least]
    rows.unpersist()
    return table.sparkSession.createDataFrame(done, "n int, f1 double, sd double, repeats long")


def holdout_cost(table: DataFrame, features: list[str], known: DataFrame, categories: DataFrame, repeats: int, at: Retrieval, tau: float, rho: float, setting: Boost = Boost(), outer: int = 5) -> DataFrame:
    """(split, precision, recall, f1, sd, repeats): folds of sources against folds of whole categories (source, ccs_id)."""
    rows, fits, names = table.where(at.eligible()).drop("fold"), [], []
    for rep in range(repeats):
        by_code = rerank.folds(categories, outer, seed=setting.seed + rep + 1).withColumnRenamed("fold", f"code_{rep}")
        by_category = categories.join(F.broadcast(rerank.category_folds(categories, outer, seed=setting.seed + rep + 1)), "ccs_id").select("source", F.col("fold").alias(f"category_{rep}"))
        rows = rows.join(by_code, "source").join(by_category, "source")
        for mode in ("code", "category"):
            for o in range(outer):
                mine = F.col(f"{mode}_{rep}") == o
                fits.append(Fit(f"{mode}/{rep}/{o}", ~mine, mine, features, True, setting))
                names.append((len(fits) - 1, mode, rep))
    spark = table.sparkSession
    scored = fit_all(rows, features, fits, category="pair").scores().join(F.broadcast(spark.createDataFrame(names, "fit int, split string, rep int")), "fit")
    per = held_out_metrics(scored, known, ["split", "rep"], tau, rho)
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return per.groupBy("split").agg(mean("precision"), mean("recall"), mean("f1"), F.round(F.stddev_samp("f1"), 6).alias("sd"), F.count("*").alias("repeats"))
