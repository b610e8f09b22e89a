"""Parameter grids as one job, and summaries of their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import metrics
from ..functions.chapters import Alignment, distance
from .evaluate import without
from .rules import RULES


def _entries(sims: DataFrame, cooc: DataFrame, known: DataFrame, excluded: DataFrame, chapters: tuple[Column, Column], align: Alignment, thresholds: list[float], top_ns: list[int]) -> DataFrame:
    """(source, hit, thr_at, top_at, top_sim, top_cooc) of every pair that enters a pool, each once: how many of the thresholds its similarity reaches, the
    place of the first list length that holds it (their number: none), and whether it is its source's best by similarity or count among the pairs of near chapters.

    Pools only grow along a grid, and the best of a source are in every pool that has any of its kind, so these tell a pair's flags at every point of the grid."""
    rising = sorted(top_ns)
    best = F.max("sim").over(W.partitionBy("source"))
    s = sims.withColumn("__best", best).where(F.col("sim") >= F.lit(min(thresholds)) * F.col("__best"))
    s = s.select("source", "target", "sim", sum((F.when(F.col("sim") >= F.lit(t) * F.col("__best"), 1).otherwise(0) for t in thresholds), F.lit(0)).alias("thr_at"))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("freq"), "target"))
    c = cooc.withColumn("rk", rank).where(F.col("rk") <= rising[-1])
    c = c.select("source", "target", "freq", sum((F.when(F.col("rk") > n, 1).otherwise(0) for n in rising), F.lit(0)).alias("top_at"))
    near = distance(*chapters, align) < 1
    pairs = without(s.join(c, ["source", "target"], "full").where(near), excluded)
    w = W.partitionBy("source")
    on = lambda v: F.coalesce(F.col(v) == F.max(v).over(w), F.lit(False))
    pairs = pairs.select("source", "target", F.coalesce("thr_at", F.lit(0)).alias("thr_at"), F.coalesce("top_at", F.lit(len(rising))).alias("top_at"), on("sim").alias("top_sim"), on("freq").alias("top_cooc"))
    hits = pairs.join(known.withColumn("hit", F.lit(1)), ["source", "target"], "left")
    return hits.select("source", F.coalesce("hit", F.lit(0)).alias("hit"), "thr_at", "top_at", "top_sim", "top_cooc")


def _counted(entries: DataFrame, by: list[str], thresholds: list[float], top_ns: list[int]) -> tuple[DataFrame, DataFrame]:
    """(threshold, top_n, rule, by, tp, n_emitted) and the table of all settings. Pairs are counted by what `_entries` tells of them, into cells whose number
    hangs on the grid alone; only cells meet the grid."""
    spark = entries.sparkSession
    cells = entries.groupBy(*by, "thr_at", "top_at", "top_sim", "top_cooc").agg(F.sum("hit").alias("tp"), F.count("*").alias("n"))
    thr = spark.createDataFrame([(float(t), i) for i, t in enumerate(sorted(thresholds))], "threshold double, thr_i int")
    tops = spark.createDataFrame([(int(n), i) for i, n in enumerate(sorted(top_ns))], "top_n int, top_i int")
    every = thr.crossJoin(F.broadcast(tops)).crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in RULES], "rule int")))
    sim, cooc = F.col("thr_at") > F.col("thr_i"), F.col("top_at") <= F.col("top_i")
    flags = {"top_sim": sim & F.col("top_sim"), "top_cooc": cooc & F.col("top_cooc"), "in_both": sim & cooc}
    on = F.lit(False)
    for number, names in RULES.items():
        on = F.when(F.col("rule") == number, reduce(lambda a, b: a | b, [flags[x] for x in names])).otherwise(on)
    met = cells.crossJoin(F.broadcast(every)).where(on)
    return met.groupBy("threshold", "top_n", "rule", *by).agg(F.sum("tp").cast("long").alias("tp"), F.sum("n").alias("n_emitted")), every.select("threshold", "top_n", "rule")


def rule_grid(sims: DataFrame, cooc: DataFrame, truth: DataFrame, excluded: DataFrame, chapters: tuple[Column, Column], align: Alignment, thresholds: list[float], top_ns: list[int]) -> DataFrame:
    """A row for each (threshold, top_n, rule) with counts and rounded metrics; the grid never multiplies the pairs."""
    known = without(truth.select("source", "target").distinct(), excluded)
    sums, every = _counted(_entries(sims, cooc, known, excluded, chapters, align, thresholds, top_ns), [], thresholds, top_ns)
    n = known.agg(F.count("*").alias("n_true"))
    out = every.join(sums.withColumnRenamed("n_emitted", "n_auto"), ["threshold", "top_n", "rule"], "left").fillna(0, subset=["tp", "n_auto"]).crossJoin(F.broadcast(n))
    tp, fp, fn = F.col("tp"), F.col("n_auto") - F.col("tp"), F.col("n_true") - F.col("tp")
    return out.select("threshold", "top_n", "rule", "tp", fp.alias("fp"), fn.alias("fn"), "n_auto").withColumns(metrics.rounded(F.col("tp"), F.col("fp"), F.col("fn")))


def fold_grid(sims: DataFrame, cooc: DataFrame, truth: DataFrame, excluded: DataFrame, folds: DataFrame, chapters: tuple[Column, Column], align: Alignment, thresholds: list[float], top_ns: list[int]) -> DataFrame:
    """The grid's counts by fold of the sources: (threshold, top_n, rule, fold, tp, n_emitted, n_true); folds: (source, fold)."""
    known = without(truth.select("source", "target").distinct(), excluded)
    entries = _entries(sims, cooc, known, excluded, chapters, align, thresholds, top_ns).join(folds, "source")
    sums, every = _counted(entries, ["fold"], thresholds, top_ns)
    n = known.join(folds, "source").groupBy("fold").agg(F.count("*").alias("n_true"))
    return every.crossJoin(F.broadcast(n)).join(sums, ["threshold", "top_n", "rule", "fold"], "left").fillna(0, subset=["tp", "n_emitted"])


def candidate_study(sims: DataFrame, cooc: DataFrame, truth: DataFrame, near: Column, relative: list[float], topk: list[int], top_ns: list[int]) -> DataFrame:
    """(mode, parameter, top_n, chapter, n_emitted, tp, codes, n_true) of every design: pairs of a relative threshold or of each source's first k, with those of
    the first n counts, with and without the chapter filter. sims: source, target, sim, rank, best; near: whether chapters agree.

    Like the grids of rules: a pair, and a source, is counted by the first threshold, list and count list that holds it, and cells meet the designs."""
    spark = sims.sparkSession
    ks, ns = sorted(topk), sorted(top_ns)
    reached = sum((F.when(F.col("sim") >= F.lit(t) * F.col("best"), 1).otherwise(0) for t in relative), F.lit(0))
    past = lambda rank, lists: sum((F.when(F.col(rank) > n, 1).otherwise(0) for n in lists), F.lit(0))
    s = sims.select("source", "target", reached.alias("thr_at"), past("rank", ks).alias("k_at")).where((F.col("thr_at") > 0) | (F.col("k_at") < len(ks)))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("freq"), "target"))
    c = cooc.withColumn("rk", rank).where(F.col("rk") <= ns[-1]).select("source", "target", past("rk", ns).alias("n_at"))
    pairs = s.join(c, ["source", "target"], "full").fillna({"thr_at": 0, "k_at": len(ks), "n_at": len(ns)}).withColumn("near", F.coalesce(near, F.lit(False)))
    pairs = pairs.join(truth.select("source", "target").distinct().withColumn("hit", F.lit(1)), ["source", "target"], "left").fillna(0, subset=["hit"])
    at = ["thr_at", "k_at", "n_at"]
    cells = pairs.groupBy(*at, "near").agg(F.count("*").alias("n_emitted"), F.sum("hit").alias("tp"), F.lit(0).cast("long").alias("codes"))
    cells = cells.withColumn("chapter", F.explode(F.when(F.col("near"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))).drop("near")
    both = pairs.withColumn("chapter", F.explode(F.when(F.col("near"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    first = both.groupBy("source", "chapter").agg(F.max("thr_at").alias("thr_at"), F.min("k_at").alias("k_at"), F.min("n_at").alias("n_at"))
    zero = F.lit(0).cast("long")
    first = first.groupBy(*at, "chapter").agg(zero.alias("n_emitted"), zero.alias("tp"), F.count("*").alias("codes"))
    designs = [("relative", float(t), i, -1) for i, t in enumerate(sorted(relative))] + [("topk", float(k), -1, i) for i, k in enumerate(ks)]
    designs = spark.createDataFrame([(*x, n, j) for x in designs for j, n in enumerate(ns)], "mode string, parameter double, thr_i int, k_i int, top_n int, n_i int")
    inside = ((F.col("thr_i") >= 0) & (F.col("thr_at") > F.col("thr_i"))) | ((F.col("k_i") >= 0) & (F.col("k_at") <= F.col("k_i"))) | (F.col("n_at") <= F.col("n_i"))
    sums = cells.select(*at, "chapter", "n_emitted", "tp", "codes").unionByName(first).crossJoin(F.broadcast(designs)).where(inside)
    out = sums.groupBy("mode", "parameter", "top_n", "chapter").agg(*[F.sum(x).alias(x) for x in ("n_emitted", "tp", "codes")])
    return out.crossJoin(F.broadcast(truth.select("source", "target").distinct().agg(F.count("*").alias("n_true"))))


def choose_by_fold(counts: DataFrame, setting: list[str]) -> DataFrame:
    """For each fold the setting with the best F1 on all other folds (`train_f1`; the first in order of `setting` on ties), with the fold's own counts
    and metrics, so no source decides about its own setting. counts: setting columns, fold, tp, n_emitted, n_true."""
    w = W.partitionBy(*setting)
    rest = {c: F.sum(c).over(w) - F.col(c) for c in ("tp", "n_emitted", "n_true")}
    both = rest["n_emitted"] + rest["n_true"]
    out = counts.withColumn("train_f1", F.round(F.when(both > 0, 2 * rest["tp"] / both).otherwise(0.0), 6))
    out = best(out, ["fold"], "train_f1", tuple(setting))
    return out.withColumns(metrics.exact(F.col("tp"), F.col("n_emitted"), F.col("n_true")))


def setting(grid: DataFrame, **keys) -> Row:
    """The only row whose columns have these values; LookupError if there is none or more than one."""
    rows = grid
    for name, value in keys.items():
        rows = rows.where(F.col(name) == value)
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{'no row' if not found else 'more than one row'} with {keys}")
    return found[0]


def setting_key(*columns: str) -> Column:
    """A setting as one text, its values in order with a bar between (nulls: none): what results of one setting are named and matched by."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in columns])


def unique_tags(tags: list[str]) -> list[str]:
    """The tags as they are; ValueError if two differ in case at most, since they name folders and columns."""
    lower = [t.lower() for t in tags]
    twice = sorted({t for t in tags if lower.count(t.lower()) > 1})
    if twice:
        raise ValueError(f"tags that are alike: {twice}")
    return tags


def best(grid: DataFrame, by: list[str], value: str = "f1", order: tuple[str, ...] = ("threshold", "top_n", "rule")) -> DataFrame:
    """The best row of each group, the first in grid order on ties."""
    first = F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last(value), *order))
    return grid.withColumn("rn", first).where("rn = 1").drop("rn")


def paired(grid: DataFrame, keys: list[str], column: str, a: str, b: str, value: str = "f1") -> DataFrame:
    """b against a over the settings where both exist: better, tied, worse, mean difference."""
    wide = grid.groupBy(*keys).pivot(column, [a, b]).agg(F.first(value)).dropna(subset=[a, b]).withColumn("d", F.col(b) - F.col(a))
    return wide.agg(F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") == 0).alias("tied"), F.count_if(F.col("d") < 0).alias("worse"), F.round(F.avg("d"), 6).alias("mean_delta"))


def pivot_many(df: DataFrame, keys: list[str], column: str, names: list[str], values: dict[str, Column]) -> DataFrame:
    """Several values at once; columns value_name."""
    out = df.groupBy(*keys).pivot(column, names).agg(*[c.alias(v) for v, c in values.items()])
    return out.select(*keys, *[F.col(f"{n}_{v}" if len(values) > 1 else n).alias(f"{v}_{n}") for v in values for n in names])


def sensitivity(grid: DataFrame, by: list[str], group: list[str], value: str = "f1") -> DataFrame:
    """min, median, max and best of each group with competition ranks by the best and by the median, and whether they differ."""
    s = grid.groupBy(*by).agg(F.min(value).alias("min_f1"), F.round(F.median(value), 6).alias("median_f1"), F.max(value).alias("max_f1"))
    w = lambda c: W.partitionBy(*group).orderBy(F.desc(c))
    s = s.withColumns({"rank_best": F.rank().over(w("max_f1")), "rank_median": F.rank().over(w("median_f1"))})
    return s.withColumn("rank_changed", F.col("rank_best") != F.col("rank_median"))
