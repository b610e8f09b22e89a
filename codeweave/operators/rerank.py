"""Folds, target encoding and emission; `boost` has the trees, `nested` the cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SEED = 20260819


def ranks(df: DataFrame, order: Column, tie: str, by: list[str] | None = None) -> DataFrame:
    """df with `rank` from 1 by a hexadecimal hash, ties by a column, within each group of `by`. The hash's first three digits deal rows to 4096 ranges; a row's rank
    is its place in its range after the rows of the ranges before, so no task orders more than a range and the counts of ranges are all that is summed in order."""
    by = by or []
    rows = df.withColumn("__order", order).withColumn("__range", F.substring("__order", 1, 3))
    counts = rows.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*by, "__range", before.alias("__start"))
    inside = F.row_number().over(W.partitionBy(*by, "__range").orderBy("__order", tie))
    return rows.join(starts, [*by, "__range"]).withColumn("rank", inside + F.col("__start")).drop("__order", "__range", "__start")


def folds(codes: DataFrame, k: int, *, seed: int = SEED, column: str = "source") -> DataFrame:
    """(code, fold) with sizes at most one apart: a shuffle by a seeded hash, then in turn."""
    ranked = ranks(codes.select(column).distinct(), F.md5(F.concat(F.col(column).cast("string"), F.lit(f":{seed}"))), column)
    return ranked.select(column, ((F.col("rank") - 1) % k).cast("int").alias("fold"))


def category_folds(codes: DataFrame, k: int, *, category: str = "ccs_id", seed: int = SEED) -> DataFrame:
    """(category, fold): whole categories, largest first into the lightest fold. Only the counts of categories are collected; ties go by a seeded hash."""
    counts = codes.groupBy(category).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.md5(F.concat(F.col(category).cast("string"), F.lit(f":{seed}"))), category).collect()
    load, out = [0] * k, []
    for row in counts:
        i = load.index(min(load))
        load[i] += row["n"]
        out.append((row[category], i))
    return codes.sparkSession.createDataFrame(out, codes.select(category).schema.add("fold", "integer"))


def target_encoding(train: DataFrame, key: str = "chapter_pair", y: str = "y", weight: float = 20.0) -> DataFrame:
    """(key, rate): (positives + weight * prior) / (n + weight), the prior over all training rows."""
    prior = train.agg(F.avg(y).alias("prior"))
    counts = train.groupBy(key).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(prior)).select(key, ((F.col("pos") + weight * F.col("prior")) / (F.col("n") + weight)).alias("rate"))


def encode(df: DataFrame, train: DataFrame, key: str = "chapter_pair", name: str = "chapter_rate") -> DataFrame:
    """df with its keys' rates; unseen keys get the prior."""
    prior = train.agg(F.avg("y").alias("__prior"))
    rates = target_encoding(train, key).withColumnRenamed("rate", "__rate")
    return df.join(rates, key, "left").crossJoin(F.broadcast(prior)).withColumn(name, F.coalesce("__rate", "__prior")).drop("__rate", "__prior")


def emit(scored: DataFrame, tau: float | Column, rho: float | Column, by: list[str] | None = None) -> DataFrame:
    """score >= tau, or >= rho * the source's best, or the best itself; ties at the best all stay, so every source emits."""
    best = F.max("score").over(W.partitionBy(*(by or []), "source"))
    tau, rho = (x if isinstance(x, Column) else F.lit(x) for x in (tau, rho))
    return scored.withColumn("__best", best).where((F.col("score") >= tau) | (F.col("score") >= rho * F.col("__best")) | (F.col("score") == F.col("__best"))).drop("__best")
