"""Candidates from similarities and counts. `side` is the column that groups: source (forward) or target (reverse)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def other(side: str) -> str:
    return {"source": "target", "target": "source"}[side]


def relative_threshold(sims: DataFrame, threshold: float, *, side: str = "source", value: str = "sim") -> DataFrame:
    """Rows of at least threshold * the group's largest value; nulls and NaN drop."""
    best = F.max(value).over(W.partitionBy(side))
    return sims.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("__best", best).where(F.col(value) >= F.lit(threshold) * F.col("__best")).drop("__best")


def universe(sims: DataFrame, value: str = "sim") -> DataFrame:
    """Everything that threshold 0 keeps: values of 0 or more."""
    return sims.where(F.col(value) >= 0)


def ranked(df: DataFrame, value: str, *, side: str = "source", name: str = "rank") -> DataFrame:
    """Rank by value, largest first, nulls last, ties by the other side's code."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(side).orderBy(F.desc_nulls_last(value), other(side))))


def top(df: DataFrame, n: int, value: str, *, side: str = "source") -> DataFrame:
    """The first n of each group, without ties; Spark limits the groups before the shuffle."""
    return ranked(df, value, side=side, name="__rank").where(F.col("__rank") <= n).drop("__rank")


def candidates(sims: DataFrame, mode: str, parameter: float, *, value: str = "sim") -> DataFrame:
    if mode == "relative":
        return relative_threshold(sims, parameter, value=value)
    if mode == "topk":
        return top(sims, int(parameter), value)
    raise ValueError(f"mode {mode}")


def pool(*lists: DataFrame) -> DataFrame:
    """Distinct pairs of all lists."""
    return reduce(DataFrame.unionByName, [x.select("source", "target") for x in lists]).distinct()


def eligible(ranks: list[Column], k: int, cooc_rank: Column, n: int, chapter_ok: Column | None = None) -> Column:
    """(any rank within k) or (count rank within n), and the chapter if asked."""
    keep = reduce(lambda a, b: a | b, [r <= k for r in ranks]) | (cooc_rank <= n)
    return keep if chapter_ok is None else keep & chapter_ok
