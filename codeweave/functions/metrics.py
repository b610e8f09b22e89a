"""Metrics from counts; 0 where a denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def round3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def accuracy(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fp + fn)


def rounded(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """The rule pipeline's metrics: F1 of the rounded precision and recall."""
    p, r = round3(precision(tp, fp)), round3(recall(tp, fn))
    return {"precision": p, "recall": r, "f1": round3(f1(p, r)), "accuracy": round3(accuracy(tp, fp, fn))}


def exact(tp: Column, emitted: Column, truth: Column, digits: int = 6) -> dict[str, Column]:
    """The rerank path's metrics, without rounding in between."""
    p, r = ratio(tp, emitted), ratio(tp, truth)
    return {"precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(f1(p, r), digits), "accuracy": F.round(ratio(tp, emitted + truth - tp), digits)}


def compact(columns: list[str], names: list[str]) -> list[Column]:
    """The values of `columns` that aren't null, in their order, under as many `names`; null beyond the last."""
    kept = F.array_compact(F.array(*[F.col(c) for c in columns]))
    return [F.get(kept, F.lit(i)).alias(n) for i, n in enumerate(names)]
