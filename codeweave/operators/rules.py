"""Merging candidates, flagging them and selecting by flag rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.chapters import Alignment, distance, inverse
from .retrieve import relative_threshold, top

#: Columns of flags for each rule.
RULES = {1: ("top_sim", "top_cooc"), 2: ("top_sim", "in_both"), 3: ("top_cooc", "in_both"), 4: ("top_sim", "top_cooc", "in_both")}


def merge(sims: DataFrame, cooc: DataFrame) -> DataFrame:
    """Full join of (source, target, sim) and (source, target, freq); null codes match each other."""
    a, b = sims.select("source", "target", "sim").alias("a"), cooc.select("source", "target", "freq").alias("b")
    both = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & F.col("a.target").eqNullSafe(F.col("b.target")), "full")
    return both.select(F.coalesce("a.source", "b.source").alias("source"), F.coalesce("a.target", "b.target").alias("target"), "sim", "freq")


def flag(pool: DataFrame, source_chapter: Column, target_chapter: Column, align: Alignment, *, side: str = "source", groups: list[str] | None = None) -> DataFrame:
    """Chapters, distance 0 only, then flags over what is left: largest similarity, largest count (ties all, null never), in both."""
    d = distance(source_chapter, target_chapter, align) if side == "source" else distance(target_chapter, source_chapter, inverse(align))
    near = pool.withColumns({"src_chapter": source_chapter, "tgt_chapter": target_chapter}).withColumn("chapter_distance", d).where(F.col("chapter_distance") < 1)
    by = W.partitionBy(*(groups or []), side)
    at_most = lambda c: F.coalesce((F.col(c) == F.max(c).over(by)).cast("int"), F.lit(0))
    return near.withColumns({"top_sim": at_most("sim"), "top_cooc": at_most("freq"), "in_both": (F.col("sim").isNotNull() & F.col("freq").isNotNull()).cast("int")})


def rule(number: int) -> Column:
    if number not in RULES:
        raise ValueError(f"rule {number}")
    return F.greatest(*[F.col(c) for c in RULES[number]]) == 1


def rule_pipeline(sims: DataFrame, cooc: DataFrame, chapters: tuple[Column, Column], align: Alignment, *, threshold: float, top_n: int, number: int, side: str = "source") -> DataFrame:
    """(source, target) that the rule emits, forward or reverse."""
    merged = merge(relative_threshold(sims, threshold, side=side), top(cooc, top_n, "freq", side=side))
    return flag(merged, *chapters, align, side=side).where(rule(number)).select("source", "target")
