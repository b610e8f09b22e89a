"""Emitted pairs against true pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics


def without(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows whose source isn't excluded; null sources stay."""
    return df.join(excluded.select("source").distinct(), "source", "left_anti")


def validate(manual: DataFrame, auto: DataFrame, ccs: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """Full join by pair: source, manual, auto, ccs_id, tp, fn, fp."""
    m = manual.select(F.col("source").alias("ms"), F.col("target").alias("manual"))
    a = auto.select(F.col("source").alias("as"), F.col("target").alias("auto"))
    both = m.join(a, F.col("ms").eqNullSafe(F.col("as")) & F.col("manual").eqNullSafe(F.col("auto")), "full")
    return _judged(both.withColumn("source", F.coalesce("ms", "as")).drop("ms", "as"), "manual", "auto", ccs, excluded)


def validate_reverse(manual: DataFrame, auto: DataFrame, ccs: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """Full join by target alone, so a wrong source of a known target counts nowhere."""
    m = manual.select(F.col("target").alias("mt"), F.col("source").alias("manual"))
    a = auto.select(F.col("target").alias("at"), F.col("source").alias("auto"))
    both = m.join(a, F.col("mt").eqNullSafe(F.col("at")), "full").withColumn("source", F.coalesce("manual", "auto"))
    return _judged(both.withColumn("target", F.coalesce("mt", "at")).drop("mt", "at"), "manual", "auto", ccs, excluded)


def _judged(both: DataFrame, manual: str, auto: str, ccs: DataFrame, excluded: DataFrame | None) -> DataFrame:
    both = both.join(ccs.select("source", "ccs_id"), "source", "left")
    if excluded is not None:
        both = without(both, excluded)
    m, a = F.col(manual), F.col(auto)
    return both.withColumns({"tp": F.coalesce((m == a).cast("int"), F.lit(0)), "fn": (m.isNotNull() & a.isNull()).cast("int"), "fp": (m.isNull() & a.isNotNull()).cast("int")})


def performance(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn and the rounded metrics, in all or by groups."""
    sums = judged.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return sums.withColumns(metrics.rounded(F.col("tp"), F.col("fp"), F.col("fn")))


def roundtrip(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """One row: n_total, n_consistent, rate over the many-to-many join by target."""
    back = reverse.select(F.col("source").alias("back"), "target").distinct()
    joined = forward.select("source", "target").distinct().join(back, "target", "left")
    out = joined.agg(F.count("*").alias("n_total"), F.coalesce(F.sum((F.col("back") == F.col("source")).cast("int")), F.lit(0)).cast("long").alias("n_consistent"))
    return out.withColumn("rate", F.when(F.col("n_total") > 0, metrics.round3(F.col("n_consistent") / F.col("n_total"))))


def score_pairs(emitted: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, n_emitted, n_true and exact metrics of distinct pairs; n_true counts all of truth."""
    by = by or []
    known = truth.select("source", "target", F.lit(1).alias("hit")).distinct()
    hits = emitted.select(*by, "source", "target").distinct().join(known, ["source", "target"], "left").groupBy(*by).agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("tp"), F.count("*").alias("n_emitted"))
    out = hits.crossJoin(F.broadcast(known.agg(F.count("*").alias("n_true"))))
    return out.withColumns(metrics.exact(F.col("tp"), F.col("n_emitted"), F.col("n_true")))


def oracle(emitted: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall of a pool and the F1 that perfect selection from it would have."""
    s = score_pairs(emitted, truth, by)
    r = F.col("tp") / F.col("n_true")
    return s.select(*(by or []), "n_emitted", "tp", F.round(r, 6).alias("recall"), F.round(2 * r / (1 + r), 6).alias("oracle_f1"))


def funnel(truth: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Truth with a boolean column for each stage: does the pair survive it."""
    out = truth.select("source", "target").distinct()
    for name, stage in stages.items():
        out = out.join(stage.select("source", "target").distinct().withColumn(name, F.lit(True)), ["source", "target"], "left")
    return out.fillna(False, subset=list(stages))


def reasons(flags: DataFrame, cases: list[tuple[Column, str]], otherwise: str) -> DataFrame:
    """Counts and percents of the first case that holds."""
    reason = F.lit(otherwise)
    for when, name in reversed(cases):
        reason = F.when(when, name).otherwise(reason)
    counts = flags.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("reason", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct"))
