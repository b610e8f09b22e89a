"""Features of candidate pairs: similarity windows, counts, ensembles, texts, context. Canonical columns: source, target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text

#: What a missing rank counts as, and the constant of reciprocal rank fusion.
NO_RANK, FUSION = 999, 60


def _rank(value: Column, side: str, tie: str) -> Column:
    return F.row_number().over(W.partitionBy(side).orderBy(F.desc_nulls_last(value), tie))


def similarity_windows(sims: DataFrame, model: str, value: str) -> DataFrame:
    """sim_, simrank_, simrel_, simz_ by source and simrankrev_, simrelrev_ by target; two shuffles in all."""
    v, s, t = F.col(value), W.partitionBy("source"), W.partitionBy("target")
    sd = F.coalesce(F.stddev_samp(v).over(s), F.lit(0.0))
    return sims.select("source", "target", v.alias(value)).select(
        "source", "target", v.alias(f"sim_{model}"), _rank(v, "source", "target").alias(f"simrank_{model}"), (v / F.max(v).over(s)).alias(f"simrel_{model}"),
        F.when(F.count(v).over(s) > 1, (v - F.avg(v).over(s)) / (sd + 1e-9)).otherwise(0.0).alias(f"simz_{model}"), _rank(v, "target", "source").alias(f"simrankrev_{model}"), (v / F.max(v).over(t)).alias(f"simrelrev_{model}"),
    )


def all_windows(sims: DataFrame, models: dict[str, str]) -> DataFrame:
    """The windows of several models (name: value column) over one table: a shuffle by source and one by target for all."""
    s, t, forward, back = W.partitionBy("source"), W.partitionBy("target"), {}, {}
    for m, value in models.items():
        v = F.col(value)
        sd = F.coalesce(F.stddev_samp(v).over(s), F.lit(0.0))
        forward |= {f"simrank_{m}": _rank(v, "source", "target"), f"simrel_{m}": v / F.max(v).over(s), f"simz_{m}": F.when(F.count(v).over(s) > 1, (v - F.avg(v).over(s)) / (sd + 1e-9)).otherwise(0.0)}
        back |= {f"simrankrev_{m}": _rank(v, "target", "source"), f"simrelrev_{m}": v / F.max(v).over(t)}
    out = sims.select("source", "target", *[F.col(v).alias(f"sim_{m}") for m, v in models.items()], *models.values()) if any(f"sim_{m}" != v for m, v in models.items()) else sims
    return out.withColumns(forward).withColumns(back)


def cooccurrence_windows(cooc: DataFrame) -> DataFrame:
    s = W.partitionBy("source")
    return cooc.select("source", "target", F.col("freq").alias("cooc_freq"), _rank(F.col("freq"), "source", "target").alias("cooc_rank"), (F.col("freq") / F.sum("freq").over(s)).alias("cooc_share"), (F.col("freq") / F.max("freq").over(s)).alias("cooc_rel"))


def fill(features: DataFrame, models: list[str]) -> DataFrame:
    """Missing ranks 999, missing scores 0, and has_cooc."""
    out = features.withColumn("has_cooc", F.col("cooc_freq").isNotNull().cast("int"))
    ranks = ["cooc_rank", *[f"{p}_{m}" for m in models for p in ("simrank", "simrankrev")]]
    scores = ["cooc_freq", "cooc_share", "cooc_rel", *[f"{p}_{m}" for m in models for p in ("sim", "simrel", "simz", "simrelrev")]]
    return out.fillna(NO_RANK, subset=ranks).fillna(0, subset=scores)


def _mean(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) / len(cols)


def ensemble(features: DataFrame, models: list[str]) -> DataFrame:
    """Rank fusion and agreement over the models (two at least), forward, reverse and both ways."""
    rank, rel, rank_rev, rel_rev = ([F.col(f"{p}_{m}") for m in models] for p in ("simrank", "simrel", "simrankrev", "simrelrev"))
    fused = lambda ranks: reduce(lambda a, b: a + b, [1 / (FUSION + r) for r in ranks])
    out = features.withColumns({
        "ens_rrf": fused(rank), "ens_mean_rel": _mean(rel), "ens_max_rel": F.greatest(*rel), "ens_min_rel": F.least(*rel), "ens_best_rank": F.least(*rank),
        "ens_mean_relrev": _mean(rel_rev), "ens_best_rankrev": F.least(*rank_rev), "ens_rrf_rev": fused(rank_rev),
    })
    spread = reduce(lambda a, b: a + b, [(r - F.col("ens_mean_rel")) * (r - F.col("ens_mean_rel")) for r in rel])
    product = F.col("ens_mean_rel") * F.col("ens_mean_relrev")
    return out.withColumns({
        "ens_rel_sd": F.sqrt(spread / (len(models) - 1)), "ens_mutual_rel": F.when(product >= 0, F.sqrt(product)).otherwise(0.0), "ens_mutual_rank": F.col("ens_best_rank") + F.col("ens_best_rankrev"),
        "is_mutual_top1": ((F.col("ens_best_rank") == 1) & (F.col("ens_best_rankrev") == 1)).cast("int"), "ens_direction_gap": F.col("ens_mean_rel") - F.col("ens_mean_relrev"),
    })


def token_idf(labels: DataFrame) -> DataFrame:
    """(token, df, idf) over column label: ln(N / (1 + df)); each distinct label is a document."""
    docs = labels.select("label").distinct()
    n = docs.agg(F.count("*").alias("n"))
    counts = docs.select(F.explode(text.tokens(F.col("label"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(n)).select("token", "df", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"))


def lexical(pairs: DataFrame, idf: DataFrame, a: str = "source_label", b: str = "target_label") -> DataFrame:
    """Distinct label pairs with lex_jaccard, lex_overlap, lex_idf_overlap, lex_first_token, lex_editdist; weights are joined by token, so any vocabulary will do."""
    both = pairs.select(a, b).distinct().withColumns({"ta": text.tokens(F.col(a)), "tb": text.tokens(F.col(b))})
    union = both.select(a, b, "ta", "tb", F.explode_outer(F.array_union("ta", "tb")).alias("token")).join(idf.select("token", "idf"), "token", "left")
    common = F.array_contains("ta", F.col("token")) & F.array_contains("tb", F.col("token"))
    weights = union.groupBy(a, b).agg(F.sum(F.when(common, F.col("idf"))).alias("wi"), F.sum("idf").alias("wu"))
    out = both.join(weights, [a, b])
    ca, cb = F.col("ta"), F.col("tb")
    return out.select(
        a, b, text.jaccard(ca, cb).alias("lex_jaccard"), text.overlap(ca, cb).alias("lex_overlap"), F.when(F.arrays_overlap(ca, cb) & (F.col("wu") != 0), F.col("wi") / F.col("wu")).otherwise(0.0).alias("lex_idf_overlap"),
        text.first_token_equal(ca, cb).alias("lex_first_token"), text.edit_distance(F.col(a), F.col(b)).alias("lex_editdist"),
    )


def context(features: DataFrame) -> DataFrame:
    """How crowded a source's list and how contested a target is."""
    s, t = W.partitionBy("source"), W.partitionBy("target")
    out = features.withColumn("__best", F.max("ens_mean_rel").over(s))
    runner_up = F.greatest(F.max(F.when(F.col("ens_mean_rel") < F.col("__best"), F.col("ens_mean_rel"))).over(s), F.lit(-1.0))
    out = out.withColumns({
        "n_candidates": F.count("*").over(s), "ens_rrf_rank": _rank(F.col("ens_rrf"), "source", "target"), "ens_rrf_rel": F.col("ens_rrf") / F.max("ens_rrf").over(s), "ens_margin": F.col("ens_mean_rel") - runner_up,
        "target_n_suitors": F.count("*").over(t), "target_rank_here": _rank(F.col("ens_mean_rel"), "target", "source"),
    })
    out = out.withColumn("target_is_best_here", (F.col("target_rank_here") == 1).cast("int"))
    if "lex_idf_overlap" in features.columns:
        out = out.withColumn("lex_idf_rank", _rank(F.col("lex_idf_overlap"), "source", "target"))
    return out.drop("__best")


def feature_table(pool: DataFrame, windows: dict[str, DataFrame], cooc: DataFrame) -> DataFrame:
    """The pool with all models' windows and the counts, filled, with ensembles."""
    out = pool
    for w in windows.values():
        out = out.join(w, ["source", "target"], "left")
    out = out.join(cooccurrence_windows(cooc), ["source", "target"], "left")
    return ensemble(fill(out, list(windows)), list(windows))
