"""Stand-ins for the crosswalk's tables, derived from the driver's: codes are vector ids, even ones sources and odd ones targets."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chapters import chapter, distance
from ..operators.retrieve import ranked
from ..operators.vectors import cosine_best, cosine_counts, cosine_lists, cosine_pairs, cosine_places

#: Ranges of four-digit codes with gaps, and an alignment by which odd chapters also allow the next one.
RANGES = [(c, f"{(c - 1) * 100:04d}", f"{(c - 1) * 100 + 95:04d}") for c in range(1, 21)]
ALIGN = {c: [c, c + 1] if c % 2 else [c] for c in range(1, 21)}
#: Slices of the vectors that stand for three models, and the whole.
MODELS = {"sim": slice(0, 64), "sim_a": slice(0, 32), "sim_b": slice(32, 64), "sim_c": slice(16, 48)}
#: Setting of the single-point queries.
THRESHOLD, TOP_N, K = 0.8, 10, 10
#: The learners' pool, and the 51 features beside the fitted rate of the chapter pair.
STUDY_K, STUDY_N = 50, 50
STUDY = [f"{c}_{m}" for m in "abc" for c in ("sim", "simrank", "simrel", "simz", "simrankrev", "simrelrev")] + [
    "cooc_freq", "cooc_rank", "cooc_share", "cooc_rel", "has_cooc", "ens_rrf", "ens_mean_rel", "ens_max_rel", "ens_min_rel", "ens_best_rank", "ens_rel_sd", "ens_mean_relrev", "ens_best_rankrev", "ens_rrf_rev",
    "ens_mutual_rel", "ens_mutual_rank", "is_mutual_top1", "ens_direction_gap", "chapter_distance", "chapter_ok", "lex_jaccard", "lex_overlap", "lex_idf_overlap", "lex_first_token", "lex_editdist",
    "n_candidates", "ens_rrf_rank", "ens_rrf_rel", "lex_idf_rank", "ens_margin", "target_n_suitors", "target_rank_here", "target_is_best_here",
]


def code_chapter(code: str) -> Column:
    """Keys are compared as texts, in which a longer number would stand between two of four digits; it lies outside all ranges."""
    return chapter(F.when(F.col(code) < 10_000, F.col(code)), RANGES, width=4)


def chapters() -> tuple[Column, Column]:
    return code_chapter("source"), code_chapter("target")


class Data:
    """Lazy tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings")

    @cached_property
    def sources(self) -> DataFrame:
        return self.vectors.where("vec_id % 2 = 0").select(F.col("vec_id").alias("source"), F.col("label").alias("ccs_id"))

    @cached_property
    def targets(self) -> DataFrame:
        return self.vectors.where("vec_id % 2 = 1").select(F.col("vec_id").alias("target"))

    def similarities(self, *models: str) -> DataFrame:
        side = lambda odd: self.vectors.where(f"vec_id % 2 = {odd}").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
        return cosine_pairs(side(0), side(1), {m: MODELS[m] for m in models or MODELS})

    def best(self, model: str = "sim_a", *, k: int = 0, threshold: float | None = None, side: str = "source", placed: bool = False) -> DataFrame:
        """(source, target, sim, rank, best): the k best, and those of at least threshold times the best, of each code of a side; other pairs never leave the product.
        placed: only of the codes that have a chapter, each among all codes of the other side."""
        parts = dict(zip(("source", "target"), self.sides(), strict=True))
        if placed:
            parts[side] = parts[side].where(code_chapter("id").isNotNull())
        return cosine_best(parts["source"], parts["target"], MODELS[model], k=k, threshold=threshold, side=side)

    def near(self, threshold: float = THRESHOLD, side: str = "source", model: str = "sim_a") -> DataFrame:
        return self.best(model, threshold=threshold, side=side).select("source", "target", "sim")

    def near_placed(self, threshold: float = THRESHOLD, side: str = "source", model: str = "sim_a") -> DataFrame:
        """`near` for what the chapter filter follows: a code without a chapter has no pair that passes it."""
        return self.best(model, threshold=threshold, side=side, placed=True).select("source", "target", "sim")

    def sim(self, model: str = "sim_a") -> DataFrame:
        return self.similarities(model).withColumnRenamed(model, "sim")

    def nonneg(self, model: str = "sim_a") -> DataFrame:
        """(source, n, best) of the pairs with a cosine of 0 or more."""
        return cosine_counts(*self.sides(), MODELS[model])

    @cached_property
    def cooc(self) -> DataFrame:
        pairs = self.table("lineitem").select((2 * (F.col("l_partkey") % 250)).alias("source"), (2 * (F.col("l_suppkey") % 100) + 1).alias("target"))
        return pairs.groupBy("source", "target").agg(F.count("*").alias("freq"))

    @cached_property
    def truth(self) -> DataFrame:
        return self.best("sim", k=2).select("source", "target")

    @cached_property
    def excluded(self) -> DataFrame:
        return self.sources.where("source % 50 = 0").select("source")

    @cached_property
    def labels(self) -> DataFrame:
        """Codes with two-word labels: p_name by part key."""
        return self.table("part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("label"))

    def sides(self) -> tuple[DataFrame, DataFrame]:
        part = lambda odd: self.vectors.where(f"vec_id % 2 = {odd}").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
        return part(0), part(1)

    def lists(self, *models: str, k: int, side: str = "source", pairs: DataFrame | None = None) -> DataFrame:
        """The k best of each code of a side by any of the models, and listed pairs, with all models' cosines; the rest never leaves the product."""
        return cosine_lists(*self.sides(), {m: MODELS[m] for m in models}, k=k, side=side, pairs=pairs)

    def scored_within(self, k: int, n: int) -> DataFrame:
        """Candidates of two models within rank k or counts within rank n, with a fixed score formula and truth: source, target, score, y, ranks (k + 1: beyond k)."""
        from pyspark.sql.window import Window as W

        cooc = ranked(self.cooc, "freq", name="cooc_rank").withColumn("cooc_rel", F.col("freq") / F.max("freq").over(W.partitionBy("source"))).select("source", "target", "cooc_rank", "cooc_rel")
        sims = self.lists("sim", "sim_a", "sim_b", k=max(k, 2), pairs=cooc.where(F.col("cooc_rank") <= n).select("source", "target"))
        within = lambda m: F.when(F.col(f"rank_{m}") <= k, F.col(f"rank_{m}")).otherwise(k + 1).cast("int")
        sims = sims.select("source", "target", within("sim_a").alias("rank_a"), within("sim_b").alias("rank_b"), "rank_sim", (F.col("sim_a") / F.col("best_sim_a")).alias("rel_a"), (F.col("sim_b") / F.col("best_sim_b")).alias("rel_b"))
        both = sims.join(cooc, ["source", "target"], "left").fillna({"cooc_rank": 999, "cooc_rel": 0.0})
        kept = both.where((F.col("rank_a") <= k) | (F.col("rank_b") <= k) | (F.col("cooc_rank") <= n))
        score = F.round(0.5 * F.col("rel_a") + 0.3 * F.col("rel_b") + 0.2 * F.col("cooc_rel"), 4)
        return kept.select("source", "target", "rank_a", "rank_b", "cooc_rank", score.alias("score"), F.coalesce(F.col("rank_sim") <= 2, F.lit(False)).cast("int").alias("y"))

    @cached_property
    def scored(self) -> DataFrame:
        """Kept at its first use: most queries look at it several times, and the product behind it looks at all pairs."""
        return self.scored_within(K, TOP_N).persist()

    def windows(self, pairs: DataFrame, models: dict[str, str]) -> DataFrame:
        """simrank_, simrel_, simz_ by source and simrankrev_, simrelrev_ by target of the pairs (source, target and the models' columns), each among all pairs of
        its code: two products of the vectors through which only these pairs go."""
        cuts = {v: MODELS[v] for v in models.values()}
        out = cosine_places(pairs.select("source", "target", *cuts), *self.sides(), cuts)
        own = {m: (F.col(v), F.col(f"place_{v}"), F.col(f"best_{v}"), F.col(f"mean_{v}"), F.col(f"sd_{v}")) for m, v in models.items()}
        forward = [x for m, (v, place, best, mean, sd) in own.items() for x in (place.alias(f"simrank_{m}"), (v / best).alias(f"simrel_{m}"), ((v - mean) / (sd + 1e-9)).alias(f"simz_{m}"))]
        out = cosine_places(out.select("source", "target", *cuts, *forward), *self.sides(), cuts, side="target", spread=False)
        back = [x for m, (v, place, best, _, _) in own.items() for x in (v.alias(f"sim_{m}"), F.col(f"simrank_{m}").cast("int").alias(f"simrank_{m}"), f"simrel_{m}", f"simz_{m}", place.cast("int").alias(f"simrankrev_{m}"), (v / best).alias(f"simrelrev_{m}"))]
        return out.select("source", "target", *back)

    def pool_features(self, k: int, n: int) -> DataFrame:
        """Ensemble features of three models on the pairs within rank k of a model or counts within rank n; only these pairs leave the products."""
        from ..operators import features as fe

        cooc = fe.cooccurrence_windows(self.cooc)
        pool = self.lists("sim_a", "sim_b", "sim_c", k=k, pairs=cooc.where(F.col("cooc_rank") <= n).select("source", "target"))
        kept = self.windows(pool, {m: f"sim_{m}" for m in "abc"}).join(cooc, ["source", "target"], "left")
        return fe.ensemble(fe.fill(kept, list("abc")), list("abc"))

    @cached_property
    def features(self) -> DataFrame:
        """The pool's features with context, y, chapter pair and category."""
        from ..operators import features as fe

        out = fe.context(self.pool_features(K, TOP_N)).join(self.truth.withColumn("y", F.lit(1)), ["source", "target"], "left").fillna(0, subset=["y"])
        pair = F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("NA")) for c in chapters()])
        return out.withColumn("chapter_pair", pair).join(self.sources, "source", "left")

    @cached_property
    def study_pool(self) -> DataFrame:
        """The wide pool with its ensembles, kept while the study is made: the label pairs are taken from it, and then joined to it."""
        return self.pool_features(STUDY_K, STUDY_N).persist()

    @cached_property
    def study(self) -> DataFrame:
        """The learners' rows: all features of STUDY on the wide pool, y, the chapter pair as a number, and what retrieval looks at. A code's label is the part's of the next number."""
        from ..operators import features as fe

        out = self.study_pool.join(self.truth.withColumn("y", F.lit(1)), ["source", "target"], "left").fillna(0, subset=["y"])
        label = lambda side: self.labels.select((F.col("code") - 1).alias(side), F.col("label").alias(f"{side}_label"))
        out = out.join(label("source"), "source", "left").join(label("target"), "target", "left")
        lexical = fe.lexical(out.where("source_label is not null and target_label is not null"), fe.token_idf(self.labels.select("label")))
        out = out.join(lexical, ["source_label", "target_label"], "left").fillna(0, subset=[c for c in STUDY if c.startswith("lex_") and c != "lex_idf_rank"])
        apart = distance(*chapters(), ALIGN)
        out = fe.context(out).withColumns({"chapter_distance": F.coalesce(apart, F.lit(3)), "chapter_ok": F.coalesce(apart < 1, F.lit(False)).cast("int")})
        s, t = (F.coalesce(c, F.lit(0)) for c in chapters())
        return out.withColumns({"best_rank": F.least(*[F.col(f"simrank_{m}") for m in "abc"]), "pair": (s * 32 + t).cast("int")})

    @cached_property
    def candidates(self) -> DataFrame:
        """The study's rows binned, with outer and inner folds, kept for the many passes of the fits and without the plan that made them."""
        from ..operators import boost, nested

        rows = self.study.select("source", "target", "y", "pair", "best_rank", *STUDY).persist()
        table = boost.binned(rows, STUDY, keep=["source", "target", "y", "pair", "best_rank", "cooc_rank", "chapter_ok"])
        out = boost.kept(table.join(nested.deal(self.sources, 5, 3), "source"))
        rows.unpersist()
        self.study_pool.unpersist()
        return out

    @cached_property
    def known(self) -> DataFrame:
        """True pairs in the study's pool: what the learners' recall counts."""
        return self.candidates.where("y = 1").select("source", "target")
