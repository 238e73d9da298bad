"""Scoring, ranking and reporting of suspects."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.evidence import BIAS, FEATURES, baseline_score, evidence_list, logistic
from .asof import numbered

KEYS = ["origin_id", "mmsi"]


def finalise(scored: DataFrame) -> DataFrame:
    """Rank by score (ties by vessel) and share of blame as a softmax within the origin.

    A window holds the vessels near one origin. Peak and total are grouped first, with
    partial sums on the map side, so only the ranking itself sees an origin whole.
    """
    peak = scored.groupBy("origin_id").agg(F.max("score").alias("peak"))
    weighted = scored.join(peak, "origin_id").withColumn("z", F.exp(F.col("score") - F.col("peak")))
    total = weighted.groupBy("origin_id").agg(F.sum("z").alias("total"))
    w = Window.partitionBy("origin_id").orderBy(F.desc("score"), "mmsi")
    return (weighted.join(total, "origin_id")
            .withColumn("attribution_pct", 100.0 * F.col("z") / F.col("total"))
            .withColumn("rank", F.row_number().over(w)).drop("peak", "z", "total"))


def score_baseline(features: DataFrame, weights: dict[str, float] | None = None,
                   bias: float = BIAS) -> DataFrame:
    """Features with score, prob, evidence, attribution_pct and rank."""
    s = features.withColumn("score", baseline_score(weights, bias))
    return finalise(s.withColumns({"prob": logistic(F.col("score")),
                                   "evidence": evidence_list(weights)}))


def top_suspects(suspects: DataFrame, n: int) -> DataFrame:
    return suspects.where(F.col("rank") <= n)


def training_pairs(features: DataFrame, truth: DataFrame) -> DataFrame:
    """Feature differences (culprit minus other) within each origin, and their mirror.

    Each origin has one culprit, so the join gives one row per vessel, not per pair.
    """
    good = (features.join(truth.select("origin_id", F.col("truth_mmsi").alias("mmsi")), KEYS)
            .select("origin_id", *[F.col(c).alias(f"g_{c}") for c in FEATURES],
                    F.col("mmsi").alias("g_mmsi")))
    diff = (features.join(good, "origin_id").where("mmsi <> g_mmsi")
            .select(*[(F.col(f"g_{c}") - F.col(c)).alias(c) for c in FEATURES]))
    return (diff.withColumn("label", F.lit(1.0))
            .unionByName(diff.select(*[(-F.col(c)).alias(c) for c in FEATURES])
                         .withColumn("label", F.lit(0.0))))


def train_ranker(features: DataFrame, truth: DataFrame, reg: float = 0.01) -> dict[str, float]:
    """Linear ranking weights per feature from pairwise logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    pairs = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(
        training_pairs(features, truth))
    model = LogisticRegression(featuresCol="x", labelCol="label", fitIntercept=False,
                               regParam=reg).fit(pairs)
    return dict(zip(FEATURES, [float(v) for v in model.coefficients]))


def score_learned(features: DataFrame, model: dict[str, float]) -> DataFrame:
    """Learned order; the evidence stays that of the transparent score."""
    total = F.lit(0.0)
    for name, w in model.items():
        total = total + F.lit(float(w)) * F.col(name)
    s = features.withColumn("score", total)
    return finalise(s.withColumns({"prob": logistic(F.col("score")), "evidence": evidence_list()}))


def get_scorer(kind: str = "baseline", model: dict[str, float] | None = None):
    """A function from features to ranked suspects."""
    if kind == "baseline":
        return score_baseline
    if kind == "learned":
        if not model:
            raise ValueError("the learned scorer needs a model")
        return lambda features: score_learned(features, model)
    raise ValueError(f"unknown scorer {kind!r}")


def join_learned_rank(suspects: DataFrame, learned: DataFrame | None) -> DataFrame:
    """``learned_rank`` next to the baseline rank; null where the learner is silent."""
    if learned is None:
        return suspects.withColumn("learned_rank", F.lit(None).cast("int"))
    lr = learned.select(*KEYS, F.col("rank").cast("int").alias("learned_rank"))
    return suspects.join(lr, KEYS, "left")


def thin_rows(df: DataFrame, keys: list[str], every: Column, bucket_s: float = 3600.0) -> DataFrame:
    """First row of each run of ``every`` rows of a track, counted in time order."""
    return numbered(df, keys, bucket_s).where((F.col("rn_") - 1) % every == 0).drop("rn_")


def thin_tracks(fixes: DataFrame, keys: list[str], max_points: int = 400) -> DataFrame:
    """At most about ``max_points`` fixes per track, evenly taken in time order."""
    n = fixes.groupBy(*keys).agg(F.count("*").alias("n_"))
    step = F.greatest(F.floor(F.col("n_") / max_points), F.lit(1))
    return thin_rows(fixes.join(n, keys), keys, step).drop("n_")


def suspects_report(suspects: DataFrame, fixes: DataFrame | None = None, top_n: int = 10,
                    counts: DataFrame | None = None, scorer: str = "baseline") -> DataFrame:
    """The top suspects rounded for output, with a thinned track when fixes are given.

    With ``counts`` (origin_id, n_screened, n_candidates) every row also says how many vessels were
    looked at and how many were candidates. ``scorer`` names the score that led.
    """
    c = F.col
    extra = {"track_match": F.lit(0.0), "learned_rank": F.lit(None).cast("int")}
    for name, default in extra.items():
        if name not in suspects.columns:
            suspects = suspects.withColumn(name, default)
    top = top_suspects(suspects, top_n).select(
        "origin_id", "rank", "mmsi", F.coalesce("name", F.lit("")).alias("name"),
        F.round("attribution_pct", 2).alias("attribution_pct"),
        c("vtype").cast("int").alias("vessel_type"), F.round("length", 1).alias("length_m"),
        F.round("min_dist_km", 2).alias("min_dist_km"),
        F.round("time_gap_min", 1).alias("time_gap_min"),
        F.round("track_match", 3).alias("track_match"), "evidence", "learned_rank",
        F.lit(scorer).alias("scorer"))
    if counts is not None:
        top = top.join(counts.select("origin_id", F.col("n_screened").alias("n_vessels_screened"), "n_candidates"),
                       "origin_id", "left")
    if fixes is None:
        return top
    shown = thin_tracks(fixes.join(top.select(*KEYS), KEYS, "left_semi"), KEYS)
    # At most some 800 points per vessel reach a list.
    tracks = shown.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(
        "t", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon")))).alias("track"))
    return top.join(tracks, KEYS, "left")


def explain_text(suspects: DataFrame, counts: DataFrame, n: int = 5) -> DataFrame:
    """A text report per origin; ``counts`` has (origin_id, n_screened, n_candidates)."""
    line = F.concat(
        F.lit("\n#"), c_str("rank"), F.lit("  MMSI "), c_str("mmsi"), F.lit("  "),
        F.when(F.col("name") == "", "(unnamed)").otherwise(F.col("name")), F.lit("   "),
        F.format_string("%.1f", "attribution_pct"), F.lit("% attribution\n"),
        F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("      - "), e)), "\n"))
    body = (top_suspects(suspects, n).groupBy("origin_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines")))
    head = F.concat(F.lit("Screened "), c_str("n_screened"), F.lit(" vessels -> "),
                    c_str("n_candidates"), F.lit(" candidates (transparent scorer)\n"))
    full = F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return counts.join(body, "origin_id", "left").select(
        "origin_id", F.when(F.col("lines").isNull(),
                            "No candidate vessels near the estimated origin.")
        .otherwise(full).alias("report"))


def c_str(name: str) -> Column:
    return F.col(name).cast("string")
