"""Activation threshold, churn hazard, survival curves and usage personas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions import clusters
from usagelens.functions.columns import (
    count_where,
    dbl,
    flag,
    month_of,
    months_between_starts,
    paid_only,
    ratio,
    scalar,
)
from usagelens.functions.draws import uniform
from usagelens.functions.ranking import ensure_checkpoint_dir, interpolated_quantiles, rank_auc
from usagelens.functions.stats import Z_95, kaplan_meier, normal_tail
from usagelens.operators.usage import (
    WINDOW_SIZE,
    activation_counts,
    activation_scores,
    average_cost,
    six_month_retention,
)
from usagelens.schemas import MIGRATION_TASK

ACTIVATED_SHARE = 0.6

# -- activation threshold --------------------------------------------------------------


def activation_threshold(runs: DataFrame, customers: DataFrame, months: DataFrame) -> DataFrame:
    """Conversion and retention among customers with at least k of 5 successes, k = 0..5.

    Counts per exact number of successes are summed from the top; the running sums see six rows.
    """
    self_serve = F.col("is_sales_led") == 0
    exact = (
        activation_counts(runs, require_full_window=True)
        .join(customers.select("customer_id", "is_sales_led", "first_paid_date"), "customer_id")
        .join(six_month_retention(customers, months), "customer_id", "left")
        .groupBy("successes")
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_where(self_serve).alias("ss"),
            count_where(self_serve & F.col("first_paid_date").isNotNull()).alias("conv"),
            F.sum("retained_6mo").alias("kept"),
            F.count("retained_6mo").alias("seen"),
        )
    )
    # every cutoff appears even when no customer has exactly that many successes
    steps = exact.sparkSession.range(WINDOW_SIZE + 1).select(F.col("id").alias("successes"))
    upward = W.orderBy(F.desc("successes")).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = {c: F.coalesce(F.sum(c).over(upward), F.lit(0)) for c in ("n", "ss", "conv", "kept", "seen")}
    return steps.join(exact, "successes", "left").select(
        F.col("successes").alias("min_successes_of_5"),
        total["n"].alias("n_customers_at_or_above"),
        ratio(total["conv"], total["ss"]).alias("self_serve_conversion_rate"),
        ratio(total["kept"], total["seen"]).alias("retained_6mo_rate"),
    )


# -- churn hazard ----------------------------------------------------------------------


def lagged_monthly_run_stats(runs: DataFrame) -> DataFrame:
    """Run statistics of month M labelled with month M + 1."""
    n = F.count(F.lit(1))
    return (
        runs.groupBy("customer_id", month_of("started_at").alias("m"))
        .agg(
            n.alias("prior_month_n_runs"),
            ratio(F.count_if(F.col("status") == "failed"), n).alias("prior_month_failure_rate"),
            ratio(F.count_if(F.col("task_type") == MIGRATION_TASK), n).alias("prior_month_migration_share"),
        )
        .withColumn("month", F.add_months("m", 1))
        .drop("m")
    )


def survival_panel(months: DataFrame, customers: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per paid month, without the censored last row of active customers."""
    paid = paid_only(months)
    latest = scalar(paid.agg(F.max("month").alias("m")), "m")
    timeline = W.partitionBy("customer_id").orderBy("month")
    attributes = customers.select("customer_id", "signup_date", "acquisition_channel", "status", "churn_date")
    rows = (
        paid.select("customer_id", "month", "plan", "credits_used")
        .withColumn("row_number", F.row_number().over(timeline))
        .withColumn("n_rows", F.count(F.lit(1)).over(W.partitionBy("customer_id")))
        .join(attributes, "customer_id", "left")
        .withColumn("is_last_row", F.col("row_number") == F.col("n_rows"))
        .withColumn("_latest", latest)
    )
    censored = F.col("is_last_row") & (F.col("status") == "active") & (F.col("month") == F.col("_latest"))
    known = rows.where(~F.coalesce(censored, F.lit(False))).drop("_latest")
    tenure = months_between_starts("month", "signup_date")
    filled = {
        c: F.coalesce(dbl(c), F.lit(0.0))
        for c in ("prior_month_n_runs", "prior_month_failure_rate", "prior_month_migration_share", "activation_score")
    }
    return (
        known.join(lagged_monthly_run_stats(runs), ["customer_id", "month"], "left")
        .join(activation_scores(runs), "customer_id", "left")
        .withColumns(filled)
        .withColumn("churned_event", flag(F.col("is_last_row") & (F.col("status") == "churned")))
        .withColumn("tenure_months", tenure)
        .withColumn("tenure_months_sq", F.col("tenure_months") * F.col("tenure_months"))
        .withColumn("log_monthly_runs", F.ln(F.col("prior_month_n_runs") + 1))
    )


# The covariates of the published model.
HAZARD_CATEGORIES = ["acquisition_channel", "plan"]
HAZARD_NUMBERS = [
    "activation_score",
    "tenure_months",
    "tenure_months_sq",
    "prior_month_failure_rate",
    "prior_month_migration_share",
    "log_monthly_runs",
]


def hazard_design(panel: DataFrame) -> tuple[DataFrame, list[str]]:
    """Feature vectors and their names; dummies leave out the alphabetically first label.

    Constant numeric columns are left out: they are collinear with the intercept. A missing
    category has no dummy set, which is the same as carrying the left-out label.
    """
    spread = panel.agg(
        *[(F.max(c) > F.min(c)).alias(c) for c in HAZARD_NUMBERS], *[F.min(c).alias(c) for c in HAZARD_CATEGORIES]
    ).first()
    panel = panel.withColumns({c: F.coalesce(F.col(c), F.lit(spread[c])) for c in HAZARD_CATEGORIES})
    numbers = [c for c in HAZARD_NUMBERS if spread[c]]
    indexed = [f"{c}_index" for c in HAZARD_CATEGORIES]
    encoded = [f"{c}_dummies" for c in HAZARD_CATEGORIES]
    indexer = StringIndexer(
        inputCols=HAZARD_CATEGORIES, outputCols=indexed, stringOrderType="alphabetDesc"
    ).fit(panel)
    present = [i for i, labels in enumerate(indexer.labelsArray) if len(labels) > 1]
    stages = []
    if present:
        stages.append(OneHotEncoder(inputCols=[indexed[i] for i in present], outputCols=[encoded[i] for i in present]))
    stages.append(VectorAssembler(inputCols=numbers + [encoded[i] for i in present], outputCol="features"))
    ready = indexer.transform(panel)
    design = Pipeline(stages=stages).fit(ready).transform(ready)
    names = numbers + [
        f"{HAZARD_CATEGORIES[i]}_{label}" for i in present for label in indexer.labelsArray[i][:-1]
    ]
    return design.select("customer_id", dbl("churned_event").alias("label"), "features"), names


def hazard_odds_ratios(panel: DataFrame) -> DataFrame:
    """Unregularised logistic hazard model with Wald intervals, one row per feature."""
    kept = panel.select("customer_id", "churned_event", *HAZARD_CATEGORIES, *HAZARD_NUMBERS).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        design, names = hazard_design(kept)
        # rows with equal covariates and label enter the likelihood as one row with their number as its weight
        counted = design.groupBy("label", "features").agg(F.count(F.lit(1)).cast("double").alias("weight")).persist(
            StorageLevel.MEMORY_AND_DISK
        )
        model = GeneralizedLinearRegression(
            family="binomial", link="logit", maxIter=100, tol=1e-12, weightCol="weight"
        ).fit(counted)
        rows = [
            (name, float(b), float(se))
            for name, b, se in zip(names, model.coefficients, model.summary.coefficientStandardErrors)
        ]
    finally:
        kept.unpersist()
    coefficients = panel.sparkSession.createDataFrame(rows, "feature string, coef double, se double")
    return coefficients.select(
        "feature",
        "coef",
        F.exp("coef").alias("odds_ratio"),
        F.exp(F.col("coef") - Z_95 * F.col("se")).alias("odds_ratio_ci_low"),
        F.exp(F.col("coef") + Z_95 * F.col("se")).alias("odds_ratio_ci_high"),
        (2 * normal_tail(F.abs(F.try_divide("coef", "se")))).alias("p_value"),
    )


def in_holdout(share: float = 0.25) -> Column:
    """Customer-level split: all months of a customer fall on the same side."""
    return uniform("customer_id", F.lit("holdout")) < share


def hazard_holdout_auc(panel: DataFrame, share: float = 0.25) -> float | None:
    """ROC-AUC on held-out customers of an L2 logistic model (C = 1 on standardised features), as a rank statistic."""
    kept = panel.select("customer_id", "churned_event", *HAZARD_CATEGORIES, *HAZARD_NUMBERS).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        design, _ = hazard_design(kept)
        train, test = design.where(~in_holdout(share)), design.where(in_holdout(share))
        shared = train.select("customer_id").join(test.select("customer_id"), "customer_id", "left_semi")
        if not shared.isEmpty():
            raise RuntimeError("a customer is on both sides of the holdout split")
        fitted = LogisticRegression(
            maxIter=1000, tol=1e-12, regParam=1.0 / train.count(), elasticNetParam=0.0, standardization=True
        ).fit(train)
        scored = fitted.transform(test).select("label", vector_to_array("rawPrediction")[1].alias("score"))
        counts = scored.groupBy("score").agg(
            F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives")
        )
        return rank_auc(counts, "score", "positives", "negatives").first()["auc"]
    finally:
        kept.unpersist()


def churn_model_summary(panel: DataFrame) -> DataFrame:
    """Holdout AUC with panel size and number of events."""
    auc = hazard_holdout_auc(panel)
    return panel.agg(
        F.lit(auc).cast("double").alias("holdout_roc_auc"),
        F.count(F.lit(1)).alias("n_panel_rows"),
        F.sum("churned_event").alias("n_events"),
    )


# -- survival curves -------------------------------------------------------------------


def km_by_activation(panel: DataFrame, months: DataFrame, threshold: float = ACTIVATED_SHARE) -> DataFrame:
    """Paid-month survival of activated against other customers."""
    paid_months = paid_only(months).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_paid"))
    subjects = (
        panel.groupBy("customer_id")
        .agg(
            F.max("row_number").alias("rows"),
            F.max("churned_event").alias("event"),
            F.max("activation_score").alias("score"),
        )
        .join(paid_months, "customer_id", "left")
        .select(
            F.coalesce("n_paid", "rows").alias("duration"),
            "event",
            F.when(F.col("score") >= threshold, "Activated (>=3/5)").otherwise("Not activated (<3/5)").alias("arm"),
        )
    )
    return kaplan_meier(subjects, "duration", "event", "arm")


# -- personas --------------------------------------------------------------------------

# The published persona features, which of them are skewed, the least cluster share and the restarts.
PERSONA_FEATURES = [
    "avg_monthly_runs",
    "failure_rate",
    "migration_share",
    "activation_score",
    "avg_llm_cost",
    "lifetime_revenue_usd",
]
SKEWED_FEATURES = ["avg_monthly_runs", "avg_llm_cost", "lifetime_revenue_usd"]
MIN_CLUSTER_SHARE = 0.05
RESTARTS = 10
FIRST_SEED = 42


def customer_usage_features(customers: DataFrame, runs: DataFrame, months: DataFrame) -> DataFrame:
    """Behaviour of every customer with at least one run."""
    n = F.count(F.lit(1))
    behaviour = runs.groupBy("customer_id").agg(
        n.alias("n_runs"),
        ratio(F.count_if(F.col("status") == "failed"), n).alias("failure_rate"),
        ratio(F.count_if(F.col("task_type") == MIGRATION_TASK), n).alias("migration_share"),
        average_cost().alias("avg_llm_cost"),
    )
    billed = months.groupBy("customer_id").agg(
        F.count_if(F.col("plan") != "Free").alias("paid_months"),
        F.sum("revenue_usd").alias("lifetime_revenue_usd"),
    )
    return (
        customers.select("customer_id", "current_plan", "first_paid_date")
        .join(behaviour, "customer_id")
        .join(activation_scores(runs), "customer_id", "left")
        .join(billed, "customer_id", "left")
        .select(
            "customer_id",
            "current_plan",
            "n_runs",
            "failure_rate",
            "migration_share",
            F.coalesce("avg_llm_cost", F.lit(0.0)).alias("avg_llm_cost"),
            F.coalesce("activation_score", F.lit(0.0)).alias("activation_score"),
            F.coalesce("paid_months", F.lit(0)).alias("paid_months"),
            F.coalesce(dbl("lifetime_revenue_usd"), F.lit(0.0)).alias("lifetime_revenue_usd"),
            F.coalesce(ratio("n_runs", "paid_months"), dbl("n_runs")).alias("avg_monthly_runs"),
            F.col("first_paid_date").isNotNull().alias("ever_paid"),
        )
    )


def never_paid_segment(features: DataFrame) -> DataFrame:
    """C11: size and mean behaviour of customers who never paid."""
    free = ~F.col("ever_paid")
    return features.agg(
        F.lit("Never converted (Free only)").alias("persona_name"),
        F.count_if(free).alias("n_customers"),
        ratio(F.count_if(free), F.count(F.lit(1))).alias("share_of_all_customers"),
        *[F.avg(F.when(free, F.col(c))).alias(c) for c in PERSONA_FEATURES],
    )


def cluster_matrix(features: DataFrame) -> DataFrame:
    """Clip skewed columns to their 1 %/99 % quantiles, log1p, then z-scores (population std)."""
    ensure_checkpoint_dir(features.sparkSession)
    # quantiles, moments and the result all read these few columns: materialise them once
    features = features.select("customer_id", *PERSONA_FEATURES).repartition("customer_id").checkpoint()
    shaped = features
    for column, (low, high) in interpolated_quantiles(features, SKEWED_FEATURES, [0.01, 0.99]).items():
        shaped = shaped.withColumn(column, F.log1p(F.greatest(F.least(column, F.lit(high)), F.lit(low))))
    moments = shaped.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in PERSONA_FEATURES],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in PERSONA_FEATURES],
    ).first()  # two numbers per feature

    def standard(column: str) -> Column:
        spread = moments[f"{column}_std"] or 1.0  # a constant column becomes 0
        return (F.col(column) - F.lit(moments[f"{column}_mean"])) / F.lit(spread)

    return shaped.select("customer_id", *[standard(c).alias(c) for c in PERSONA_FEATURES])


def choose_k(matrix: DataFrame, models: dict[int, clusters.Clusters]) -> DataFrame:
    """Silhouette (squared Euclidean) and cluster sizes for each k."""
    scores = clusters.mean_silhouettes(matrix, PERSONA_FEATURES, list(models.values())) if models else []
    rows = []
    for (k, model), score in zip(models.items(), scores):
        sizes = [int(n) for n in model.sizes]
        share = min(sizes) / sum(sizes)
        rows.append((k, score, ",".join(map(str, sizes)), share, share >= MIN_CLUSTER_SHARE))
    return matrix.sparkSession.createDataFrame(
        rows,
        "k int, silhouette_score double, cluster_sizes string, smallest_cluster_share double, "
        "meets_min_cluster_share boolean",
    )


def best_k(diagnostics: DataFrame) -> tuple[int | None, float | None]:
    """Best silhouette among k whose clusters are large enough, else the largest smallest share; None without models."""
    preference = F.struct(
        "meets_min_cluster_share",
        F.when(F.col("meets_min_cluster_share"), F.col("silhouette_score")).otherwise(
            F.col("smallest_cluster_share")
        ),
        -F.col("k"),
    )
    best = diagnostics.agg(F.max_by(F.struct("k", "silhouette_score"), preference).alias("b")).first()["b"]
    return (best["k"], best["silhouette_score"]) if best else (None, None)


def persona_models(features: DataFrame, ks: Sequence[int] = range(3, 7), restarts: int = RESTARTS):
    """(matrix, best model per k, diagnostics) over ever-paid customers; all restarts of all k share their passes."""
    # checkpointed so that the passes do not carry the feature lineage
    matrix = cluster_matrix(features.where("ever_paid")).checkpoint()
    seeds = range(FIRST_SEED, FIRST_SEED + restarts)
    models = clusters.best_restarts(clusters.fit(matrix, PERSONA_FEATURES, "customer_id", list(ks), seeds))
    return matrix, models, choose_k(matrix, models)


def persona_k_selection(features: DataFrame, ks: Sequence[int] = range(3, 7), restarts: int = RESTARTS) -> DataFrame:
    return persona_models(features, ks, restarts)[2]


def personas(
    features: DataFrame, ks: Sequence[int] = range(3, 7), restarts: int = RESTARTS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C14: (assignments, named profiles, k diagnostics); all without rows if no customer ever paid."""
    matrix, models, diagnostics = persona_models(features, ks, restarts)
    k, score = best_k(diagnostics)
    if k is None:
        labels = matrix.select("customer_id", F.lit(0).alias("cluster")).where("false")
    else:
        labels = clusters.assigned(matrix, PERSONA_FEATURES, "customer_id", models[k])
    assignments = features.where("ever_paid").join(labels, "customer_id").select(
        "customer_id", "cluster", *PERSONA_FEATURES
    )
    sizes = assignments.groupBy("cluster").agg(
        *[F.avg(c).alias(c) for c in PERSONA_FEATURES], F.count(F.lit(1)).alias("n_customers")
    )
    profile = sizes.withColumn(
        "share_of_paid_customers", ratio("n_customers", F.sum("n_customers").over(W.partitionBy()))
    ).withColumn("silhouette_score", F.lit(score).cast("double"))
    return assignments, name_personas(profile), diagnostics


def name_personas(profile: DataFrame) -> DataFrame:
    """Trait names against the unweighted mean of the centroids, made unique by revenue rank."""
    everything = W.partitionBy()

    def against_mean(column: str) -> Column:
        return F.avg(column).over(everything)

    def high(column: str, factor: float) -> Column:
        return F.col(column) >= against_mean(column) * factor

    def low(column: str, factor: float) -> Column:
        return F.col(column) <= against_mean(column) * factor

    # fixed values: trait names and their factors
    enterprise = high("lifetime_revenue_usd", 1.5)
    leading = F.array_compact(
        F.array(
            F.when(high("migration_share", 1.3), "Migration-Heavy"),
            F.when(enterprise, "Enterprise").when(low("lifetime_revenue_usd", 0.5), "Light Self-Serve"),
            F.when(high("avg_monthly_runs", 1.5) & ~enterprise, "Heavy User"),
        )
    )

    def with_trait(traits: Column, trait: Column) -> Column:
        return F.when(trait.isNotNull(), F.array_append(traits, trait)).otherwise(traits)

    reliability = F.when(high("failure_rate", 1.3), "Failure-Prone").when(
        low("failure_rate", 0.7) & (F.size("_lead") < 2), "Reliable"
    )
    at_risk = F.when(low("activation_score", 0.8) & (F.size("_mid") < 2), "At-Risk")
    traits = (
        profile.withColumn("_lead", leading)
        .withColumn("_mid", with_trait(F.col("_lead"), reliability))
        .withColumn("_all", with_trait(F.col("_mid"), at_risk))
        .withColumn(
            "_name",
            F.when(F.size("_all") == 0, "Steady Moderate User").otherwise(F.concat_ws(" ", "_all")),
        )
    )
    place = F.row_number().over(W.partitionBy("_name").orderBy(F.desc("lifetime_revenue_usd"), "cluster"))
    return (
        traits.withColumn("_place", place)
        .withColumn(
            "persona_name",
            F.when(F.col("_place") == 1, F.col("_name")).otherwise(
                F.format_string("%s (Segment %d)", "_name", "_place")
            ),
        )
        .select("persona_name", *profile.columns)
    )
