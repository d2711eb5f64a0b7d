"""Arms of several runs: gaps, errors, exposure response, mixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.bands import Arm, parse_bands


def _arm_label(arms: Sequence[Arm], run: str = "run") -> Column:
    """Arms a run belongs to, as an array; the lists are literals."""
    marks = [F.when(F.col(run).isin(*a.runs), F.lit(a.name)) for a in arms]
    return F.array_compact(F.array(*marks))


def arm_values(band_rates: DataFrame, arms: Sequence[Arm], value: str = "rate") -> DataFrame:
    """``band, arm, n_queries, values`` with one value per run.

    The array holds one entry per run of the arm; a missing run is an error.
    """
    rows = band_rates.withColumn("arm", F.explode(_arm_label(arms)))
    sizes = F.create_map(*[c for a in arms for c in (F.lit(a.name), F.lit(len(a.runs)))])
    grouped = rows.groupBy("band", "arm").agg(
        F.max("n_queries").alias("n_queries"),
        F.array_sort(F.collect_list(F.struct("run", F.col(value).alias("v")))).alias("__v"),
    )
    complete = F.size("__v") == F.element_at(sizes, F.col("arm"))
    checked = grouped.filter(
        F.when(complete, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("arm has missing runs: "), F.col("arm"))).cast("boolean")
        )
    )
    return checked.select(
        "band", "arm", "n_queries", F.transform("__v", lambda s: s["v"]).alias("values")
    )


def arm_table(band_rates: DataFrame, arms: Sequence[Arm]) -> DataFrame:
    """Every arm against the first: gap, error, and run pairs in favour.

    An arm of one run has no spread of its own and borrows the reference's.
    """
    values = arm_values(band_rates, arms)
    ref = values.filter(F.col("arm") == arms[0].name).select(
        "band", F.col("values").alias("ref")
    )
    rows = values.filter(F.col("arm") != arms[0].name).join(ref, "band")
    mean, ref_mean = stats.array_mean(F.col("values")), stats.array_mean(F.col("ref"))
    own_sd, ref_sd = stats.array_sd(F.col("values")), stats.array_sd(F.col("ref"))
    used = F.coalesce(own_sd, ref_sd, F.lit(0.0))
    se = F.sqrt(
        F.pow(F.coalesce(ref_sd, F.lit(0.0)), 2) / F.size("ref")
        + F.pow(used, 2) / F.size("values")
    )
    favour = F.aggregate(
        F.col("ref"),
        F.lit(0),
        lambda acc, r: acc + F.size(F.filter(F.col("values"), lambda v: v > r)),
    )
    return rows.select(
        "band",
        "arm",
        "n_queries",
        ref_mean.alias("reference_mean"),
        mean.alias("mean"),
        own_sd.alias("sd"),
        (100 * (mean - ref_mean)).alias("gap_points"),
        (100 * se).alias("se_points"),
        F.when(se > 0, (mean - ref_mean) / se).alias("gap_in_se"),
        favour.alias("pairs_favouring"),
        (F.size("ref") * F.size("values")).alias("pairs_total"),
        own_sd.isNull().alias("sd_borrowed"),
    )


def cloud_quality(
    anatomy: DataFrame, arms: Sequence[Arm], quantities: Sequence[str]
) -> DataFrame:
    """``quantity, band, arm, mean, gap_points`` against the first arm."""
    long = anatomy.withColumn("arm", F.explode(_arm_label(arms))).select(
        "band",
        "arm",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(q).alias("quantity"), F.col(q).cast("double").alias("v"))
                    for q in quantities
                ]
            )
        ).alias("e"),
    )
    means = long.groupBy("e.quantity", "band", "arm").agg(F.avg("e.v").alias("mean"))
    ref = means.filter(F.col("arm") == arms[0].name).select(
        "quantity", "band", F.col("mean").alias("reference_mean")
    )
    return means.filter(F.col("arm") != arms[0].name).join(ref, ["quantity", "band"]).select(
        "quantity",
        "band",
        "arm",
        "reference_mean",
        "mean",
        (100 * (F.col("mean") - F.col("reference_mean"))).alias("gap_points"),
    )


def cloud_conversion(quality: DataFrame, cause: str, effect: str) -> DataFrame:
    """Points of ``effect`` bought per point of ``cause``; null when the cause did not move."""
    at = lambda q: F.max(F.when(F.col("quantity") == q, F.col("gap_points")))
    return (
        quality.groupBy("band", "arm")
        .agg(at(cause).alias("cause_points"), at(effect).alias("effect_points"))
        .withColumn(
            "ratio",
            F.when(
                F.abs("cause_points") > 1e-9, F.col("effect_points") / F.col("cause_points")
            ),
        )
    )


def mix_summary(items: DataFrame, size: str, threshold: int, factor: float, bands: str):
    """``band, share, weighted_share`` before and after up-weighting large items."""
    if factor <= 0:
        raise ValueError(f"factor must be positive, got {factor}")
    s = F.coalesce(F.col(size), F.lit(0))
    weight = F.when(s >= threshold, F.lit(float(factor))).otherwise(F.lit(1.0))
    # Sizes repeat, so the bands are read off the histogram.
    hist = items.groupBy(s.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    w = F.when(F.col("s") >= threshold, F.lit(float(factor))).otherwise(F.lit(1.0))
    rows = hist.withColumn("w", w * F.col("n"))
    groups = [(b.label, b.holds(F.col("s"))) for b in parse_bands(bands)]
    groups.append(("at_or_above_threshold", F.col("s") >= threshold))
    cells = F.array(
        *[
            F.struct(
                F.lit(label).alias("band"),
                F.coalesce(F.sum(F.when(test, F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("share"),
                F.coalesce(F.sum(F.when(test, F.col("w"))) / F.sum("w"), F.lit(0.0)).alias(
                    "weighted_share"
                ),
            )
            for label, test in groups
        ]
    )
    return rows.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def exposure_rows(
    band_rates: DataFrame, reference: Arm, mixes: Sequence[Arm], exposure: DataFrame
) -> DataFrame:
    """Per (mix, band): gap, items gained or lost, points per doubling of exposure.

    ``exposure`` holds ``arm, band, ratio`` (weighted over plain share).
    """
    values = arm_values(band_rates, [reference, *mixes])
    mean = stats.array_mean(F.col("values"))
    ref = values.filter(F.col("arm") == reference.name).select("band", mean.alias("reference"))
    gap = F.col("mix") - F.col("reference")
    return (
        values.filter(F.col("arm") != reference.name)
        .select("band", "arm", "n_queries", mean.alias("mix"))
        .join(ref, "band")
        .join(exposure, ["arm", "band"])
        .withColumn("log2_exposure", F.log2("ratio"))
        .withColumn("gap_points", 100 * gap)
        .withColumn("items", F.col("n_queries") * gap)
        .withColumn(
            "points_per_doubling",
            F.when(F.col("log2_exposure") != 0, F.col("gap_points") / F.col("log2_exposure")),
        )
    )


def exposure_summary(rows: DataFrame) -> DataFrame:
    """Per mix: items lost, gained, net, the exchange rate and the fitted response."""
    items = F.col("items")
    lost = F.coalesce(F.sum(F.when(items < 0, items)), F.lit(0.0))
    gained = F.coalesce(F.sum(F.when(items > 0, items)), F.lit(0.0))
    fit = stats.ols_columns(F.col("log2_exposure"), F.col("gap_points"), 1e-9, min_points=1)
    up = F.when(F.col("ratio") > 1, F.col("log2_exposure"))
    return (
        rows.groupBy("arm")
        .agg(
            lost.alias("items_lost"),
            gained.alias("items_gained"),
            F.sum("n_queries").alias("n_total"),
            fit["slope"].alias("fit_points_per_doubling"),
            fit["intercept"].alias("fit_intercept"),
            fit["r"].alias("fit_r"),
            F.coalesce(F.avg(up), F.max("log2_exposure")).alias("dose"),
        )
        .withColumn("items_net", F.col("items_lost") + F.col("items_gained"))
        .withColumn("net_points", 100 * F.col("items_net") / F.col("n_total"))
        .withColumn(
            "given_up_per_gain",
            F.when(
                (F.col("items_lost") != 0) & (F.col("items_gained") != 0),
                -F.col("items_lost") / F.col("items_gained"),
            ),
        )
    )


def exposure_marginal(summary: DataFrame) -> DataFrame:
    """Step from each dose to the next larger one; one row per mix is left by now."""
    w = Window.partitionBy(F.lit(1)).orderBy("dose", "arm")
    extra_lost = F.col("items_lost") - F.lag("items_lost").over(w)
    extra_gained = F.col("items_gained") - F.lag("items_gained").over(w)
    return (
        summary.select(
            F.lag("arm").over(w).alias("from_arm"),
            F.col("arm").alias("to_arm"),
            extra_gained.alias("extra_gained"),
            extra_lost.alias("extra_lost"),
        )
        .filter(F.col("from_arm").isNotNull())
        .withColumn(
            "given_up_per_gain",
            F.when(F.col("extra_gained") > 0, -F.col("extra_lost") / F.col("extra_gained")),
        )
    )
