"""Lead-lag correlation between countries' daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import exprs as X

MIN_COMMON_DAYS = 14
MIN_POINTS = 10


def common_days(series: DataFrame) -> DataFrame:
    """Days each unordered pair of countries has in common, numbered in order.

    One row per pair and day with both values; ``series`` has ``country, day, value``
    and one row per country and day, so nothing here grows with the events.
    """
    a = series.select("day", F.col("country").alias("country_a"), F.col("value").cast("double").alias("value_a"))
    b = series.select("day", F.col("country").alias("country_b"), F.col("value").cast("double").alias("value_b"))
    w = Window.partitionBy("country_a", "country_b").orderBy("day")
    return a.join(b, "day").where(F.col("country_a") < F.col("country_b")).withColumn("pos", F.row_number().over(w))


def shifted_pairs(common: DataFrame, max_lag: int = 7) -> DataFrame:
    """Values a(t), b(t + lag) for every lag. A positive lag means a comes first."""
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    a = common.select("country_a", "country_b", "pos", "value_a", lags)
    b = common.select("country_a", "country_b", F.col("pos").alias("pos_b"), "value_b")
    return (
        a.withColumn("pos_b", F.col("pos") + F.col("lag"))
        .join(b, ["country_a", "country_b", "pos_b"])
        .drop("pos_b")
    )


def pearson_p(r, n):
    """Two-sided p-value of a correlation, t approximated by the normal."""
    df = (n - 2).cast("double")
    safe = F.when(F.abs(r) < 1, 1 - r * r).otherwise(1.0)
    t = F.abs(r * F.sqrt(df / safe))
    small = t * F.sqrt(F.greatest(df - 2, F.lit(0.5)) / F.greatest(df, F.lit(1.0)))
    z = F.when(df > 30, t).otherwise(small)
    p = F.when(df <= 0, 1.0).otherwise(2.0 * X.norm_sf(z))
    return F.when(F.abs(r) >= 1, 0.0).otherwise(p)


def lag_correlations(series: DataFrame, max_lag: int = 7) -> DataFrame:
    """Correlation and p per pair and lag; pairs with too few common days have no rows."""
    common = common_days(series)
    enough = Window.partitionBy("country_a", "country_b")
    common = common.withColumn("n_common_days", F.count(F.lit(1)).over(enough)).where(
        F.col("n_common_days") >= MIN_COMMON_DAYS)
    stats = shifted_pairs(common, max_lag).groupBy("country_a", "country_b", "lag").agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("value_a", "value_b").alias("cov"),
        F.stddev_pop("value_a").alias("sa"),
        F.stddev_pop("value_b").alias("sb"),
    ).where(F.col("n") >= MIN_POINTS)
    flat = (F.col("sa") < 1e-9) | (F.col("sb") < 1e-9)
    r = F.when(flat, 0.0).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / (F.col("sa") * F.col("sb")))))
    # rounding noise keeps exact copies just under 1; they count as 1
    r = F.when(F.abs(r) > 1 - 1e-12, F.signum(r)).otherwise(r)
    return stats.withColumn("r", r).select(
        "country_a", "country_b", "lag", "n",
        X.np_round(F.col("r"), 4).alias("correlation"),
        F.when(flat, 1.0).otherwise(X.np_round(pearson_p(F.col("r"), F.col("n")), 4)).alias("p_value"),
    )


def best_lags(correlations: DataFrame) -> DataFrame:
    """Strongest significant lag per pair, else the strongest of all; the lowest lag on ties."""
    w = Window.partitionBy("country_a", "country_b").orderBy(
        F.desc(F.col("p_value") < 0.05), F.desc(F.abs("correlation")), "lag")
    return (
        correlations.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1)
        .select("country_a", "country_b", F.col("lag").alias("best_lag"),
                F.col("correlation").alias("best_correlation"), F.col("p_value").alias("best_p_value"))
    )


def pair_report(series: DataFrame, max_lag: int = 7) -> DataFrame:
    """Every unordered pair: best lag and sentence, or why there is none."""
    names = F.array_sort(F.collect_set("country"))  # one entry per country
    days = common_days(series).groupBy("country_a", "country_b").agg(F.count(F.lit(1)).alias("n_common_days"))
    pairs = (
        series.agg(names.alias("all"))
        .select("all", F.posexplode("all").alias("i", "country_a"))
        .select("country_a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("country_b"))
    )
    keys = ["country_a", "country_b"]
    report = pairs.join(days, keys, "left").withColumn("n_common_days", F.coalesce("n_common_days", F.lit(0))).join(
        best_lags(lag_correlations(series, max_lag)), keys, "left")
    short = F.col("n_common_days") < MIN_COMMON_DAYS
    return report.withColumns({
        "error": F.when(short, F.concat(F.lit("Not enough overlapping dates ("),
                                        F.col("n_common_days").cast("string"), F.lit(")")))
                  .when(F.col("best_lag").isNull(), "No valid lag computations"),
        "interpretation": F.when(F.col("best_lag").isNotNull(), interpretation()),
    })


def interpretation():
    a, b, lag = F.col("country_a"), F.col("country_b"), F.col("best_lag")
    r, p = F.col("best_correlation"), F.col("best_p_value")
    tail = F.concat(
        F.lit("("), F.when(r > 0, "positive").otherwise("inverse"), F.lit(" r="), X.fixed(r, 3), F.lit(")"),
        F.when(p < 0.05, " (statistically significant)").otherwise(""), F.lit("."))

    def precede(x, y):
        return F.concat(F.lit("Spikes in "), x, F.lit(" precede spikes in "), y, F.lit(" by ~"),
                        F.abs(lag).cast("string"), F.lit("d "), tail)

    return (
        F.when(F.abs(r) < 0.15, F.concat(F.lit("No meaningful correlation between "), a, F.lit(" and "), b, F.lit(".")))
        .when(lag > 0, precede(a, b))
        .when(lag < 0, precede(b, a))
        .otherwise(F.concat(F.lit("Spikes in "), a, F.lit(" and "), b, F.lit(" co-occur "), tail))
    )


def burst_series(bursts: DataFrame, metric: str = "event_count") -> DataFrame:
    return bursts.select("country", "day", F.col(metric).cast("double").alias("value"))
