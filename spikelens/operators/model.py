"""Learned relevance of chain candidates: logistic regression on the pair features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions.dist import attach, settle, top_k_bounded
from .aggregate import hash_order
from .chains import PAIR_COLUMNS, candidate_pairs, with_features

MIN_PAIRS = 10
ROWS_PER_PARTITION = 50_000
# Newton steps at most; a handful suffices where both labels occur.
MAX_STEPS = 30
# Leading hash digits that cut the order into ranges.
RANGE_DIGITS = 3


def labelled_pool(events: DataFrame, anchors: DataFrame, relevant: DataFrame, window_days: int = 7) -> DataFrame:
    """Every candidate of every anchor with label 1 when it is listed as relevant.

    ``relevant`` holds ``(anchor_id, item)`` and must be settled.
    """
    listed = relevant.select("anchor_id", F.col("item").alias("event_id"), F.lit(1).alias("label"))
    pairs = candidate_pairs(events, anchors, window_days, "any", PAIR_COLUMNS)
    return attach(pairs, listed, ["anchor_id", "event_id"], "left", spread=["event_id"]).withColumn(
        "label", F.coalesce("label", F.lit(0)))


def training_pairs(
    events: DataFrame, anchors: DataFrame, relevant: DataFrame, window_days: int = 7, neg_ratio: int = 5
) -> DataFrame:
    """Pair features with labels: every positive, and ``neg_ratio`` seeded negatives for each."""
    per_anchor = relevant.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("listed"))
    most = per_anchor.agg(F.max("listed")).first()[0] or 0
    used = anchors.join(per_anchor.select("anchor_id"), "anchor_id", "left_semi")
    pool = labelled_pool(events, settle(used), relevant, window_days).withColumn(
        "_h", hash_order("anchor_id", "event_id"))
    drawn = top_k_bounded(pool, ["anchor_id", "label"], {"_h": False, "event_id": False}, max(1, most * neg_ratio), "event_id")
    drawn = settle(with_features(drawn).select("anchor_id", "event_id", "label", "rank", *C.FEATURES))
    positives = drawn.where("label = 1").groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n_pos"))
    return (
        drawn.join(positives, "anchor_id")
        .where((F.col("label") == 1) | (F.col("rank") <= F.col("n_pos") * neg_ratio))
        .select("anchor_id", "event_id", "label", *C.FEATURES)
    )


def fit_scaler(pairs: DataFrame) -> DataFrame:
    """Mean and population deviation of each feature, one row each."""
    stats = pairs.agg(*[F.struct(F.avg(f).alias("mean"), F.greatest(F.stddev_pop(f), F.lit(1e-9)).alias("std")).alias(f)
                        for f in C.FEATURES])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f"{f}.mean").alias("mean"),
                                        F.col(f"{f}.std").alias("std")) for i, f in enumerate(C.FEATURES)]))
    return stats.select(rows.alias("r")).select("r.*")


def class_weights(pairs: DataFrame) -> DataFrame:
    """Weight of each label so that both classes count the same."""
    total = pairs.agg(F.count(F.lit(1))).scalar()
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        "label", "n", (total / (2.0 * F.greatest("n", F.lit(1)))).alias("weight"))


def _scaled(pairs: DataFrame, scaler_rows) -> DataFrame:
    return pairs.select(
        "anchor_id", "event_id", "label",
        *[((F.col(r.feature) - r.mean) / r.std).alias(r.feature) for r in scaler_rows])


def exact_rank(df: DataFrame, hashed: Column, order: Sequence[str], name: str = "place") -> DataFrame:
    """Place of every row, from 0, in the order of a hex hash and then ``order``, without a global sort.

    Rows are numbered within the ranges that the first ``RANGE_DIGITS`` digits cut out; sizes of the ranges are summed up
    from the left (a table of at most 16**RANGE_DIGITS rows) and say how many rows lie before each range.
    """
    marked = df.withColumn("_hash", hashed).withColumn("_range", F.substring("_hash", 1, RANGE_DIGITS))
    sizes = marked.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", *order))
    return marked.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn(
        name, F.col("_before") + F.col("_inside") - 1).drop("_hash", "_range", "_inside", "_before")


def fold_count(n: int) -> int:
    return min(5, max(2, n // 5))


def folds(pairs: DataFrame, n: int, k: int) -> DataFrame:
    """``fold`` of every pair: equal runs of a seeded order, the last one takes what is left over."""
    ranked = exact_rank(pairs, hash_order("anchor_id", "event_id", seed="fold"), ["anchor_id", "event_id"])
    return ranked.withColumn("fold", F.least(F.floor(F.col("place") / (n // k)), F.lit(k - 1)).cast("int")).drop("place")


def _sums(weights: dict[int, np.ndarray], balance: dict[int, tuple[float, float]]):
    """Per task: gradient and curvature sums of every model over the rows outside its own fold."""
    size = len(C.FEATURES) + 1

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {m: np.zeros((size, size + 1)) for m in weights}
        for batch in batches:
            x = np.column_stack([batch[list(C.FEATURES)].to_numpy(float), np.ones(len(batch))])
            y, fold = batch["label"].to_numpy(float), batch["fold"].to_numpy()
            for m, w in weights.items():
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -700, 700)))
                share = np.where(y == 1, *balance[m]) * (fold != m)
                total[m][:, 0] += x.T @ (share * (p - y))
                total[m][:, 1:] += (x * (share * p * (1 - p))[:, None]).T @ x
        yield pd.DataFrame([(m, i, v) for m, t in total.items() for i, v in enumerate(t.ravel())], columns=["model", "i", "v"])

    return rows


def fit_models(scaled: DataFrame, models: Sequence[int], c: float = 1.0) -> dict[int, np.ndarray]:
    """Coefficients and intercept (last) of balanced, L2-penalised logistic models, one for each of ``models``.

    Model m learns from all rows whose ``fold`` is not m. The loss is the mean of the weighted losses plus
    |coefficients|^2 / 2C, which has one optimum; Newton steps run to it. A step is one job: sums per task and model, added
    up by Spark, over settled rows; the driver solves one small system per model.
    """
    size = len(C.FEATURES) + 1
    counts = {(r.fold, r.label): r.n for r in scaled.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights, balance, number = {m: np.zeros(size) for m in models}, {}, {}
    for m in models:
        positive, negative = (sum(n for (f, y), n in counts.items() if f != m and y == label) for label in (1, 0))
        number[m] = positive + negative
        balance[m] = (number[m] / (2 * max(positive, 1)), number[m] / (2 * max(negative, 1)))
    penalty = np.append(np.full(size - 1, 1 / c), 0.0)
    moving = list(models)
    for _ in range(MAX_STEPS):
        got = scaled.select("label", "fold", *C.FEATURES).mapInPandas(
            _sums({m: weights[m] for m in moving}, balance), "model int, i int, v double").groupBy("model", "i").agg(F.sum("v").alias("v"))
        sums = {m: np.zeros(size * (size + 1)) for m in moving}
        for r in got.collect():  # a few hundred numbers per model
            sums[r.model][r.i] = r.v
        for m in list(moving):
            table = sums[m].reshape(size, size + 1) / number[m]
            # a sliver of curvature keeps the step finite where one class is absent and the intercept has no optimum
            step = np.linalg.solve(table[:, 1:] + np.diag(penalty) + 1e-9 * np.eye(size), table[:, 0] + penalty * weights[m])
            weights[m] = weights[m] - np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-10:
                moving.remove(m)
        if not moving:
            break
    return weights


def fold_scores(scaled: DataFrame, models: dict[int, np.ndarray], k: int) -> DataFrame:
    """Counts and F1 of each of ``k`` folds, judged by the model that has not seen it."""
    logit = F.lit(None).cast("double")
    for m in range(k):
        total = F.lit(float(models[m][-1]))
        for f, w in zip(C.FEATURES, models[m], strict=False):
            total = total + F.col(f) * float(w)
        logit = F.when(F.col("fold") == m, total).otherwise(logit)
    one, hit, said = F.lit(1), F.col("label") == 1, F.col("predicted") == 1
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)
    return scaled.select("fold", "label", (logit >= 0).cast("int").alias("predicted")).groupBy("fold").agg(
        F.count_if(hit & said).alias("tp"), F.count_if(~hit & said).alias("fp"), F.count_if(hit & ~said).alias("fn")).withColumn(
        "f1", 2 * p * r / F.greatest(p + r, F.lit(1e-9)))


def validation_summary(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: mean and deviation of the folds' F1, and how many pairs of which label there are."""
    sizes = pairs.agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("label") == 1).alias("n_positive"),
                      F.count_if(F.col("label") == 0).alias("n_negative"))
    return scores.agg(F.count(F.lit(1)).alias("n_folds"), X.np_round(F.avg("f1"), 3).alias("cv_f1_mean"),
                      X.np_round(F.stddev_pop("f1"), 3).alias("cv_f1_std")).crossJoin(F.broadcast(sizes))


def train(pairs: DataFrame, c: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Model table ``(i, feature, mean, std, coef)`` with an intercept row, and CV scores per fold.

    ``pairs`` must be settled and hold at least ``MIN_PAIRS`` rows.
    """
    n = pairs.count()
    if n < MIN_PAIRS:
        raise ValueError(f"too few training pairs: {n}, at least {MIN_PAIRS} needed")
    spark = pairs.sparkSession
    rows = fit_scaler(pairs).orderBy("i").collect()  # 16 rows
    k = fold_count(n)
    # a partition per so many rows: each step of the fit is a job over all of them
    scaled = settle(folds(_scaled(pairs, rows), n, k).coalesce(-(-n // ROWS_PER_PARTITION)))
    models = fit_models(scaled, [*range(k), k], c)  # no row has fold k: that model learns from all
    scores = fold_scores(scaled, models, k)
    data = [(r.i, r.feature, float(r.mean), float(r.std), float(w)) for r, w in zip(rows, models[k], strict=False)]
    data.append((len(data), "intercept", 0.0, 1.0, float(models[k][-1])))
    table = spark.createDataFrame(data, "i int, feature string, mean double, std double, coef double")
    return table, scores


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def model_score(model: DataFrame):
    """Scorer for :func:`chains.find_chains` from a model table (17 numbers become literals)."""
    rows = {r.feature: r for r in model.collect()}

    def score() -> Column:
        total = F.lit(rows["intercept"].coef)
        for f in C.FEATURES:
            std = rows[f].std if rows[f].std >= 1e-9 else 1.0
            total = total + (F.col(f) - rows[f].mean) / std * rows[f].coef
        return F.rint(1.0 / (1.0 + F.exp(-total)) * 10000.0) / 10000.0

    return score


def importance(model: DataFrame) -> DataFrame:
    return model.where(F.col("feature") != "intercept").select(
        "feature", (F.rint(F.col("coef") * 10000.0) / 10000.0).alias("coef"))
