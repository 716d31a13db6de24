"""Building blocks that keep joins and top-k whole, spread out and restartable."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# A side is broadcast only when it has been counted and is at most this long.
BROADCAST_ROWS = 200_000
# Copies made of the other side when it has to be shuffled against hot keys.
SALTS = 32
# First-stage groups per key in a two-stage top-k.
SPREAD = 64
# So many ids at most become a plain filter.
LISTED_IDS = 2_000
# One item in so many is ranked first, for a bound on the k-th best row of all.
BOUND_PART = 128


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the cluster's setting; on a local master a temporary one when that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    fallback = tempfile.mkdtemp(prefix="spikelens-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def settle(df: DataFrame) -> DataFrame:
    """Compute a small derived table once, on reliable storage, and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def pin(df: DataFrame, *columns: str) -> DataFrame:
    """Columns computed once per row, whatever is filtered on them later.

    Catalyst moves a filter below the projection that makes its columns by copying
    their expressions into it, once per mention. For costly parsing that repeats the
    parsing; a generator in between keeps the filter above.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in columns or df.columns]))))


def attach(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join facts to a settled table on ``keys``; ``big`` is the left side.

    The table is broadcast when its counted size allows. Beyond that its rows are
    copied once per salt and the facts are spread over the salts by ``spread``, so
    no single key can fill one task. Every fact row meets exactly one copy, which
    makes this exact for inner, left, left_semi and left_anti joins.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    if small.count() <= max_rows:
        return big.join(F.broadcast(small), list(keys), how)
    salt = F.pmod(F.xxhash64(*(spread or big.columns)), F.lit(SALTS)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def among(big: DataFrame, small: DataFrame, column: str, max_ids: int = LISTED_IDS) -> DataFrame:
    """Rows of ``big`` whose ``column`` is one of the few values in a settled table; all rows when there are many.

    For use before a join on that column: the join stays above whatever makes the columns of ``big``, so these would be
    made for every row, while a plain filter goes down to the scan.
    """
    found = small.select(column).where(F.col(column).isNotNull()).distinct().limit(max_ids + 1).collect()
    return big if len(found) > max_ids else big.where(F.col(column).isin([r[0] for r in found]))


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows of each group in a total order, numbered from 1.

    Two stages: every map partition keeps its own best ``k`` (Spark's group limit),
    these meet in up to ``SPREAD`` sub-groups per key, and only ``SPREAD * k`` rows
    per key reach the final window. ``order`` must end in a unique column, and ``k``
    should stay within ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000), beyond
    which partitions are no longer cut down before the first shuffle.
    """
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_part", F.spark_partition_id() % SPREAD)
        .withColumn(rank, F.row_number().over(first))
        .where(F.col(rank) <= k)
        .drop("_part")
        .withColumn(rank, F.row_number().over(last))
        .where(F.col(rank) <= k)
    )


def _bound_part(item: str) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(BOUND_PART)) == 0


def _within(order: dict[str, bool], bounds: Sequence[str]) -> Column:
    """Row does not come after the bound; true as well where one of both is null."""
    within = F.lit(True)
    for (name, down), bound in reversed(list(zip(order.items(), bounds, strict=True))):
        own, limit = F.col(name), F.col(bound)
        within = ((own > limit) if down else (own < limit)) | ((own == limit) & within)
    return F.coalesce(within, F.lit(True))


def near_top(df: DataFrame, keys: Sequence[str], order: dict[str, bool], k: int, item: str) -> DataFrame:
    """Rows that may be among the first ``k`` of their group; ``order`` says per column if it descends.

    The rows of one item in ``BOUND_PART`` are ranked first. The ``k``-th of them in a group has ``k`` rows of the group at
    or before it, so no row after it is among the best ``k``. Every row is compared with that bound, and some
    ``BOUND_PART * k`` per group are left. Groups without a bound stay whole.
    """
    by = [F.desc(c) if down else F.asc(c) for c, down in order.items()]
    names = [f"_b{i}" for i in range(len(order))]
    part = top_k(df.where(_bound_part(item)).select(*keys, *order), keys, by, k).where(F.col("rank") == k)
    bounds = settle(part.select(*keys, *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)]))
    if bounds.count() > BROADCAST_ROWS:
        return df
    return attach(df, bounds, keys, "left").where(_within(order, names)).drop(*names)


def top_k_bounded(
    df: DataFrame, keys: Sequence[str], order: dict[str, bool], k: int, item: str, rank: str = "rank"
) -> DataFrame:
    """:func:`top_k` where groups are so long that sorting them fills a task: only rows of :func:`near_top` are sorted."""
    by = [F.desc(c) if down else F.asc(c) for c, down in order.items()]
    return top_k(near_top(df, keys, order, k, item), keys, by, k, rank)


def top_many(
    df: DataFrame, keys: Sequence[str], item: str, scores: dict[str, Column], k: int, name: str, keep: Sequence[str] = (),
    down: bool = True, at_once: int = 0,
) -> DataFrame:
    """Best ``k`` rows of each key under each of many scores: ``(keys, name, item, keep, score, rank)``, ties by ``item``.

    The highest scores are the best, or with ``down=False`` the lowest. As in :func:`near_top`, the ``k``-th row of one
    item in ``BOUND_PART`` is a bound, here one per score. Every row is compared with all bounds of its key, and only
    (row, score) pairs that are not after theirs are copied and ranked. Null scores are never best. Rows that are after
    all of their bounds go by a plain filter, so arrays are made of the few others only. With ``at_once`` so many scores
    are ranked in one pass: the code made for a row of many long scores is too long a method for the JVM to compile.
    """
    names = list(scores)
    if at_once and len(names) > at_once:
        parts = [top_many(df, keys, item, {s: scores[s] for s in names[i : i + at_once]}, k, name, keep, down)
                 for i in range(0, len(names), at_once)]
        return reduce(DataFrame.unionByName, parts)
    columns = {f"_s{i}": c for i, c in enumerate(scores.values())}
    wide = df.select(*keys, item, *keep, *[c.alias(n) for n, c in columns.items()])
    by = [F.desc("score") if down else F.asc("score"), F.col(item)]

    def copies(rows: DataFrame, passes, *others: str) -> DataFrame:
        good = [F.when(F.col(n).isNotNull() & passes(i, n), F.struct(F.lit(label).alias(name), F.col(n).alias("score")))
                for i, (n, label) in enumerate(zip(columns, scores, strict=True))]
        return rows.select(*keys, item, *others, F.inline(F.array_compact(F.array(*good))))

    part = copies(wide.where(_bound_part(item)), lambda i, n: F.lit(True))
    last = top_k(part, [*keys, name], by, k).where(F.col("rank") == k)
    bounds = settle(last.groupBy(*keys).agg(*[  # one row per key and score
        F.max(F.when(F.col(name) == label, F.col(c))).alias(f"_{c}{i}")
        for i, label in enumerate(scores) for c in ("score", item)]))
    met = attach(wide, bounds, keys, "left", spread=[item])
    # ties with a bound are told apart below; a condition on a score alone would go below the join and compute it once more
    some = reduce(Column.__or__, [
        F.coalesce(F.col(n) >= F.col(f"_score{i}") if down else F.col(n) <= F.col(f"_score{i}"), F.lit(True))
        for i, n in enumerate(columns)])
    few = copies(met.where(some), lambda i, n: _within({n: down, item: False}, [f"_score{i}", f"_{item}{i}"]), *keep)
    return top_k(few, [*keys, name], by, k)


def _decimal(value: int) -> Column:
    return F.lit(str(value)).cast(f"decimal({len(str(value))},0)")


def packed(major: Column, minor: Column) -> Column:
    """Two whole numbers as one of fixed width, in the order of (major, minor); a minimum of it is a hash aggregate.

    ``major`` within 10**17 of zero, ``minor`` any bigint.
    """
    below, half = _decimal(10**20), _decimal(2**63)  # 2**63 makes any bigint non-negative
    high = (major.cast("decimal(18,0)") + F.lit(10**17).cast("decimal(18,0)")).cast("decimal(18,0)")
    return (high * below + (minor.cast("decimal(19,0)") + half).cast("decimal(20,0)")).cast("decimal(38,0)")


def packed_minor(value: Column) -> Column:
    """The second number of :func:`packed`."""
    return (value % _decimal(10**20) - _decimal(2**63)).cast("bigint")


def prefer(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet ``condition``; all rows when none does (a null counts as not met).

    One row decides at once, so that the plain condition, or none, reaches the scan.
    """
    hits = df.where(condition)
    return df if hits.isEmpty() else hits
