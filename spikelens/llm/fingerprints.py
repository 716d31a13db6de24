"""One-permutation MinHash fingerprints with optimal densification, in DataFrame functions only.

All shingle hashes of a text are sorted once together with one marker per bin. The top bits of a hash are its bin, so the
first entry of each bin is its minimum, or the marker when the bin is empty. An empty bin takes the value of the first
non-empty bin on its own fixed random walk over all bins. Of every bin the low bits are kept, packed as hexadecimal
digits; likeness subtracts what agreeing low bits alone would give by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import pin

BINS = 128
BITS = 8
SHINGLE = 3


def _walk(j: Column, t: int, bins: int) -> Column:
    """Place t of bin j's walk: steps of an odd length drawn from j reach every bin of a power of two."""
    step = F.shiftright(F.hash(j), 8).bitwiseAND(F.lit(bins - 2)).bitwiseOR(F.lit(1))
    return (j + step * F.lit(t)).bitwiseAND(F.lit(bins - 1))


def fingerprint(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, bins: int = BINS) -> DataFrame:
    """``df`` plus ``out``: two hexadecimal digits per bin, or an empty string for a text without words.

    Words are what white space separates, lower-cased. A text shorter than a shingle is one shingle. Equal texts have
    equal fingerprints; null is as empty.
    """
    if bins & (bins - 1):
        raise ValueError("the number of bins must be a power of two")
    shift = 64 - (bins.bit_length() - 1)
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    df = df.withColumn("_w", F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ")))
    df = pin(df.withColumn("_w", F.transform("_w", lambda w: F.xxhash64(w))))
    many = F.size("_w") - (shingle - 1)
    grams = F.transform(F.slice("_w", 1, F.greatest(many, F.lit(0))), lambda w, i: F.xxhash64(
        w, *[F.get(F.col("_w"), i + F.lit(k)) for k in range(1, shingle)]))
    whole = F.array(F.xxhash64(F.array_join(F.transform("_w", lambda w: w.cast("string")), " ")))
    grams = F.when(F.size("_w") == 0, F.array().cast("array<bigint>")).when(many <= 0, whole).otherwise(grams)
    # the marker of a bin is its largest value: b<<shift | all ones below, for b taken as a signed top part
    markers = F.transform(F.sequence(F.lit(-(bins // 2)), F.lit(bins // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), shift).bitwiseOR(
        F.lit((1 << shift) - 1)))
    df = pin(df.withColumn("_h", F.sort_array(F.concat(grams, markers))).drop("_w"))
    first = F.filter("_h", lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(F.col("_h"), i - 1), shift)))
    low = F.lit((1 << shift) - 1)
    dense = F.transform(first, lambda x: F.when(x.bitwiseAND(low) != low, x))
    df = pin(df.withColumn("_d", dense).drop("_h"))
    value = F.transform("_d", lambda x, j: F.coalesce(x, *[F.get(F.col("_d"), _walk(j, t, bins)) for t in range(1, bins)]))
    hexed = F.transform(value, lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(255)))), 2, "0"))
    empty = F.forall("_d", lambda x: x.isNull())
    return pin(df.withColumn(out, F.when(empty, F.lit("")).otherwise(F.array_join(hexed, ""))).drop("_d"))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated share of common shingles: agreeing bins, less what ``BITS`` bits agree by chance; 1 for equal ones."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)),
                           lambda i: F.substr(a, i * 2 + 1, F.lit(2)) == F.substr(b, i * 2 + 1, F.lit(2))))
    chance = 2.0**-BITS
    share = F.greatest(F.lit(0.0), (same / F.lit(bins) - F.lit(chance)) / F.lit(1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(share)


def with_next(docs: DataFrame, key: str, columns: tuple[str, ...], group: int = 512, keys: DataFrame | None = None) -> DataFrame:
    """``docs`` plus ``next_<column>`` of the row that follows in descending ``key``; the first follows the last.

    Rows are cut into runs of keys at approximate quantiles, at most ``group`` of them, so runs are about equal. The
    largest row of each run also stands, as a guest, at the end of the run before it; so one shuffle and a window within
    each run see every neighbour. Rows with equal keys follow each other by text; null keys come last. ``keys``, a table
    with the same keys, is read for the cuts in place of ``docs`` where the other columns are costly.
    """
    ids = (docs if keys is None else keys).select(F.col(key).cast("long").alias("k"))
    n = ids.count()
    cuts: list = []
    if n:
        runs = max(1, min(group, n // 16))
        cuts = sorted({c for c in ids.agg(F.percentile_approx("k", [i / runs for i in range(1, runs)] or [0.5], 20 * group)).first()[0] or []})
    run = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c < F.col("_k")))

    def placed(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("_k", F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))).withColumn("_run", run)

    rows = placed(docs, key)
    heads = {r["_run"]: r["m"] for r in placed(ids, "k").groupBy("_run").agg(F.max("_k").alias("m")).collect()}  # at most `group` rows
    order = sorted(heads, reverse=True)
    before = {heads[r]: order[i - 1] for i, r in enumerate(order)}  # the run that shows this head as a guest, wrapping round
    return _lead(rows, before, columns)


def _lead(rows: DataFrame, before: dict, columns: tuple[str, ...]) -> DataFrame:
    spark = rows.sparkSession
    seats = F.broadcast(spark.createDataFrame([(k, v) for k, v in before.items()], "_k long, _guest int"))  # one row per run
    rank = F.struct(*[F.coalesce(F.col(c), F.lit("")) for c in columns])
    rows = rows.join(seats, "_k", "left")
    places = F.when(F.col("_guest").isNull(), F.array(F.struct(F.col("_run").alias("run"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("_run").alias("run"), F.lit(0).alias("guest")), F.struct(F.col("_guest").alias("run"), F.lit(1).alias("guest"))))
    rows = rows.withColumn("_at", F.explode(places)).withColumns({"_run": F.col("_at.run"), "_g": F.col("_at.guest")}).drop("_at", "_guest")
    w = Window.partitionBy("_run").orderBy("_g", F.col("_k").desc(), rank)
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("_g = 0").drop("_g", "_k", "_run")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last third comes from the start of the next text.

    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(fingerprint(rows, "text", "fingerprint"), key, ("text", "fingerprint"), keys=docs)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.select(key, "fingerprint", n.cast("long").alias("n_chars"), "next_fingerprint",
                       F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)).alias("edited"))
    rows = fingerprint(pin(rows), "edited", "edited_fingerprint")
    return rows.select(key, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
