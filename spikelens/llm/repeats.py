"""Every window of a corpus that starts more than once, found without comparing documents with each other.

A *unit* is a byte or a word. In each window of ``window`` units the smallest hashed ``k``-gram is its *anchor*;
equal windows have equal anchors, so only runs of windows whose anchor hash is met twice can repeat.

1. Equal texts become one row with a count (``texts``), stored bucketed by the text's 128-bit key, so that the two
   later joins with per-text facts move only the facts.
2. Anchor hashes met twice are kept (partial counts, then a join Spark may split by skew).
3. The runs at such anchors are cut out as *segments*; equal segments become one row with a count.
4. A bucket is one anchor hash. Its distinct segments are compared by the operator's matcher (suffix array or suffix
   automaton) in one task when at most ``bucket`` of them differ. Segments of a larger bucket are cut into blocks of
   windows at a like distance from the anchor. Windows of a block share a core of bytes, and equal windows share it
   too, so the core makes finer buckets; equal blocks become one again, and so on down to single windows.
5. Repeated windows flow back to segments, texts and rows.

``keep="none"`` marks all copies of a window, ``keep="first"`` all but the one in the row with the smallest
``order`` value (ties: smallest key, then place). Rows equal in text and ``order`` both count as the first.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_values, file_count, gram_hashes, pieces, stored, word_hashes, word_spans

BLOCK = 1 << 23
GROUP = 1 << 20  # payload bytes matched at once


@dataclass(frozen=True)
class Unit:
    """What is compared: 1-byte or 8-byte payload units, window and anchor lengths in units."""

    size: int
    window: int
    k: int

    def values(self, p):
        """Hashable values of all units of some pieces, and per piece its first unit (plus the total)."""
        if self.size == 1:
            return byte_values(p.data), np.append(p.start, len(p.data)), None
        a, b, first = word_spans(p.data, p.start, p.end)
        return word_hashes(p.data, a, b), first, (a, b)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every ``w`` neighbours: minima of block heads and tails."""
    n = len(x)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def runs(values: np.ndarray, first: np.ndarray, unit: Unit):
    """Runs of windows with one anchor: piece, first window, end window (places in ``values``), anchor hash, anchor."""
    w, total = unit.window - unit.k + 1, len(values) - unit.window + 1
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = np.uint64((1 << 24) - 1)
    for lo in range(0, max(0, total), BLOCK):
        hi = min(lo + BLOCK, total)
        h = gram_hashes(values[lo : hi + unit.window - 1], unit.k)
        at = (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), w) & low).astype(np.int64)
        piece = owner[lo:hi]
        valid = np.arange(lo, hi) + unit.window <= first[piece + 1]
        new = np.ones(hi - lo, bool)
        new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]) | (valid[1:] != valid[:-1])
        b = np.flatnonzero(new)
        e = np.append(b[1:], hi - lo)
        ok = valid[b]
        b, e = b[ok], e[ok]
        for out, x in zip(found, (piece[b], b + lo, e + lo, h[at[b]], at[b] + lo), strict=True):
            out.append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]


def _anchor_rows(unit: Unit):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for p in pieces(batch.column("text")):
                values, first, _ = unit.values(p)
                piece, _, _, h, _ = runs(values, first, unit)
                if not len(h):
                    continue
                h = h.view(np.int64)
                # once per text and hash, twice where a text repeats it itself
                by = np.lexsort((h, piece))
                piece, h = piece[by], h[by]
                same = np.zeros(len(h), bool)
                same[1:] = (piece[1:] == piece[:-1]) & (h[1:] == h[:-1])
                third = same.copy()
                third[1:] &= same[:-1]
                third[:1] = False
                row = p.row[piece[~third]]
                yield pa.record_batch({"h": h[~third], "k1": k1[row], "k2": k2[row]})

    return rows


def _key_of(payload: bytes) -> tuple[int, int]:
    d = hashlib.md5(payload).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _segment_rows(unit: Unit):
    schema = pa.schema([("h", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("rank", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("off", pa.int32()),
                        ("seg", pa.binary())])

    def rows(batches):
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            rank, wanted = batch.column("rank").to_numpy(), batch.column("hs")
            for p in pieces(batch.column("text")):
                values, first, _ = unit.values(p)
                piece, b, e, h, at = runs(values, first, unit)
                h = h.view(np.int64)
                edges = np.searchsorted(piece, np.arange(len(p.row) + 1))
                out = [[] for _ in schema]
                raw = p.data if unit.size == 1 else values
                for i, r in enumerate(p.row.tolist()):
                    lo, hi = edges[i], edges[i + 1]
                    if lo == hi:
                        continue
                    for j in (lo + np.flatnonzero(np.isin(h[lo:hi], wanted[r].values.to_numpy()))).tolist():
                        seg = raw[b[j] : e[j] + unit.window - 1].tobytes()
                        for o, x in zip(out, (h[j], *_key_of(seg), k1[r], k2[r], rank[r], b[j] - first[i], e[j] - b[j], at[j] - b[j], seg),
                                        strict=True):
                            o.append(x)
                if out[0]:
                    yield pa.record_batch([pa.array(x, t.type) for x, t in zip(out, schema, strict=True)], schema=schema)

    return rows


SEGMENTS = "h long, s1 long, s2 long, k1 long, k2 long, rank long, at long, n int, off int, seg binary"
FLAGS = "h long, s1 long, s2 long, marks array<int>"


def intervals(flags: np.ndarray) -> np.ndarray:
    """[from, to, from, to, ...] of the runs of true values."""
    edge = np.zeros(len(flags) + 2, np.int8)
    edge[1:-1] = flags
    return np.flatnonzero(np.diff(edge))


def _match_rows(match: Callable, unit: Unit, keep: str):
    """Whole buckets, sorted by anchor hash, in groups of about ``GROUP`` payload bytes."""

    def flush(rows):
        segs = [r[3] for r in rows]
        order = np.empty(len(rows), np.int64)
        order[sorted(range(len(rows)), key=lambda i: rows[i][4])] = np.arange(len(rows))
        bucket = np.unique([r[0] for r in rows], return_inverse=True)[1]
        flags = match(segs, bucket, order, unit, keep)
        keys = [r[:3] for r in rows]
        marks = [intervals(f).astype(np.int32) for f in flags]
        return pa.record_batch({**{c: pa.array([k[i] for k in keys], pa.int64()) for i, c in enumerate(("h", "s1", "s2"))},
                                "marks": pa.array(marks, pa.list_(pa.int32()))})

    def rows(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("h", "s1", "s2", "seg", "head")], strict=True):
                if r[0] != last and size >= GROUP:
                    yield flush(held)
                    held, size = [], 0
                held.append((*r[:4], tuple(r[4].values())))
                size, last = size + len(r[3]), r[0]
        if held:
            yield flush(held)

    return rows


def _split_rows(unit: Unit, block: int):
    """Segments cut into blocks of windows whose distance to the anchor is alike. All windows of a block share a core,
    so (bucket, block, core) is a finer bucket that still holds every pair of equal windows."""
    schema = pa.schema([*((c, pa.int64()) for c in ("h", "s1", "s2", "ph", "ps1", "ps2", "at")), ("n", pa.int32()),
                        ("off", pa.int32()), ("seg", pa.binary()), ("rank", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("place", pa.int64())])

    def rows(batches):
        for batch in batches:
            out = [[] for _ in schema]
            for h, s1, s2, n, off, seg, head in zip(*[batch.column(c).to_pylist() for c in ("h", "s1", "s2", "n", "off", "seg",
                                                                                            "head")], strict=True):
                j = 0
                while j < n:
                    b = (off - j) // block
                    end = min(n, off - b * block + 1)
                    core = seg[(off - b * block) * unit.size : (off - (b + 1) * block + 1 + unit.window) * unit.size]
                    sub = seg[j * unit.size : (end - 1 + unit.window) * unit.size]
                    new = _key_of(b"%d,%d," % (h, b) + core)[0]
                    for o, x in zip(out, (new, *_key_of(sub), h, s1, s2, j, end - j, off - j, sub, head["rank"], head["k1"],
                                          head["k2"], head["at"] + j), strict=True):
                        o.append(x)
                    j = end
            yield pa.record_batch([pa.array(x, t.type) for x, t in zip(out, schema, strict=True)], schema=schema)

    return rows


SPLIT = ("h long, s1 long, s2 long, ph long, ps1 long, ps2 long, at long, n int, off int, seg binary, rank long, k1 long, "
         "k2 long, place long")


def _digest_rows(unit: Unit, with_text: bool):
    def rows(batches):
        for batch in batches:
            k1, k2, copies, marks = (batch.column(c) for c in ("k1", "k2", "copies", "marks"))
            out = []
            for p in pieces(batch.column("text")):
                if unit.size == 1:
                    first, spans = np.append(p.start, len(p.data)), None
                else:
                    a, b, first = word_spans(p.data, p.start, p.end)
                    spans = (a, b)
                for i, r in enumerate(p.row.tolist()):
                    n, gone = int(first[i + 1] - first[i]), None
                    if copies[r].as_py():
                        gone = np.full(n, n >= unit.window)
                    else:
                        depth = np.zeros(n + 1, np.int64)
                        if marks[r].is_valid:
                            for pair in marks[r].values:
                                m = pair.values.to_numpy().reshape(-1, 2)
                                np.add.at(depth, m[:, 0], 1)
                                np.add.at(depth, m[:, 1] + unit.window - 1, -1)
                        gone = np.cumsum(depth[:-1]) > 0
                    cut = intervals(gone).reshape(-1, 2)
                    lo = int(p.start[i])
                    hi = int(p.end[i])
                    if unit.size == 1:
                        kept = p.data[lo:hi][~gone].tobytes()
                        text = kept.decode("utf-8", "ignore") if with_text else None
                    else:
                        wa, wb = spans[0][first[i] : first[i + 1]], spans[1][first[i] : first[i + 1]]
                        raw = p.data[lo:hi].tobytes()
                        if len(cut):
                            kept = b" ".join(raw[x - lo : y - lo] for x, y in zip(wa[~gone].tolist(), wb[~gone].tolist(), strict=True))
                        else:
                            kept = b" ".join(raw.split())
                        text = None
                        if with_text:
                            ends = np.append(wa, hi) - lo
                            bits, at = [], 0
                            for x, y in cut.tolist():
                                bits.append(raw[at : int(wa[x]) - lo])
                                at = int(ends[y])
                            text = b"".join([*bits, raw[at:]]).decode()
                    out.append((k1[r].as_py(), k2[r].as_py(), n, int(gone.sum()), len(cut), hashlib.sha256(kept).hexdigest(), text))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                    names=["k1", "k2", "n_units", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return rows


DIGEST = "k1 long, k2 long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the two halves of the text's md5 as ``_k1`` and ``_k2``."""
    md5 = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))

    def half(a):
        """Sixteen hexadecimal digits as a long, by its halves: a whole would not fit."""
        hi, lo = (F.conv(F.substring(md5, a + i, 8), 16, 10).cast("long") for i in (0, 8))
        return F.shiftleft(hi, 32).bitwiseOR(lo)

    return docs.withColumns({"_k1": half(1), "_k2": half(17)})


def remove(docs: DataFrame, unit: Unit, match: Callable, keep: str = "none", text: str = "text", order: str = "doc_id",
           bucket: int = 400, with_text: bool = False) -> DataFrame:
    """``docs`` plus n_units, n_removed, n_spans, kept_sha256 and, on demand, kept_text.

    Nulls count as empty texts; repeated rows are copies of each other; an empty table gives an empty result. ``match``
    gets segments as bytes, their bucket numbers, their ranks and the unit, and returns one array of flags, one per
    window, for each segment. ``order`` (an integer column) matters only for ``keep="first"``.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"unknown keep: {keep}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"repeats_{uuid.uuid4().hex}"
    rows = keyed(docs, text)
    (rows.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                 F.coalesce(F.col(order).cast("long"), F.lit(2**63 - 1)).alias("rank"))
     .groupBy("k1", "k2").agg(F.first("text").alias("text"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("copies"))
     .write.bucketBy(parts, "k1", "k2").option("compression", "zstd").saveAsTable(name))
    texts = spark.table(name)
    try:
        return _removed(rows, texts, unit, match, keep, order, bucket, with_text)
    finally:
        spark.sql(f"drop table if exists {name}")


KEY = ["h", "s1", "s2"]
#: Windows per block when a bucket is too large for one task, level after level; a block of one window ends it.
SPLITS = (32, 6, 1)


def _flags(items: DataFrame, unit, match, keep, bucket, splits, files: int) -> DataFrame:
    """Distinct segments with ``n``, ``head`` (first holder), ``members`` and the ``marks`` of windows met in others."""
    distinct = stored(items.groupBy(*KEY).agg(
        F.first("seg").alias("seg"), F.first("n").alias("n"), F.first("off").alias("off"), F.min("head").alias("head"),
        F.count(F.lit(1)).alias("members")), files)
    sizes = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = stored(distinct.drop("members").join(sizes, "h"), files)
    small = shared.where(F.col("c") <= bucket) if splits else shared
    flags = small.select(*KEY, "seg", "head").repartition("h").sortWithinPartitions("h").mapInArrow(
        _match_rows(match, unit, keep), FLAGS)
    large = shared.where(F.col("c") > bucket)
    if splits and not large.isEmpty():
        parts = stored(large.mapInArrow(_split_rows(unit, splits[0]), SPLIT), files).withColumn(
            "head", F.struct("rank", "k1", "k2", F.col("place").alias("at")))
        found = _spread(parts, _flags(parts, unit, match, keep, bucket, splits[1:], files), keep, "ph", "ps1", "ps2")
        flags = flags.unionByName(found.groupBy(F.col("ph").alias("h"), F.col("ps1").alias("s1"), F.col("ps2").alias("s2")).agg(
            F.flatten(F.transform(F.collect_list("marks"), lambda m: m.cast("array<int>"))).alias("marks")))
    return stored(distinct.select(*KEY, "n", "head", "members").join(flags, KEY, "left"), files)


def _spread(items: DataFrame, flags: DataFrame, keep: str, *owner: str) -> DataFrame:
    """Marks of distinct segments given to all their holders, as places within the holder."""
    whole = F.array(F.lit(0), F.col("n"))
    member = items.select(*KEY, *owner, "at", F.col("head").alias("own")).join(flags, KEY)
    if keep == "first":
        marks = F.when(F.col("own") == F.col("head"), F.col("marks")).otherwise(whole)
    else:
        marks = F.when(F.col("members") > 1, whole).otherwise(F.col("marks"))
    return member.withColumn("marks", marks).where(F.size("marks") > 0).select(
        *owner, F.transform("marks", lambda m: m.cast("long") + F.col("at")).alias("marks"))


def _removed(rows, texts, unit, match, keep, order, bucket, with_text):
    anchors = texts.select("k1", "k2", "text").mapInArrow(_anchor_rows(unit), "h long, k1 long, k2 long")
    files = file_count(texts.count(), texts.sparkSession)
    anchors = stored(anchors, files)
    twice = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    wanted = anchors.join(twice, "h").groupBy("k1", "k2").agg(F.collect_set("h").alias("hs"))
    segments = stored(texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "rank", "text", "hs")
                      .mapInArrow(_segment_rows(unit), SEGMENTS), files)
    segments = segments.withColumn("head", F.struct("rank", "k1", "k2", F.col("at").alias("at")))
    member = _spread(segments, _flags(segments, unit, match, keep, bucket, SPLITS, files), keep, "k1", "k2")
    marked = member.groupBy("k1", "k2").agg(F.collect_list("marks").alias("marks"))
    copied = (F.col("copies") > 1) if keep == "none" else F.lit(False)
    digest = stored(texts.join(marked, ["k1", "k2"], "left").select("k1", "k2", "text", copied.alias("copies"), "marks", "rank")
                    .select("k1", "k2", "text", "copies", "marks").mapInArrow(_digest_rows(unit, with_text), DIGEST), files)
    if keep == "first":
        digest = digest.join(texts.select("k1", "k2", "rank"), ["k1", "k2"])
        digest = stored(digest, files)
    facts = digest.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"),
                          *[c for c in digest.columns if c not in ("k1", "k2", *([] if with_text else ["kept_text"]))])
    names = [c for c in rows.columns if c not in facts.columns or c in ("_k1", "_k2")]
    out = rows.select(*names).join(facts, ["_k1", "_k2"])
    if keep == "first":
        later = F.coalesce(F.col(order).cast("long"), F.lit(2**63 - 1)) > F.col("rank")
        gone = later & (F.col("n_units") >= unit.window)
        empty = F.sha2(F.lit("").cast("binary"), 256)
        out = out.withColumns({
            "n_removed": F.when(gone, F.col("n_units")).otherwise(F.col("n_removed")),
            "n_spans": F.when(gone, F.lit(1)).otherwise(F.col("n_spans")).cast("long"),
            "kept_sha256": F.when(gone, empty).otherwise(F.col("kept_sha256")),
            **({"kept_text": F.when(gone, F.lit("")).otherwise(F.col("kept_text"))} if with_text else {})}).drop("rank")
    return out.drop("_k1", "_k2")
