"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

A key's hash is its place on the ring; the next virtual node clockwise owns it. Every shard has a capacity, and the
capacities sum to the number of rows and differ by one at most, so counts do too. Keys that overflow a full shard go on
clockwise to the next node with room. Who overflows follows from the number of keys on each arc of the ring alone, and
the arcs are fixed in number, so that part is settled on a table of bounded size. Rows are numbered within small bins of
the ring, which spread evenly because places are hashes, and prefix sums make that a number within the arc.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window, functions as F

from .common import pin, settle

BINS = 1 << 14
VNODES = 64


def node_bins(shards: int, vnodes: int = VNODES, bins: int = BINS) -> list[tuple[int, int]]:
    """(last bin, shard) of every virtual node, clockwise; nodes of one bin after each other, the first one owns it."""
    out = []
    for s in range(shards):
        for v in range(vnodes):
            digest = hashlib.md5(f"{s}/{v}".encode()).digest()
            out.append((int.from_bytes(digest[:4], "little") % bins, s))
    return sorted(out)


def fill(arcs: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, first slot): keys of each arc in turn; a key goes as few nodes on as room allows.

    All keys try their own node first, then those left over the next one, and so on, so that keys move only when their
    shard is full.
    """
    n = len(owners)
    left, done, used = list(arcs), [0] * n, [0] * len(capacity)
    out = []
    for step in range(n + 1):
        waiting = [a for a in range(n) if left[a]]
        if not waiting:
            break
        for a in waiting:
            s = owners[(a + step) % n]
            k = min(left[a], capacity[s] - used[s])
            if k > 0:
                out.append((a, done[a], done[a] + k, s, used[s]))
                left[a], done[a], used[s] = left[a] - k, done[a] + k, used[s] + k
    return out


def shard_rows(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", vnodes: int = VNODES, bins: int = BINS) -> DataFrame:
    """``key`` plus size, text_crc32, law, shard, slot and grown_shard (null: the law is ``rows``), one row per row.

    Size is the UTF-8 bytes of the text (null: none) plus 1. Null keys share one place of the ring and are spread within
    their arc by their text. Counts of any two shards differ by one at most; slots are gapless from 0.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    nodes = node_bins(shards, vnodes, bins)
    ends, owners = [b for b, _ in nodes], [s for _, s in nodes]
    rows = docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                       F.xxhash64(F.col(key)).alias("place"))
    rows = rows.withColumn("bin", F.shiftrightunsigned("place", 64 - (bins.bit_length() - 1)).cast("int"))
    # rows of one key are told apart by their text only: a bin is cut into lanes by it, so no key fills a group
    rows = rows.withColumn("lane", F.pmod(F.xxhash64(F.col(key), "text_crc32", "size"), F.lit(8)).cast("int"))
    counts = settle(rows.groupBy("bin", "lane").agg(F.count(F.lit(1)).alias("n")))
    per_bin = {(r["bin"], r["lane"]): r["n"] for r in counts.collect()}  # at most 8 * bins rows, whatever the input
    arc_of = [bisect_left(ends, b) % len(ends) for b in range(bins)]
    arcs, base = [0] * len(ends), []
    for b, lane in sorted(per_bin):
        a = arc_of[b]
        base.append((b, lane, a, arcs[a]))
        arcs[a] += per_bin[b, lane]
    total = sum(arcs)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    parts: dict[int, list] = {}
    for a, lo, hi, s, slot in fill(arcs, owners, capacity):
        parts.setdefault(a, []).append((lo, hi, s, slot))
    layout = spark.createDataFrame([(b, lane, at, parts[a]) for b, lane, a, at in base],
                                   "bin int, lane int, base long, parts array<struct<lo: long, hi: long, shard: int, slot: long>>")
    inside = F.row_number().over(Window.partitionBy("bin", "lane").orderBy("place", key, "text_crc32", "size"))
    # at most 8 * bins rows: bounded whatever the input
    out = rows.withColumn("inside", inside).join(F.broadcast(layout), ["bin", "lane"]).withColumn(
        "number", F.col("base") + F.col("inside") - 1)
    out = pin(out.withColumn("part", F.filter("parts", lambda p: (p["lo"] <= F.col("number")) & (F.col("number") < p["hi"]))[0]).drop("parts"))
    return out.select(key, "size", "text_crc32", F.lit("rows").alias("law"), F.col("part.shard").alias("shard"),
                      (F.col("part.slot") + F.col("number") - F.col("part.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
