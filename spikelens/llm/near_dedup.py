"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates: the first scatters shingles over 2**32 places, the second is applied after a
circular shift by the coordinate's number. Documents with equal shingle sets form one class, and classes are the nodes.

Buckets are not expanded into pairs. In turns, each class of a bucket is compared with the bucket's leader, at first the
class that meets the most others; verified links give components. Classes of buckets that still hold several components
are then compared inside tasks, block by block, and only links that join components are put out. Copies and chains of near copies are thus linked at a cost that follows the number of rows.

No join broadcasts a side of guessed size: such sides are ``shuffled``, and joins with sums per key are left joins, in which
only the sums, measured by their own shuffle, may be broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import file_count, mix, pieces, shuffled, stored, word_hashes, word_spans
from .graph import components
from .licenses import LOWER
from .repeats import keyed

BANDS, ROWS = 24, 4  # a link at similarity 0.8 shares no bucket with probability 3e-6
SALTS = 16
TURNS = 2  # turns in which each bucket has one leader
BLOCK = 128  # classes per block when what is left is compared


def permute(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the 32-bit integers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates per set; ``shingles`` holds the sets end to end, none of them empty."""
    place = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((size, len(starts)), np.uint32)
    for k in range(size):
        out[k] = np.minimum.reduceat(permute(place - np.uint32(k)), starts)
    return out


def shingle_sets(p, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each piece: ``size`` words, or all words where there are fewer."""
    data = LOWER[p.data]
    a, b, first = word_spans(data, p.start, p.end)
    h = word_hashes(data, a, b)
    n = len(h) - size + 1
    grams = h[:0]
    if n > 0:
        grams = h[:n].copy()
        for k in range(1, size):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k])
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        elif hi > lo:
            whole = h[lo].copy().reshape(1)
            for k in range(lo + 1, hi):
                whole = mix(whole * np.uint64(0xD1342543DE82EF95) + h[k])
            out.append(mix(whole + np.uint64(hi - lo)))
        else:
            out.append(h[:0])
    return out


def _profile_rows(size: int, bands: int, rows_: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column("text"), 1 << 20):
                sets = shingle_sets(p, size)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                key = np.zeros((len(sets), 2), np.int64)
                for i in full:
                    key[i] = np.frombuffer(hashlib.md5(sets[i].tobytes()).digest(), np.int64)
                band = np.zeros((len(sets), bands), np.int64)
                if len(full):
                    starts = np.cumsum(n[full]) - n[full]
                    sig = signatures(np.concatenate([sets[i] for i in full]), starts, bands * rows_).astype(np.uint64)
                    for j in range(bands):
                        x = np.full(len(full), j, np.uint64)
                        for k in range(rows_):
                            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[j * rows_ + k])
                        band[full, j] = x.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(band.ravel()))
                at = pa.array(p.row)
                yield pa.record_batch([batch.column(c).take(at) for c in ("doc", "k1", "k2")] + [
                    pa.array(n), pa.array(key[:, 0]), pa.array(key[:, 1]), lists], names=["doc", "k1", "k2", "n", "s1", "s2", "bands"])

    return rows


def _set_rows(size: int):
    def rows(batches):
        for batch in batches:
            node = batch.column("node")
            for p in pieces(batch.column("text"), 1 << 20):
                yield pa.record_batch({"node": node.take(pa.array(p.row)),
                                       "set": pa.array([s.tobytes() for s in shingle_sets(p, size)], pa.binary())})

    return rows


def _verify_rows(percent: int):
    """Sorted by (center, salt, role): the center's own set leads its group and stays until the next one."""

    def rows(batches):
        center, lead = None, None
        for batch in batches:
            a, b = [], []
            for c, role, node, raw in zip(*[batch.column(x).to_pylist() for x in ("center", "role", "node", "set")], strict=True):
                own = np.frombuffer(raw, np.uint64)
                if role == 0:
                    center, lead = c, own
                    continue
                assert c == center
                both = len(np.intersect1d(lead, own, assume_unique=True))
                if 100 * both >= percent * (len(lead) + len(own) - both):
                    a.append(c)
                    b.append(node)
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs`` (a, b) whose full sets are similar enough. A node with very many partners is split by salt."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    asked = pairs.select(F.col("a").alias("center"), salt.alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"))
    heads = asked.select("center", "salt").distinct().select("center", "salt", F.lit(0).alias("role"), F.col("center").alias("node"))
    rows = asked.unionByName(heads).join(shuffled(sets), "node")
    return stored(rows.repartition("center", "salt").sortWithinPartitions("center", "salt", "role")
                  .select("center", "role", "node", "set").mapInArrow(_verify_rows(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc``, n_shingles, component_id and kept, one row per row.

    Words are runs of bytes outside 0x09-0x0D and 0x20, A-Z lower-cased; a text of fewer words than a shingle is one
    shingle; texts without words (nulls too) have an empty set and stay alone. ``doc`` is an integer; rows that share it
    are one document; a null never is the smallest id of its component unless all are null.
    """
    out = labelled(docs, doc, text, shingle, percent, bands, rows)
    own = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id"))
    return out.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.col("doc").eqNullSafe(own).alias("kept"))


def survivors(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
              bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, of which one of each component stays: the lowest ``doc``, nulls last.

    Rows equal in ``doc`` and text are one document. Texts without words all stay.
    """
    order = F.coalesce(F.col(doc).cast("long"), F.lit(2**63 - 1))
    found = labelled(docs, doc, text, shingle, percent, bands, rows).where("n > 0")
    best = found.groupBy("component").agg(F.min(F.struct(F.coalesce("doc", F.lit(2**63 - 1)).alias("_order"), F.col("k1").alias("_k1"),
                                                         F.col("k2").alias("_k2"))).alias("best")).select("best.*")
    key = ["_order", "_k1", "_k2"]
    source = keyed(docs, text).withColumn("_order", order)
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    full = source.where(~wordless).join(stored(best), key, "left_semi").dropDuplicates(key)
    return full.unionByName(source.where(wordless)).drop(*key)


def _joined(found: DataFrame | None, links: DataFrame, files: int) -> DataFrame:
    """Components by ``links`` and those found before, which stand for all links they were made from."""
    if found is not None:
        links = links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(links, files)


def _mixed(member: DataFrame, found: DataFrame, files: int) -> DataFrame:
    """Rows of the buckets that hold several components, with the component as ``group``."""
    now = member.join(shuffled(found), "node", "left").withColumn("group", F.coalesce("component", "node"))
    now = stored(now.drop("component"), files)
    mixed = now.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("band")
    return stored(now.join(mixed, "band", "left_semi"), files)


def _compared(rest: DataFrame, sets: DataFrame, percent: int, files: int) -> DataFrame:
    """Links between components that share buckets, every pair of such classes looked at.

    Classes tied by shared buckets form a cluster. A cluster is dealt into blocks of about ``BLOCK`` classes, and each
    pair of blocks is compared inside one task; only links that join components leave it.
    """
    lead = rest.groupBy("band").agg(F.min("node").alias("a"))
    cluster = components(rest.join(lead, "band", "left").select("a", F.col("node").alias("b")), files)
    one = stored(rest.select("node", "group").distinct().join(shuffled(cluster), "node", "left").select(
        "node", "group", F.coalesce("component", "node").alias("cluster")), files)
    blocks = one.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("m"))
    mine = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    dealt = one.join(blocks, "cluster", "left").withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("cluster", "node", "group", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    key = ["cluster", "p", "q"]
    return stored(dealt.join(shuffled(sets), "node").repartition(*key).sortWithinPartitions(*key, "own")
                  .select(*key, "own", "node", "group", "set").mapInArrow(_compare_rows(percent), "a long, b long"))


def _compare_rows(percent: int):
    def compare(held):
        own = np.array([r[0] for r in held])
        part = [r[2] for r in held]
        raw = [np.frombuffer(r[3], np.uint64) for r in held]
        n = np.array([len(x) for x in raw])
        ids = np.unique(np.concatenate(raw), return_inverse=True)[1]
        ends = np.cumsum(n)
        starts = ends - n
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        seen = np.zeros(int(ids.max()) + 1, bool)
        for i in range(len(held) - 1):
            after = np.arange(i + 1, len(held))
            if own[0] != own[-1]:  # two blocks: pairs within one of them are another task's
                after = after[own[after] != own[i]]
            after = after[100 * np.minimum(n[i], n[after]) >= percent * np.maximum(n[i], n[after])]
            after = [j for j in after.tolist() if find(part[j]) != find(part[i])]
            if not after:
                continue
            seen[ids[starts[i] : ends[i]]] = True
            for j in after:
                both = int(np.count_nonzero(seen[ids[starts[j] : ends[j]]]))
                if 100 * both >= percent * (n[i] + n[j] - both) and find(part[i]) != find(part[j]):
                    root[find(part[i])] = find(part[j])
                    yield held[i][1], held[j][1]
            seen[ids[starts[i] : ends[i]]] = False

    def rows(batches):
        held, last = [], None
        for batch in batches:
            out = []
            for c, p, q, *row in zip(*[batch.column(x).to_pylist() for x in ("cluster", "p", "q", "own", "node", "group", "set")], strict=True):
                if (c, p, q) != last and held:
                    out += compare(held)
                    held = []
                last = c, p, q
                held.append(row)
            yield pa.record_batch({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
        if held:
            out = list(compare(held))
            yield pa.record_batch({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return rows


def labelled(docs: DataFrame, doc: str, text: str, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc, text key (k1, k2), set size n, component (null for empty sets) and its lowest doc, one row per row."""
    source = keyed(docs.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")), "text")
    source = source.select("doc", F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "text")
    profile = stored(source.mapInArrow(_profile_rows(shingle, bands, rows),
                                       "doc long, k1 long, k2 long, n long, s1 long, s2 long, bands array<long>"))
    # the shingle set, hence its bands and size, follow from the key; any holder's text gives the set
    files = file_count(profile.count(), docs.sparkSession)
    nodes = stored(profile.where("n > 0").groupBy("s1", "s2").agg(F.min("doc").alias("low"), F.first("n").alias("n"),
                                                                  F.first("bands").alias("bands"),
                                                                  F.first(F.struct("k1", "k2")).alias("k"))
                   .withColumn("node", F.monotonically_increasing_id()), files)
    member = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    member = stored(member.join(shuffled(shared), "band"), files)
    # the class that meets the most others leads: what copies were made from meets all of them
    weight = member.groupBy("node").agg(F.sum("c").alias("weight"))
    member = stored(member.drop("c").join(weight, "node", "left"), files)
    asked = member.select("node").distinct().join(shuffled(nodes.select("node", "k.k1", "k.k2")), "node")
    one = source.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    sets = stored(one.join(shuffled(asked), ["k1", "k2"]).select("node", "text").mapInArrow(_set_rows(shingle), "node long, set binary"))
    near = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    found = None
    rest = member.withColumn("group", F.col("node"))
    for turn in range(TURNS):
        # one leader per bucket; later turns take any class as leader and only buckets that still hold several components
        order = F.struct("weight", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn), "band").alias("weight"), "node")
        lead = stored(rest.groupBy("band").agg(F.max(F.struct(order.alias("o"), "n", "group")).alias("lead")).select(
            "band", F.col("lead.o.node").alias("a"), F.col("lead.n").alias("n_a"), F.col("lead.group").alias("group_a")), files)
        pairs = (rest.select("band", F.col("node").alias("b"), F.col("n").alias("n_b"), "group").join(shuffled(lead), "band")
                 .where("a <> b and group <> group_a").where(near).select("a", "b").distinct())
        found = _joined(found, linked(stored(pairs, files), sets, percent), files)
        rest = _mixed(member, found, files)
    if not rest.isEmpty():
        found = _joined(found, _compared(rest, sets, percent, files), files)
    group = F.coalesce("component", "node")
    lows = nodes.join(shuffled(found), "node", "left").withColumn("component", group)
    least = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    result = stored(lows.select("s1", "s2", "component").join(least, "component", "left"), files)
    return profile.select("doc", "k1", "k2", "n", "s1", "s2").join(shuffled(result), ["s1", "s2"], "left").drop("s1", "s2")
