"""Connected components by forests inside tasks and jumps between them; no group or edge list leaves the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node that is not the smallest of its component to the one that is."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    low = np.arange(len(ids))
    while len(u):
        least = np.minimum(low[u], low[v])
        np.minimum.at(low, low[u], least)
        np.minimum.at(low, low[v], least)
        while (low[low] != low).any():
            low = low[low]
        apart = low[u] != low[v]
        u, v = u[apart], v[apart]
    leaf = low != np.arange(len(ids))
    return ids[leaf], ids[low[leaf]]


def _forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of the edges (a > b) of one task. ``odd`` if one of them was, or if a node had two smaller neighbours."""
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy(), pc.any(batch.column("odd")).as_py())
            for batch in batches if batch.num_rows]
    if held:
        a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        own, other = forest(a, b)
        pairs = np.unique(np.stack([a, b]), axis=1)
        odd = any(x[2] for x in held) or bool((pairs[0, 1:] == pairs[0, :-1]).any())
        yield pa.record_batch({"a": own, "b": other, "odd": np.full(len(own), odd)})


FOREST = "a long, b long, odd boolean"


def components(edges: DataFrame, files: int = 0, rounds: int = 50) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of ``edges`` (long columns a, b) but the smallest ones
    themselves; stored.

    Edges lead from a node to a smaller one. A round leads each of them on to the smallest neighbour of its lower end,
    brings all edges of their upper ends together and takes the forest of what a task holds. Each change lowers an end,
    and edges that a round leaves as they are form stars around the smallest nodes. Rounds with few shuffles matter: on
    small inputs the time is that of starting tasks.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(False).alias("odd"))
    now = stored(now.mapInArrow(_forest_rows, FOREST).repartition("a").mapInArrow(_forest_rows, FOREST), files)
    for _ in range(rounds):
        least = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        led = now.select("a", "b").join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("odd"))
        now = stored(led.repartition("a").mapInArrow(_forest_rows, FOREST), files)
        if now.where("odd").isEmpty():
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
