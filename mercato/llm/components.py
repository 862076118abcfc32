"""Connected components: a spanning forest within a task, alternating stars across tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import materialize


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def forest(pairs: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links node -> smallest node of its component, for ``n`` nodes and blocks of index pairs; memory is O(n + block)."""
    parent = np.arange(n)
    for x, y in pairs:
        while True:
            rx, ry = parent[x], parent[y]
            apart = rx != ry
            if not apart.any():
                break
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            np.minimum.at(parent, np.maximum(rx, ry), np.minimum(rx, ry))
            parent = _roots(parent)
    src = np.flatnonzero(parent != np.arange(n))
    return src, parent[src]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        src, dst = forest([(at[: len(a)], at[len(a):])], len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[src]), pa.array(ids[dst])], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id of the component) of every node that ``links`` (two long columns) joins to another.

    Links are first contracted within each Arrow batch.  Then rounds of large and
    small stars follow until the links no longer change; a node's smallest
    neighbour is a partial aggregate and the join back can be split, so a node
    with a third of all links is no hot task.  Each round is written to the
    shared folder.  Null ends and self-links are ignored.
    """
    a, b = links.columns[:2]
    clean = links.where(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND `{a}` <> `{b}`").select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = materialize(clean.mapInArrow(_contract, "u long, v long").distinct())  # u > v
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(small_least, "u")
        small = pulled.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small_least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum of a link table."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
