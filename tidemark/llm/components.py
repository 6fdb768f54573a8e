"""Connected components of an edge table: few edges in one task, more by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Up to so many edges, 16 bytes each, are linked in one task: rounds of small tasks cost more than the edges.
FEW = 1_000_000


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["x"], r["s"]


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges, and for each the smallest node reachable."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    lead = np.arange(len(nodes))
    while len(a):
        np.minimum.at(lead, np.maximum(a, b), np.minimum(a, b))
        while (lead[lead] != lead).any():
            lead = lead[lead]
        a, b = lead[a], lead[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[lead]


def linked(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if sides:
            found = least_reachable(*(np.concatenate(side) for side in zip(*sides)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "component"])

    return cut(edges.coalesce(1).mapInArrow(run, "node bigint, component bigint"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (u bigint, v bigint).

    The component is the smallest node reachable.  Nodes that have no edge do not occur.
    Up to ``FEW`` edges go to one task.  More stay dealt out; minima are taken before each shuffle, and the join that
    spreads them splits hot nodes under adaptive execution.  Every round is checkpointed
    in the shared folder.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= FEW:
        return linked(edges)
    before = None
    while (now := _signature(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every edge now points from u down to v
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        edges = cut(small)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
