"""Connected components of an edge list: local forests, then alternating large-star and small-star rounds.

Every round first reduces what each task holds, ``EDGES`` edges or so, to one edge from each node to the least node
that the task's edges reach; up to that many edges this is all. What is left of more goes through two
aggregations and joins on keys; hubs are pre-aggregated by the minimum and their joins are ordinary
sort-merge joins, which Spark can split. Each round is written to the shared folder, so lineage stays short
and a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

EDGES = 1 << 20


def spanned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the least one of its component, and that one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while (label[x] != label[y]).any():
        least = np.minimum(label[x], label[y])
        for end in (x, y):
            np.minimum.at(label, label[end], least)
        while (label != label[label]).any():
            label = label[label]
    some = np.flatnonzero(label != np.arange(len(ids)))
    return ids[some], ids[label[some]]


def _forests(edges: DataFrame, at_once: int) -> DataFrame:
    """Edges (a, b), a > b, that connect what ``edges`` do: of every so many edges of a task a forest of stars."""

    def run(batches):
        held, n = [], 0

        def forest():
            a, b = spanned(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= 2 * at_once:
                yield forest()
                held, n = [], 0
        if n:
            yield forest()

    return edges.mapInArrow(run, "a bigint, b bigint")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b) with a > b."""
    ahead = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        ahead = ahead.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = ahead.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = ahead.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, at_once: int = EDGES) -> DataFrame:
    """(a, b) edges of bigint nodes -> (node, component), the least node of each component.

    Nodes without edges have no row. Loops, repeated and null edges are ignored.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    )
    edges, state = stored(edges.distinct(), "components"), None
    while True:
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(b as decimal(38, 0)))")).first()
        if now == state or now[0] == 0:
            break
        state, tasks = now, -(-now[0] // at_once)
        edges = stored(_forests(edges.coalesce(tasks), at_once), "components")
        if tasks == 1:
            break
        edges = stored(_star(_star(edges, True), False), "components")
    # now every edge is (node, least node of its component)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
