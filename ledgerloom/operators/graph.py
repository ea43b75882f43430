"""Property graph as nodes (id, kind, name) and edges (src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.sinks import shared_path


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def most_linked(edges: DataFrame, n: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(n)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later rounds do not compute earlier ones anew."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def khop(edges: DataFrame, start: list[str], hops: int) -> DataFrame:
    """Nodes within ``hops`` undirected steps of ``start``, with their distance.

    Each hop keeps the edges that the frontier has, from either end; these are semi joins, which Spark moves below a
    ``distinct`` of the edges, so no hop shuffles all of them. The frontier is stored after each hop.
    """
    reached = edges.sparkSession.createDataFrame([(s, 0) for s in start], "id string, distance int")
    frontier = reached
    for hop in range(1, hops + 1):
        ahead = edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        back = edges.join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
        step = ahead.unionByName(back).distinct().join(reached.select("id"), "id", "left_anti")
        frontier = _stored(step.withColumn("distance", F.lit(hop)), "frontier")
        reached = reached.unionByName(frontier)
    return reached


def connected(pairs: DataFrame) -> DataFrame:
    """(node, component) of the nodes of pairs (a, b): the least node each can reach.

    Every round each node takes the least label of itself, its neighbours and its label's label; rounds are stored,
    and they end when no label changes.
    """
    both = _stored(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = _stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        step = step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("root", "component")).alias("component"), "was")
        step = _stored(step, "labels")
        if not step.filter("component <> was").head(1):
            return step.select("node", "component")
        labels = step.select("node", "component")


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (kind, name): aliases united, metadata of the new side wins."""
    j = old.alias("o").join(new.alias("n"), ["kind", "name"], "full")
    none = F.array().cast("array<string>")
    aliases = F.array_sort(F.array_union(F.coalesce("o.aliases", none), F.coalesce("n.aliases", none)))
    return j.select("kind", "name", aliases.alias("aliases"), F.coalesce("n.meta", "o.meta").alias("meta"))


def insert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of ``new`` that ``old`` lacks are added; those it has stay as they are."""
    key = ["src", "dst", "kind"]
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges).select("id"), "id", "left_anti")


def incoming(edges: DataFrame, kind: str, least: int) -> DataFrame:
    return edges.filter(F.col("kind") == kind).groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def two_hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct ends of a path of two kinds."""
    a, b = edges.filter(F.col("kind") == first), edges.filter(F.col("kind") == second)
    return a.select("src", F.col("dst").alias("mid")).join(b.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()


def repoint(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges after nodes were merged (loser, winner): ends follow the winner, edges that become equal are one, loops go."""
    out = edges
    for end in ("src", "dst"):
        m = merged.select(F.col("loser").alias(end), F.col("winner").alias(f"_{end}"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return out.filter("src <> dst").dropDuplicates(["src", "dst", "kind"])


def ends_of(edges: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Out-edges with what they lead to: src, kind, dst, name."""
    e = edges if kind is None else edges.filter(F.col("kind") == kind)
    return e.join(nodes.select(F.col("id").alias("dst"), "name"), "dst").select("src", "kind", "dst", "name")


def visible(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The most linked nodes (by degree, then id) and the edges between them."""
    nodes = most_linked(edges, limit)
    ids = F.broadcast(nodes.select("id"))  # ``limit`` rows
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, kept


def dimension_nodes(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(kind, name): one node for each value of the columns, in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in columns.items()]))
    return rows.select(pairs.alias("p")).select("p.kind", "p.name").filter("name is not null").distinct()


def dimension_edges(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(src, kind, dst): an edge from each row to its value of every column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("dst")) for k, c in columns.items()]))
    return rows.select(F.col(key).alias("src"), pairs.alias("p")).select("src", "p.kind", "p.dst").filter("dst is not null")
