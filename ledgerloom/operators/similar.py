"""Exact similarity joins of names, and greedy heads, as rounds of DataFrame operations.

Ratios are those of ``functions.similarity``: 200 * LCS / (length + length), over sorted tokens or over token
sets. No pair that reaches a threshold is missed:

* Grams. A token gives the two-letter runs of itself between blanks, so a name's grams do not depend on the
  order of its tokens. A letter taken out breaks two grams, one put in breaks one, so names whose ratio reaches
  the threshold share a known number of grams. Ordered by how rare they are, the first ones of both names then
  share one (prefix filter): only those are joined, and frequent tokens are last.
* Covers. A set ratio also compares the common tokens alone with either name. It reaches the threshold only if the
  common tokens make up most of that name, so some of the name's rarest tokens are among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import token_set_ratio, token_sort_ratio

from .graph import _stored


def _tokens(s: str | Column, distinct: bool) -> Column:
    parts = F.filter(F.split(s, r"\s+"), lambda t: t != "")
    return F.array_distinct(parts) if distinct else parts


def name_grams(names: DataFrame, distinct: bool) -> DataFrame:
    """(s, length, gram, nth): grams of each name, repeated ones numbered; length as joined by single blanks."""
    listed = names.select("s", _tokens(F.col("s"), distinct).alias("t")).filter(F.size("t") > 0)
    length = F.aggregate("t", F.lit(-1), lambda n, t: n + F.length(t) + 1)
    padded = listed.select("s", length.alias("length"), F.explode(F.transform("t", lambda t: F.concat(F.lit(" "), t, F.lit(" ")))).alias("t"))
    grams = padded.select("s", "length", F.explode(F.expr("transform(sequence(1, length(t) - 1), i -> substring(t, i, 2))")).alias("gram"))
    counted = grams.groupBy("s", "length", "gram").agg(F.count("*").cast("int").alias("n"))
    return counted.select("s", "length", "gram", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))


def _needed(length: str, least: float) -> Column:
    """Grams that a name of this length shares at least with any name whose ratio is ``least`` or more."""

    def shared(other: Column) -> Column:
        apart = F.floor((F.lit(100.0 - least) * (F.col(length) + other)) / 100 + 1e-9)
        return F.col(length) + 1 - F.ceil((3 * apart + F.col(length) - other) / 2)

    shortest, longest = F.ceil(F.col(length) * (least / (200 - least)) - 1e-9), F.floor(F.col(length) * ((200 - least) / least) + 1e-9)
    # the number is linear in the other length but for rounding, so its least value is at an end
    return F.greatest(F.lit(1), F.least(shared(shortest), shared(longest)) - 1)


def gram_pairs(left: DataFrame, right: DataFrame, least: float, distinct: bool = False) -> DataFrame:
    """(a, b): pairs of names of ``left`` and ``right`` (each: s) that hold all whose ratio is ``least`` or more."""
    if least <= 200 / 3:
        raise ValueError("a threshold above 66.7: below it names need not share grams")
    sides = [name_grams(df.select("s").distinct(), distinct) for df in (left, right)]
    often = sides[0].select("gram", "nth").unionByName(sides[1].select("gram", "nth")).groupBy("gram", "nth").agg(F.count("*").alias("often"))
    often = _stored(often, "grams")
    first = []
    for side in sides:
        ranked = side.join(often, ["gram", "nth"]).withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy("often", "gram", "nth")))
        first.append(ranked.filter(F.col("rank") <= F.col("length") + 2 - _needed("length", least)).select("s", "length", "gram", "nth"))
    a, b = (side.select(F.col("s").alias(n), F.col("length").alias(f"length_{n}"), "gram", "nth") for side, n in zip(first, "ab"))
    close = F.least("length_a", "length_b") * (200 - least) >= F.greatest("length_a", "length_b") * least - 1e-6
    return a.join(b, ["gram", "nth"]).filter(close).select("a", "b").distinct()


def cover_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs that hold all in which the common tokens alone reach ``least`` against the name of ``left``."""
    token = lambda df: df.select("s").distinct().select("s", F.explode(_tokens(F.col("s"), True)).alias("token"))
    mine, others = token(left), token(right)
    often = mine.select("token").unionByName(others.select("token")).groupBy("token").agg(F.count("*").alias("often"))
    own = Window.partitionBy("s")
    weight = F.length("token") + 1
    before = F.sum(weight).over(own.orderBy("often", "token").rowsBetween(Window.unboundedPreceding, -1))
    share = (200 - 2 * least) / (200 - least)  # what the other tokens may weigh at most
    rare = mine.join(often, "token").select("s", "token", F.coalesce(before, F.lit(0)).alias("before"), F.sum(weight).over(own).alias("all"))
    rare = rare.filter(F.col("before") <= share * F.col("all"))
    return rare.select(F.col("s").alias("a"), "token").join(others.select(F.col("s").alias("b"), "token"), "token").select("a", "b").distinct()


def similar_by_order(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score): all pairs of names whose sorted ratio is ``least`` or more."""
    scored = gram_pairs(left, right, least).withColumn("score", token_sort_ratio("a", "b"))
    return scored.filter(F.col("score") >= least)


def similar_by_set(names: DataFrame, least: float) -> DataFrame:
    """(a, b, score), a < b: all pairs of names whose set ratio is ``least`` or more."""
    covers = cover_pairs(names, names, least)
    pairs = gram_pairs(names, names, least, distinct=True).unionByName(covers)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    return pairs.withColumn("score", token_set_ratio("a", "b")).filter(F.col("score") >= least)


def greedy_heads(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the nodes that a pass in ascending order takes, one after the other, if no head is their neighbour yet.

    ``edges`` has (a, b), a < b. Each round takes every undecided node without an undecided neighbour before it and
    drops the later neighbours of those; a component of any size spreads over all tasks. As many rounds as the longest
    chain of decisions that wait for each other, some log n where ids do not follow the names.
    """
    waits = _stored(edges.select("a", "b").filter("a < b").distinct(), "edges")
    found = last = _stored(nodes.select("node").distinct().join(waits.select(F.col("b").alias("node")), "node", "left_anti"), "heads")
    while last.head(1):
        gone = _stored(waits.join(last.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct(), "gone")
        rest = waits.join(gone.select(F.col("node").alias("b")), "b", "left_anti")
        still = _stored(rest.join(gone.select(F.col("node").alias("a")), "a", "left_anti").select("a", "b"), "edges")
        # those that waited for nodes that are gone now, and for no others
        last = _stored(rest.select(F.col("b").alias("node")).distinct().join(still.select(F.col("b").alias("node")), "node", "left_anti"), "heads")
        found, waits = found.unionByName(last), still
    return found


def nearest_heads(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, head, score): for each later end of edges (a, b, score) to heads the nearest one, the least of equals."""
    near = edges.join(heads.select(F.col("node").alias("a")), "a").join(heads.select(F.col("node").alias("b")), "b", "left_anti")
    best = F.min_by(F.struct("a", "score"), F.struct((-F.col("score")).alias("s"), "a"))
    return near.groupBy(F.col("b").alias("node")).agg(best.alias("x")).select("node", F.col("x.a").alias("head"), F.col("x.score").alias("score"))
