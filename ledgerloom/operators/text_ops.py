"""Token statistics, weighted neighbours, name resolution and searches over short texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import normal_product, normal_supplier
from ledgerloom.functions.similarity import token_set_ratio

from .graph import _stored
from .similar import greedy_heads, nearest_heads, similar_by_order, similar_by_set

TOKEN = r"([a-zA-ZÀ-ÿ0-9]{2,})"


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, c, len): how often each token occurs, and all tokens of the row."""
    listed = rows.select(key, F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)).alias("t"))
    exploded = listed.select(key, F.size("t").alias("len"), F.explode("t").alias("token"))
    return exploded.groupBy(key, "token").agg(F.count("*").alias("c"), F.first("len").alias("len"))


def idf(terms: DataFrame, n: int) -> DataFrame:
    """ln(N / (1 + df)) + 1 of each token."""
    return terms.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(float(n)) / (1 + F.col("df"))) + 1)


def weights(terms: DataFrame, idfs: DataFrame, key: str) -> DataFrame:
    """Unit-length tf-idf vectors in long form; tokens with idf <= 0 go."""
    w = terms.join(idfs.filter("idf > 0"), "token").select(key, "token", (F.col("c") / F.col("len") * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "token", (F.col("w") / F.col("norm")).alias("w"))


def top_cosines(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(q, id, cosine): the ``k`` rows of ``corpus`` (id, token, w) with the largest cosine to each of ``queries`` (q, token, w), ties to the least id.

    Only lists that can matter are joined. A token's list is ordered by weight: its largest weight bounds what the token
    adds to any score, and if its k-th weight is w, k rows score at least the query's weight times w. The best of those
    is a floor under a query's k-th score; tokens whose bounds together stay below it cannot bring a row in alone,
    so a query looks rows up by its other tokens, and those rows get exact scores. Common tokens weigh little and
    are what is left out.
    """
    w = F.col("w")
    ranked = corpus.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("w")))).filter(F.col("rank") <= k)
    heads = ranked.groupBy("token").agg(F.max("w").alias("most"), F.max(F.when(F.col("rank") == k, w)).alias("kth"))
    bounded = _stored(queries.join(heads, "token").select("q", "token", "w", (w * F.col("most")).alias("bound"), (w * F.coalesce("kth", F.lit(0.0))).alias("least")), "bounds")
    own = Window.partitionBy("q")
    below = F.sum("bound").over(own.orderBy("bound", "token"))
    needed = bounded.withColumns({"below": below, "floor": F.max("least").over(own)}).filter(F.col("below") >= F.col("floor") - 1e-7)
    pairs = needed.select("q", "token").join(corpus.select("id", "token"), "token").select("q", "id").distinct()
    mine, theirs = bounded.select("q", "token", F.col("w").alias("a")), corpus.select("id", "token", F.col("w").alias("b"))
    scores = pairs.join(mine, "q").join(theirs, ["id", "token"]).groupBy("q", "id").agg(F.sum(F.col("a") * F.col("b")).alias("cosine")).filter("cosine > 0")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("cosine", 9)), "id"))
    return scores.withColumn("rn", place).filter(F.col("rn") <= k).select("q", "id", "cosine")


def knn_vote(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Label of each query by its k nearest corpus rows (cosine > 0), votes weighted by cosine.

    ``queries`` has (q, text), ``corpus`` (id, text, label). Equal corpus texts of one label are one row
    before anything is joined, so copies do not multiply pairs.
    """
    packed = _stored(corpus.groupBy("text", "label").agg(F.min("id").alias("id")), "packed")
    ct = term_counts(packed, "id", "text")
    idfs = idf(ct, packed.count())
    cw = _stored(weights(ct, idfs, "id"), "weights")
    qw = weights(term_counts(queries, "q", "text"), idfs, "q")
    top = top_cosines(qw, cw, k)
    votes = top.join(packed.select("id", "label"), "id").groupBy("q", "label").agg(F.sum("cosine").alias("vote"))
    best = votes.groupBy("q").agg(F.sum("vote").alias("all"), F.min_by("label", F.struct((-F.round("vote", 9)).alias("v"), "label")).alias("label"), F.max("vote").alias("vote"))
    return best.select("q", "label", F.round(F.col("vote") / F.col("all"), 3).alias("confidence"))


def resolve_names(names: DataFrame, canon: DataFrame, least: float = 85.0) -> DataFrame:
    """Each distinct name with its canonical name: name, canonical, score, kind, source.

    ``names`` has (name, tax_id), ``canon`` (canonical, tax_id), tax ids may be null. A name whose normal form equals
    a canonical one's takes it unless their tax ids differ; else the most similar one by the sorted ratio counts:
    95 and more is a match, ``least`` and more a suggestion, less, or another tax id, a new name. No canonical name
    of ``least`` or more is missed; where there is none, the score is 0.
    """
    n = names.select("name", "tax_id", normal_supplier(F.col("name")).alias("norm")).groupBy("name", "norm").agg(F.min("tax_id").alias("tax_id"))
    c = canon.select("canonical", F.col("tax_id").alias("other_id"), normal_supplier(F.col("canonical")).alias("cnorm")).groupBy("canonical", "cnorm").agg(F.min("other_id").alias("other_id"))
    differ = F.coalesce(F.col("tax_id") != F.col("other_id"), F.lit(False))
    exact = n.join(c, n.norm == c.cnorm).filter(~differ).groupBy("name").agg(F.min("canonical").alias("canonical"))
    exact = exact.select("name", "canonical", F.lit(100.0).alias("score"), F.lit("match").alias("kind"), F.lit("equal").alias("source"))
    rest = n.join(exact.select("name"), "name", "left_anti")
    near = similar_by_order(rest.select(F.col("norm").alias("s")), c.select(F.col("cnorm").alias("s")), least)
    scored = near.join(c.select(F.col("cnorm").alias("b"), "canonical"), "b").withColumn("score", F.floor("score").cast("double"))
    best = scored.groupBy(F.col("a").alias("norm")).agg(F.min_by("canonical", F.struct((-F.col("score")).alias("s"), "canonical")).alias("canonical"), F.max("score").alias("score"))
    near = rest.join(best, "norm", "left").join(c.select("canonical", "other_id"), "canonical", "left")
    low = F.col("score").isNull()
    near = near.select(
        "name", F.when(low | differ, F.col("norm")).otherwise(F.col("canonical")).alias("canonical"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(low | differ, "new").when(F.col("score") >= 95, "match").otherwise("suggestion").alias("kind"),
        F.when(low, "new").when(differ, "other tax id").otherwise("similar").alias("source"),
    )
    return exact.unionByName(near)


def cluster_products(items: DataFrame, least: float = 95.0, proposal: float = 80.0, overrides: dict[str, str] | None = None) -> DataFrame:
    """Groups of similar product names: (id, name, cluster, score, role), role member, proposal or override.

    Names are compared in normal form, in the order of their least ids: each joins the most similar head (the set ratio,
    whole points; the earliest of equal ones) of ``least`` or more, is proposed to it from ``proposal`` on, or else
    is a head itself. ``overrides`` maps normal forms to canonical names and goes first: its names form the cluster of
    the canonical form (the least id among them). The heads are those of the pass in order, but found by rounds
    over all names at once.
    """
    named = items.withColumn("norm", normal_product(F.col("name"))).filter("norm <> ''")
    mapped = {k: v for k, v in (overrides or {}).items()}
    canon = F.create_map(*[F.lit(x) for kv in mapped.items() for x in kv])[F.col("norm")] if mapped else F.lit(None).cast("string")
    named = named.withColumn("canon", canon)
    done = named.filter("canon is not null")
    first = done.groupBy("canon").agg(F.min("id").alias("cluster"))
    done = done.join(first, "canon").select("id", "name", "cluster", F.lit(100.0).alias("score"), F.lit("override").alias("role"))
    named = named.filter("canon is null")
    nodes = named.groupBy("norm").agg(F.min("id").alias("node"))
    ids = lambda s, i: nodes.select(F.col("norm").alias(s), F.col("node").alias(i))
    pairs = similar_by_set(nodes.select(F.col("norm").alias("s")), proposal).join(ids("a", "i"), "a").join(ids("b", "j"), "b")
    pairs = _stored(pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.floor("score").cast("double").alias("score")), "similar")
    heads = greedy_heads(nodes, pairs)
    joined = nearest_heads(pairs, heads).select("node", F.col("head").alias("cluster"), "score", F.when(F.col("score") >= least, "member").otherwise("proposal").alias("role"))
    roles = joined.unionByName(heads.select("node", F.col("node").alias("cluster"), F.lit(100.0).alias("score"), F.lit("member").alias("role")))
    found = named.join(nodes, "norm").join(roles, "node").select("id", "name", "cluster", "score", "role")
    return found.unionByName(done)


def shared_clusters(clusters: DataFrame) -> DataFrame:
    """Members of clusters of two or more members."""
    members = clusters.filter("role <> 'proposal'")
    many = members.groupBy("cluster").agg(F.count("*").alias("n")).filter("n >= 2")
    return members.join(many.select("cluster"), "cluster", "left_semi")


def match_items(policies: DataFrame, items: DataFrame, days: int = 1, least: float = 82.0, margin: float = 5.0) -> DataFrame:
    """Policies (policy, seller, date, text) with the item (item, seller, date, text) they insure: policy, item, score.

    An item has the same seller and a date within ``days``; the best set ratio of at least ``least`` wins unless the
    next is within ``margin``. Joined on the seller and the day, so one seller's days spread over tasks.
    """
    shifted = policies.select("policy", "seller", F.upper(F.trim("text")).alias("a"), F.explode(F.expr(f"sequence(date_sub(date, {days}), date_add(date, {days}))")).alias("date"))
    pairs = shifted.join(items.select("item", "seller", "date", F.upper("text").alias("b")), ["seller", "date"])
    scored = pairs.select("policy", "item", token_set_ratio("a", "b").alias("score")).filter(F.col("score") >= least)
    w = Window.partitionBy("policy").orderBy(F.desc("score"), "item")
    ranked = scored.withColumns({"rn": F.row_number().over(w), "next": F.lead("score").over(w)}).filter("rn = 1")
    return ranked.filter(F.coalesce(F.col("score") - F.col("next") >= margin, F.lit(True))).select("policy", "item", F.round("score", 4).alias("score"))
