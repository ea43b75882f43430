"""Text operators without SQL against plain code."""

import datetime as dt
import math
import re
from collections import Counter, defaultdict

import numpy as np

from ledgerloom.functions import expressions as X
from ledgerloom.functions.similarity import ratio, token_set, token_sort
from ledgerloom.operators import text_ops as T
from ledgerloom.plans import text_queries
from tests_greedy import greedily

TOKEN = re.compile("[a-zA-ZÀ-ÿ0-9]{2,}")


def test_ratio_is_that_of_the_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc "), rng.integers(0, 12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert ratio(a, b) == (200.0 * best[-1][-1] / (len(a) + len(b)) if a or b else 100.0)


def test_neighbours_vote(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["pão", "leite", "gás", "luz", "água", "uber", "taxi", "x", "posto", "mercado"]
    make = lambda: " ".join(rng.choice(vocabulary, rng.integers(1, 6)))
    corpus = [(i, make(), "abc"[rng.integers(0, 3)]) for i in range(40)]
    corpus += [(100 + i, t, label) for i, (_, t, label) in enumerate(corpus[:10])] + [(200, "", "a"), (201, None, "b")]
    queries = [(i, make()) for i in range(15)] + [(99, ""), (98, "zzz")]
    got = {r["q"]: (r["label"], r["confidence"]) for r in T.knn_vote(spark.createDataFrame(queries, "q long, text string"), spark.createDataFrame(corpus, "id long, text string, label string"), 5).collect()}
    packed = {}
    for i, t, label in corpus:
        packed[(t, label)] = min(i, packed.get((t, label), i))
    bags = {i: Counter(TOKEN.findall((t or "").lower())) for (t, _), i in packed.items()}
    labels = {i: label for (_, label), i in packed.items()}
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log(len(packed) / (1 + n)) + 1 for w, n in df.items()}

    def vector(bag):
        v = {w: c / sum(bag.values()) * idf[w] for w, c in bag.items() if idf.get(w, 0) > 0}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    want = {}
    for q, t in queries:
        v = vector(Counter(TOKEN.findall(t.lower())))
        near = [(sum(x * u.get(w, 0) for w, x in v.items()), i) for i, u in ((i, vector(b)) for i, b in bags.items())]
        near = sorted((-round(c, 9), i, c) for c, i in near if c > 1e-12)[:5]
        votes = defaultdict(float)
        for _, i, c in near:
            votes[labels[i]] += c
        if votes:
            label = min(votes, key=lambda x: (-round(votes[x], 9), x))
            want[q] = (label, round(votes[label] / sum(votes.values()), 3))
    assert got.keys() == want.keys()
    assert all(got[q][0] == want[q][0] and abs(got[q][1] - want[q][1]) <= 0.0011 for q in want)


def test_top_cosines_equal_all_pairs_and_look_at_fewer(spark):
    rng = np.random.default_rng(12)
    # zipfian tokens: a few in nearly every row
    token = lambda: f"t{min(int(rng.zipf(1.3)), 3000)}"
    corpus = {i: Counter(token() for _ in range(rng.integers(1, 12))) for i in range(600)}
    df = Counter(t for b in corpus.values() for t in b)
    weigh = lambda bag: {t: c * (math.log(600 / (1 + df[t])) + 1) for t, c in bag.items() if df[t] and math.log(600 / (1 + df[t])) + 1 > 0}
    unit = lambda v: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()}
    vectors = {i: unit(weigh(b)) for i, b in corpus.items()}
    queries = {i: vectors[i] for i in range(0, 600, 3)}
    frame = lambda v, key: spark.createDataFrame([(i, t, x) for i, own in v.items() for t, x in own.items()], f"{key} long, token string, w double")
    for k in (1, 5, 700):
        got = {}
        for r in T.top_cosines(frame(queries, "q"), frame(vectors, "id"), k).collect():
            got.setdefault(r["q"], {})[r["id"]] = r["cosine"]
        for q, v in queries.items():
            all_ = sorted((-round(s, 9), i) for i, u in vectors.items() if (s := sum(x * u.get(t, 0) for t, x in v.items())) > 0)[:k]
            mine = sorted((-round(s, 9), i) for i, s in got.get(q, {}).items())
            assert [i for _, i in mine] == [i for _, i in all_] or np.allclose([s for s, _ in mine], [s for s, _ in all_], atol=2e-9)


def test_names_resolve_to_the_most_similar(spark):
    canon = [("Padaria Central LTDA", "1"), ("Mercado São Jorge", None), ("Posto Alfa", None), ("Posto Alfa Norte", "2")]
    names = [("PADARIA CENTRAL", None), ("mercado são jorje", None), ("posto alfa norte me", "9"), ("desconhecido", None), ("Posto Alfa", "3"), ("norte alfa posto", "2")]
    frame = lambda x, c: spark.createDataFrame(x, f"{c} string, tax_id string")
    got = {r["name"]: (r["canonical"], r["kind"], r["source"]) for r in T.resolve_names(frame(names, "name"), frame(canon, "canonical")).collect()}
    assert got == {
        "PADARIA CENTRAL": ("Padaria Central LTDA", "match", "equal"), "mercado são jorje": ("Mercado São Jorge", "suggestion", "similar"),
        "posto alfa norte me": ("POSTO ALFA NORTE", "new", "other tax id"), "desconhecido": ("DESCONHECIDO", "new", "new"), "Posto Alfa": ("Posto Alfa", "match", "equal"),
        "norte alfa posto": ("Posto Alfa Norte", "match", "similar"),
    }
    assert token_sort("b a c", "c b a") == 100.0 and 0 < token_sort("abc", "abd") < 100 and token_set("x y", "x z") == token_set("x z", "x y")


def test_resolution_equals_comparing_all_names(spark, sf):
    names, canon = text_queries.names_to_resolve(spark, sf)
    got = {r["name"]: (r["score"], r["kind"]) for r in T.resolve_names(names, canon).collect()}
    canons = {normal(r["canonical"]): r["tax_id"] for r in canon.collect()}
    assert got.keys() == {r["name"] for r in names.select("name").distinct().collect()}
    for name, (score, kind) in got.items():
        best = max(int(token_sort(normal(name), c)) for c in canons)
        assert score == best or (best < 85 and kind == "new"), (name, score, best)
        assert (kind == "new") or (kind == "match") == (score >= 95)


def normal(name):
    out = name.upper().strip()
    for suffix in X.SUFFIXES:
        out = out.removesuffix(suffix).strip()
    return " ".join(re.sub("[.,;:\\-()/]+", " ", out).split())


def test_clusters_equal_a_greedy_pass_over_all_names(spark, sf):
    items = text_queries.products(spark, sf)
    norms = {r["id"]: r["n"] for r in items.select("id", X.normal_product(T.F.col("name")).alias("n")).collect()}
    first = {}
    for i in sorted(norms):
        first.setdefault(norms[i], i)
    want = greedily([(i, n) for n, i in first.items()], 95.0, 80.0)
    got = T.cluster_products(items).collect()
    assert len(got) == len(norms)
    assert all((r["cluster"], r["score"], r["role"]) == want[first[norms[r["id"]]]] for r in got)
    many = T.shared_clusters(T.cluster_products(items)).groupBy("cluster").count().collect()
    assert many and all(r["count"] > 1 for r in many)


def test_overrides_go_first(spark):
    items = spark.createDataFrame([(3, "LEITE INTEGRAL 1 L"), (1, "BEBIDA LACTEA"), (2, "INTEGRAL LEITE"), (4, "")], "id long, name string")
    got = {r["id"]: (r["cluster"], r["role"]) for r in T.cluster_products(items, overrides={"BEBIDA LACTEA": "LEITE", "INTEGRAL LEITE": "LEITE"}).collect()}
    assert got == {1: (1, "override"), 2: (1, "override"), 3: (3, "member")}


def test_items_of_policies_equal_brute_force(spark, sf):
    policies, items = text_queries.policies_and_items(spark, sf)
    some = policies.filter("policy like '%1'")  # fewer, as plain code compares all
    got = {r["policy"]: r["item"] for r in T.match_items(some, items).collect()}
    by_day = defaultdict(list)
    for r in items.collect():
        by_day[(r["seller"], r["date"])].append((r["item"], r["text"].upper()))
    want = {}
    for r in some.collect():
        near = [(token_set(r["text"].upper().strip(), t), i) for n in (-1, 0, 1) for i, t in by_day[(r["seller"], r["date"] + dt.timedelta(n))]]
        near = sorted((-s, i) for s, i in near if s >= 82)
        if near and (len(near) < 2 or near[1][0] - near[0][0] >= 5):
            want[r["policy"]] = near[0][1]
    assert got == want and want
