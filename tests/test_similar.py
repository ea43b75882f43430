"""Exact similarity joins and greedy heads against all pairs."""

import numpy as np
import pytest

from ledgerloom.functions.similarity import token_set, token_sort
from ledgerloom.operators import similar as S
from ledgerloom.operators import text_ops as T
from tests_greedy import greedily

STOP = ["MERCADO", "DO", "A", "CAFE", "SUPERMERCADO"]


@pytest.fixture(scope="module")
def names():
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("ABCDEILORST"), rng.integers(1, 9)))
    typo = lambda s: s[: (i := rng.integers(0, len(s)))] + ["", "X", s[i] + s[i]][rng.integers(0, 3)] + s[i + 1 :]
    out = [" ".join([*rng.choice(STOP, rng.integers(0, 3)), *(word() for _ in range(rng.integers(1, 4))), "Q"]) for _ in range(220)]
    out += [typo(typo(n)) if i % 2 else typo(n) for i, n in enumerate(out)]
    out += STOP + ["A A", "A B", "AB", "B", "É", "MERCADO  DO", "CAFE CAFE", "X" * 200, "X" * 180, "A " * 40]
    return sorted({" ".join(n.split()) for n in out} - {""})


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "s string")


@pytest.mark.parametrize("least", [70.0, 85.0])
def test_no_sorted_pair_is_missed(spark, names, least):
    left, right = names[::2], names[1::2]
    got = {(r["a"], r["b"]) for r in S.similar_by_order(frame(spark, left), frame(spark, right), least).collect()}
    assert got == {(a, b) for a in left for b in right if token_sort(a, b) >= least} and got


def test_no_set_pair_is_missed(spark, names):
    got = {(r["a"], r["b"]) for r in S.similar_by_set(frame(spark, names), 80.0).collect()}
    assert got == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if token_set(a, b) >= 80.0} and got


def test_a_frequent_token_makes_few_more_pairs(spark):
    rng = np.random.default_rng(3)
    base = [" ".join("".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 7)) for _ in range(2)) for _ in range(400)]
    size = lambda stop: S.gram_pairs(frame(spark, x := [f"SUPERMERCADO {n}" if i % stop == 0 else n for i, n in enumerate(base)]), frame(spark, x), 85.0).count()
    few, many = size(20), size(2)  # ten times as many names with the token
    assert many < 3 * few


def test_the_partner_behind_a_frequent_token_is_found(spark):
    canon = [(f"LOJA {i:05d}", None) for i in range(1500)] + [("LOJA PADARIA ESTRELA", None)]
    frame_of = lambda x, c: spark.createDataFrame(x, f"{c} string, tax_id string")
    (row,) = T.resolve_names(frame_of([("LOJA PADARIA ESTRELAS", None)], "name"), frame_of(canon, "canonical")).collect()
    assert (row["canonical"], row["kind"]) == ("LOJA PADARIA ESTRELA", "match")


def test_heads_equal_those_of_the_pass_in_order(spark):
    rng = np.random.default_rng(5)
    for n, m in ((60, 90), (80, 600), (40, 0)):
        edges = sorted({tuple(sorted(e)) for e in rng.integers(0, n, (m, 2)).tolist() if e[0] != e[1]})
        edges += [(i, i + 1) for i in range(n, n + 20)]  # a chain that waits all along
        nodes = list(range(n + 21))
        want = set()
        for i in nodes:
            if not any(b == i and a in want for a, b in edges):
                want.add(i)
        got = S.greedy_heads(spark.createDataFrame([(i,) for i in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"))
        assert sorted(r["node"] for r in got.collect()) == sorted(want)


def test_clusters_of_names_with_frequent_tokens(spark, names):
    order = np.random.default_rng(7).permutation(len(names)).tolist()
    items = spark.createDataFrame([(i, names[j]) for i, j in enumerate(order)], "id long, name string")
    norms = {r["id"]: r["n"] for r in items.select("id", T.normal_product(T.F.col("name")).alias("n")).collect() if r["n"]}
    first = {}
    for i in sorted(norms):
        first.setdefault(norms[i], i)
    want = greedily([(i, n) for n, i in first.items()], 95.0, 80.0)
    got = {r["id"]: (r["cluster"], r["score"], r["role"]) for r in T.cluster_products(items).collect()}
    assert got == {i: want[first[n]] for i, n in norms.items()}
