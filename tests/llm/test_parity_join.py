"""The parity-sketch join against all pairs."""

import re

import numpy as np
import pytest

from ledgerloom.llm import parity_join as pj

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, component_id string, node string"


def sets(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def plainly(rows, percent=90):
    own = [sets(t) for _, t in rows]
    boss = {d: d for d, _ in rows if d is not None}

    def find(d):
        while boss[d] != d:
            d = boss[d]
        return d

    for i, (d, _) in enumerate(rows):
        for j, (e, _) in enumerate(rows[:i]):
            if d is not None and e is not None and own[i] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                x, y = sorted((find(d), find(e)))
                boss[y] = x
    out = []
    for (d, _), s in zip(rows, own):
        equal = [find(e) for (e, _), o in zip(rows, own) if e is not None and o == s and s]
        out.append((d, len(s), d if not s else find(d) if d is not None else min(equal, default=None)))
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in pj.similar_sets(df, **more).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    make = lambda n: [word() for _ in range(n)]
    texts = []
    # groups whose copies differ in so many words that links come and go
    for n, copies, edits in ((12, 12, 1), (40, 25, 1), (150, 30, 2), (150, 30, 3), (700, 20, 9)):
        base = make(n)
        for _ in range(copies):
            own = list(base)
            for at in rng.integers(0, n, rng.integers(0, edits + 1)):
                own[at] = word()
            texts.append(" ".join(own))
    # chains: each links the next, the ends are far apart
    own = make(300)
    for _ in range(15):
        own = own[3:] + make(3)
        texts.append(" ".join(own))
    # a passage that others have among their own words
    shared = make(60)
    texts += [" ".join(make(rng.integers(5, 60)) + shared) for _ in range(40)]
    texts += [texts[3]] * 3 + [texts[0].upper(), "A b", "a  B", "a", "A\n", "a b c", "a b c a b c", "a b c a b c a b c", "x " * 500, "x " * 501, "é É"]
    out = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) * 3 + 1, texts)]
    return out + [(5000, None), (5003, ""), (5004, " \n"), (None, texts[0]), (None, "alone at last"), (None, None), out[4], out[4]]


@pytest.mark.parametrize("more", [{}, {"most": 1, "block": 6}, {"percent": 75}])
def test_components_equal_those_of_all_pairs(spark, rows, more):
    assert got(spark, rows, **more) == plainly(rows, more.get("percent", 90))


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(9, a), (5, a), (5, b), (7, b), (8, c), (2, c)]
    assert got(spark, rows) == plainly(rows)
    assert {r[2] for r in got(spark, rows[:4])} == {5}


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == [(1, 0, 1)]


def test_sketches_differ_in_no_more_bits_than_sets_do():
    rng = np.random.default_rng(2)
    bands = pj.Bands(90)
    for n in (10, 33, 200, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[: n - n // 20], rng.integers(0, 1 << 63, n // 30, dtype=np.uint64)])
        h, off = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)])
        width = np.full(2, bands.words[bands.of(n)])
        words, _, at = pj.sketches(h, off, width)
        far = int(np.bitwise_count(words[at[0] : at[1]] ^ words[at[1] :]).sum())
        assert far <= len(set(a.tolist()) ^ set(b.tolist())) and far % 2 == (len(a) + len(b)) % 2


@pytest.mark.parametrize("percent", [60, 75, 90, 97])
def test_families_hold_every_pair_of_sizes_that_can_link(percent):
    bands = pj.Bands(percent)
    for n in [*range(1, 400), 4000, 99999, 1234567]:
        for m in {n, n * 100 // percent}:
            (f, g), (own, own_2), (_, below) = bands.widths(np.array([n, m]))
            d = (100 - percent) * (n + m) // (100 + percent)
            width = own_2 if g == f else below
            assert g <= f + 1 and width == own and (own > d or d == 0)
