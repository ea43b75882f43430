"""Phrase collocations against counts of tuples."""

import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, key long"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plainly(rows, least, top, percent=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for j in range(1, 6):
                f.update((lang, tuple(w[i : i + j])) for i in range(len(w) - j + 1))
    good = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = {}
    for (lang, p), a in good.items():
        for j in range(2, len(p)):
            for i in range(len(p) - j + 1):
                inside[lang, p[i : i + j]] = max(a, inside.get((lang, p[i : i + j]), 0))
    out = {}
    for (lang, p), a in good.items():
        if 100 * inside.get((lang, p), 0) >= percent * a:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:j]] * f[lang, p[j:]]), j, f[lang, p[:j]], f[lang, p[j:]]) for j in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, t, x, "clash", 7) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    vocabulary = ["The", "of", "a", "a", "a", "Straße", "日本", "x\x1fy", "naïve", "É", "é", "🙂", "q"]
    gaps = [" ", " ", " ", " ", "\t ", "  ", ", ", ".", "\n", "\r\n", " ? ", "\x0b"]
    make = lambda n: "".join(vocabulary[i] + gaps[rng.integers(0, len(gaps))] for i in rng.integers(0, len(vocabulary), n))
    out = [(make(n), ["en", "de", None, "und"][i % 4]) for i, n in enumerate(rng.integers(0, 200, 60))]
    out += [(None, "en"), ("", None), (" \n", "fr"), ("one", "fr"), ("to be or not to be, ever " * 9, "es"), (make(4000), "en")]
    return out + out[:3] + out[-2:-1] * 2


@pytest.mark.parametrize("more", [{"least": 4, "top": 2000}, {"least": 9, "top": 5, "size": 700}, {"least": 4, "top": 50, "percent": 60, "size": 3000}])
def test_equal_plain_counts(spark, rows, more, monkeypatch):
    monkeypatch.setattr(phrases, "SHARE", 20)
    want = plainly(rows, more["least"], more["top"], more.get("percent", 100))
    assert want and got(spark, rows, **more) == want


def test_counts_of_frequent_phrases_are_exact(spark, rows):
    df = spark.createDataFrame([(i, t, x, "", 7) for i, (t, x) in enumerate(rows)], SCHEMA)
    _, found = phrases.frequent_phrases(df, least=3, size=900)
    have = found.collect()
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(("und" if lang is None else lang, " ".join(w[i : i + j])) for j in range(1, 6) for i in range(len(w) - j + 1))
    assert {(r["lang"], r["phrase"]): r["a"] for r in have} == {p: a for p, a in f.items() if a >= 3}
    assert len(have) == len({r["key"] for r in have})


def test_products_beyond_64_bits_are_exact(spark):
    expression = "(1000 * cast(a as decimal(17, 0)) * cast(a as decimal(17, 0))) div (cast(b as decimal(17, 0)) * cast(b as decimal(17, 0)))"
    a, b = 10**15 + 37, 10**14 + 3
    (row,) = spark.sql(f"SELECT {expression} AS x FROM VALUES ({a}L, {b}L) AS t(a, b)").collect()
    assert row["x"] == 1000 * a * a // (b * b)


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, None), ("", "en")]) == []
    assert got(spark, [("a b " * 60, "en")] * 2, least=100) == plainly([("a b " * 60, "en")] * 2, 100, 2000)
