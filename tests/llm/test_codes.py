"""Vector codes against plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from ledgerloom.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def plainly(rows, rounds, entries, parts):
    """(vec_id, integers, label) rows -> (vec_id, code, error, label_error) and the codebooks, one number at a time."""
    width = len(rows[0][1]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    seeds = {}
    for i, x, _ in rows:
        seeds[i] = min(seeds.get(i, x), x)
    first = [seeds[i] for i in sorted(seeds, key=lambda i: (i is None, i or 0))[:entries]]
    books = [[list(cut(x, p)) for x in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, x, _ in rows:
                members.setdefault(near(cut(x, p), books[p])[1], []).append(cut(x, p))
            for j, own in members.items():
                books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, x, label in rows:
        found = [near(cut(x, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    text = ",".join(str(c) for book in books for e in book for c in e)
    return sorted(((i, c, e, sums[label]) for i, c, e, label in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def test_bounds_lose_no_nearest_entry():
    rng = np.random.default_rng(4)
    for scale, width in ((3, 16), (2000, 16), (1 << 27, 5), (40, 1), (900, 33)):
        book = rng.integers(-scale, scale, (64, width))
        book[10] = book[50]  # a tie
        book[0, 0] = scale
        x = np.concatenate([rng.integers(-scale, scale, (300, width)), book[[50, 3]], book[[7]] + 1, np.zeros((1, width), np.int64)])
        code, error, _ = codes.nearest(x, book, block=70)
        all_d = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
        assert (code == all_d.argmin(1)).all() and (error == all_d.min(1)).all()


def test_bounds_spare_distances():
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 400, (256, 16))
    x = (centres[rng.integers(0, 256, 5000)] + rng.normal(0, 60, (5000, 16))).astype(np.int64)
    _, _, computed = codes.nearest(x, centres.astype(np.int64))
    assert computed < 0.1 * 5000 * 256


@pytest.mark.parametrize("entries", [4, 256])
def test_codes_equal_plain_ones(spark, entries):
    rng = np.random.default_rng(1)
    rows = [(int(i), [round(float(v), 3) for v in rng.normal(0, 0.3, 8)], [None, 0, 1][i % 3], "clash") for i in rng.permutation(60)]
    rows += [rows[5], rows[5], (7, [0.5] * 8, 1, ""), (None, [0.25] * 8, 1, ""), (200, [0.1] * 7, 2, "")]
    odd = [(300, None, 1, ""), (301, [0.1] * 7 + [None], 1, ""), (302, [math.nan] * 8, 1, ""), (0, [math.inf] * 8, 1, ""), (1, [1.0] * 7 + [-math.inf], None, None)]
    got = codes.vector_codes(spark.createDataFrame(rows + odd, SCHEMA).repartition(5), entries=entries).collect()
    plain = [(i, tuple(math.floor(1024 * v) for v in x) + (0,) * (8 - len(x)), label) for i, x, label, _ in rows]
    want, digest = plainly(plain, 4, entries, 4)
    assert sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error")) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_of_odd_tables(spark):
    assert codes.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.vector_codes(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).count() == 0
    (lone,) = codes.vector_codes(spark.createDataFrame([(None, [1.0, 2.0, 3.0], None, "")], SCHEMA)).collect()
    assert (lone["code"], lone["error"], lone["label_error"]) == ("00000000", 0, 0)
    assert lone["codebooks_sha256"] == hashlib.sha256(b"1024,2048,3072,0").hexdigest()
    (none,) = codes.vector_codes(spark.createDataFrame([(3, [], 1, "")], SCHEMA)).collect()
    assert none["error"] == 0
    with pytest.raises(Exception, match="no exact distance"):
        codes.vector_codes(spark.createDataFrame([(1, [1e9] * 4, 1, "")], SCHEMA)).collect()
