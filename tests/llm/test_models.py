"""The quality models against plain sums: scores, forward pass, gradient, calibration and the bounded sample."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import quality_cnn as cnn
from ledgerloom.llm import quality_rules as rules
from ledgerloom.llm import textkernel as k

TEXTS = ["", "a", "the cat sat on the mat " * 30, "Straße 日本 🙂 naïve " * 20, "abcabcabc" * 50, "x" * 127, "x" * 128, "y" * 129, "one two three\nfour", "z " * 700]


def small_net(seed=3, kind=np.float64):
    rng = np.random.default_rng(seed)
    net = {
        "embed": rng.normal(0, 0.5, (256, cnn.CHANNELS)), "filters": rng.normal(0, 0.3, (cnn.STEP * cnn.CHANNELS, cnn.GROUPS * cnn.FILTERS)), "shift": rng.normal(0, 0.1, cnn.FILTERS),
        "v_mean": rng.normal(0, 0.3, cnn.FILTERS), "v_max": rng.normal(0, 0.2, cnn.FILTERS), "bias": np.array(0.1), "a": 1.3, "b": -0.2,
    }
    net["embed"][0] = 0
    return {n: np.asarray(v, kind) if isinstance(v, np.ndarray) else v for n, v in net.items()}


def plain_logit(text, net):
    """Byte by byte, filter by filter."""
    data = text.encode()
    blocks = -(-(len(data) + cnn.PAD) // cnn.BLOCK_BYTES)
    data = data + bytes(blocks * cnn.BLOCK_BYTES - len(data))
    rows = []
    for i, c in enumerate(data):
        row = net["embed"][c].copy()
        row[-1] = float(c != 0 and i + 3 < len(data) and any(i >= lag and data[i : i + 4] == data[i - lag : i - lag + 4] for lag in cnn.LAGS))
        rows.append(row)
    span = cnn.STEP * cnn.GROUPS
    found = []
    for at in range(0, len(data), cnn.STEP):
        value = np.zeros(cnn.FILTERS)
        for j in range(span):
            if at + j < len(data):
                g, s = divmod(j, cnn.STEP)
                value += rows[at + j] @ net["filters"][s * cnn.CHANNELS : (s + 1) * cnn.CHANNELS, g * cnn.FILTERS : (g + 1) * cnn.FILTERS]
        found.append(value)
    top = [np.maximum(np.max(found[b * cnn.BLOCK : (b + 1) * cnn.BLOCK], axis=0) + net["shift"], 0) for b in range(blocks)]
    chunks = [np.maximum(top[b], top[b + 1]) for b in range(blocks - 1)] or [top[0]]
    return float(np.mean(chunks, axis=0) @ net["v_mean"] + np.max(chunks, axis=0) @ net["v_max"] + net["bias"])


def bytes_of(texts):
    return k.utf8(pa.array(texts))


def test_the_net_equals_plain_sums():
    net = small_net()
    got = cnn.logits(*bytes_of(TEXTS), net)
    assert np.allclose(got, [plain_logit(t, net) for t in TEXTS], atol=1e-9)


def test_a_long_text_is_read_by_pieces(monkeypatch):
    net, text = small_net(), " ".join(f"w{i * i % 977} {'ab' * (i % 7)}" for i in range(900))
    rows = k.utf8(pa.array([text]))
    laid = cnn._laid_out(*rows)
    z, kept = cnn._forward(net, *laid)
    whole = cnn._backward(net, laid[0], laid[2], kept, np.array([0.7]))
    monkeypatch.setattr(cnn, "BATCH_BYTES", 1000)
    for piece in (1, 2, 7, len(kept[2]) - 1, 10_000):
        monkeypatch.setattr(cnn, "PIECE", piece)
        assert np.allclose(cnn.logits(*rows, net), z, atol=1e-9)
        parts = cnn._gradient(net, *rows, lambda z, i, j: np.array([0.7]), 1000)
        assert all(np.allclose(parts[n], whole[n], atol=1e-9) for n in whole)


def test_memory_does_not_grow_with_a_text():
    net, size = small_net(kind=np.float32), 6_000_000
    rows = k.utf8(pa.array([("one two three\nfour, " * (size // 20))[:size]]))
    y, share = np.array([0, 1] * 5), np.ones(10)
    texts = k.utf8(pa.array([f"{'good' if i % 2 else 'bad'} text {i} " * (60_000 if i == 3 else 20) for i in range(10)]))
    for run in (lambda: cnn.score(*rows, net), lambda: cnn.fit(*texts, y, share)):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 150e6  # all filters of the whole text at once: 900 MB


def test_the_gradient_equals_differences():
    net, texts = small_net(5), TEXTS[1:5] + [TEXTS[8]]
    laid = cnn._laid_out(*bytes_of(texts))
    weights = np.random.default_rng(1).normal(0, 1, len(texts))
    value = lambda n: float(cnn._forward(n, *laid)[0] @ weights)
    _, kept = cnn._forward(net, *laid)
    grad = cnn._backward(net, laid[0], laid[2], kept, weights)
    rng = np.random.default_rng(2)
    for name in ("v_mean", "v_max", "bias", "shift", "filters", "embed"):
        size, close = net[name].size, 0
        for at in rng.choice(size, min(size, 12), replace=False):
            if name == "embed" and (at // cnn.CHANNELS == 0 or at % cnn.CHANNELS == cnn.CHANNELS - 1):
                close += 1  # padding and the given channel are not learned
                continue
            moved = [{**net, name: net[name].copy()} for _ in range(2)]
            for m, e in zip(moved, (1e-6, -1e-6)):
                m[name].reshape(-1)[at] += e
            close += abs((value(moved[0]) - value(moved[1])) / 2e-6 - np.asarray(grad[name]).reshape(-1)[at]) < 1e-4
        assert close >= min(size, 12) - 1, name  # a maximum may change hands within the step


def test_equal_texts_score_alike_whatever_stands_beside_them():
    net = small_net(7, np.float32)
    alone = np.array([cnn.score(*bytes_of([t]), net)[0] for t in TEXTS])
    for seed in range(4):
        order = np.random.default_rng(seed).integers(0, len(TEXTS), 300)
        assert (cnn.score(*bytes_of([TEXTS[i] for i in order]), net) == alone[order]).all()


def test_rule_scores_equal_plain_sums():
    rng = np.random.default_rng(9)
    model = {"weights": [rng.normal(0, 1, 1 << rules.BITS).astype(np.float32) for _ in range(3)], "bias": 0.3, "a": 1.7, "b": -0.4}
    got = rules.score(*bytes_of(TEXTS), model)
    for i, t in enumerate(TEXTS):
        b, o = bytes_of([t])
        starts, ends, _ = k.words(b, o)
        h = k.word_hashes(b, starts, ends)
        one = [int(x) >> (64 - rules.BITS) for x in h]
        two = [int(x) >> (64 - rules.BITS) for x in k.window_hashes(h, 2)]
        points = [sum(int(rules._PLACE[j]) * c for j, c in enumerate(ch.encode())) % 2**32 for ch in t]
        four = [sum(int(rules._GRAM[j]) * points[p + j] for j in range(4)) % 2**32 >> (32 - rules.BITS) for p in range(len(points) - 3)]
        z = model["bias"] + sum(float(np.mean([w[x] for x in own])) for own, w in zip((one, two, four), model["weights"]) if own)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model["a"] * z + model["b"]))), abs=1e-6), t[:20]


def test_calibration_is_where_the_slope_is_none():
    rng = np.random.default_rng(4)
    z = rng.normal(0, 2, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.8 * z - 0.5)))).astype(np.int64)
    a, b = rules.platt(z, y, np.ones(400))
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    gap = 1 / (1 + np.exp(-(a * z + b))) - target
    assert abs(gap.sum()) < 1e-3 and abs((gap * z).sum()) < 1e-3 and abs(a - 0.8) < 0.3


def test_the_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "w" * 1000) for i in range(40)] + [(i, None) for i in range(40, 44)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(44)], "doc_id long, quality int, toxic int")
    assert rules.labelled_sample(docs, labels, 100).count() == 44
    few = rules.labelled_sample(docs, labels, 100, 10_500).collect()
    assert sum(len(r["text"] or "") for r in few) == 10_000 and {r["y"] for r in few} == {0, 1}
    assert rules.labelled_sample(docs, labels, 100, 0).filter("text is not null").count() == 0
