"""Operator 4: quality classifier - a byte-level convolutional network in numpy.

A text's UTF-8 bytes get an embedding (7 learned channels; the eighth is given, not learned: it says whether
the four bytes here also stand 2 to 32 bytes before). Filters of 16 bytes are applied at every fourth byte of the
whole text and max-pooled over chunks of 256 bytes that overlap by half; the chunks' mean and
maximum of each filter are combined into one logit and, after Platt scaling on rows left out
of the fit, one probability.

Embedding, filters and weights are fitted with Adam on a bounded sample: at most ``SAMPLE`` labelled
rows of each class and ``quality_rules.SAMPLE_BYTES`` of text, in one task. Equal texts score alike, to the last digit,
whatever texts stand beside them. A long text is read whole, ``PIECE`` blocks at a time, in scoring and in the fit, so
memory does not grow with its length. Rows whose crc32 of the id is 2 modulo 4 are never among them.

Defined cases: null and empty texts are one chunk of padding and get a score too; repeated rows
are scored one by one; without labels of both classes the score is 0.5 for every text; a null id
counts as not held out and is not learned from; other columns are carried or ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as k
from .common import table
from .quality_rules import keep_where, labelled_sample, platt, train

CHANNELS, FILTERS, STEP, GROUPS = 8, 24, 4, 4  # a filter spans STEP * GROUPS bytes
BLOCK = 32  # positions in half a chunk
BLOCK_BYTES = BLOCK * STEP
LAGS = range(2, 33)
#: Least padding behind a text, so that neither filters nor the match channel of a text reach another.
PAD = max(STEP * GROUPS, max(LAGS) + 4)
#: Labelled rows of each class that a fit may read, and passes over them.
SAMPLE, EPOCHS = 800, 14
THRESHOLD = 0.7
BATCH_BYTES, FIT_BYTES = 1 << 18, 1 << 19
#: Blocks of a long text at once.
PIECE = BATCH_BYTES // BLOCK_BYTES


def _matches(out: np.ndarray) -> np.ndarray:
    """The match channel of laid out bytes."""
    match = np.zeros(len(out), bool)
    if len(out) > 64:
        four = np.ndarray((len(out) - 3,), "<u4", out, strides=(1,))
        for lag in LAGS:
            match[lag : len(four)] |= four[lag:] == four[:-lag]
        match &= out != 0
    return match


def _laid_out(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded to whole blocks; the match channel; block offsets."""
    size = np.diff(off)
    blocks = -(-(size + PAD) // BLOCK_BYTES)
    boff = np.concatenate(([0], np.cumsum(blocks)))
    out = np.zeros(int(boff[-1]) * BLOCK_BYTES, np.uint8)
    out[np.repeat(boff[:-1] * BLOCK_BYTES - off[:-1], size) + np.arange(len(buf))] = buf
    return out, _matches(out), boff


def _filtered(net: dict, out: np.ndarray, match: np.ndarray, boff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of STEP bytes, the filters at each of them, and each block's tops."""
    x = net["embed"][out]
    x[:, CHANNELS - 1] = match
    x = x.reshape(-1, STEP * CHANNELS)
    # block by block, all of one shape, so that a text's sums do not depend on the texts beside it
    wide = np.matmul(x.reshape(-1, BLOCK, STEP * CHANNELS), net["filters"]).reshape(len(x), -1)  # (positions, GROUPS * FILTERS)
    y = wide[:, :FILTERS].copy()
    ends = boff[1:-1, None] * BLOCK
    for g in range(1, GROUPS):
        wide[(ends + np.arange(g)).ravel(), g * FILTERS : (g + 1) * FILTERS] = 0  # only the text before reads these
        y[:-g] += wide[g:, g * FILTERS : (g + 1) * FILTERS]
    y = y.reshape(-1, BLOCK, FILTERS)
    return x, y, np.maximum(y.max(1) + net["shift"], 0)


def _forward(net: dict, out: np.ndarray, match: np.ndarray, boff: np.ndarray):
    x, y, top = _filtered(net, out, match, boff)
    # chunk j joins blocks j and j + 1; a text's last block alone is a chunk only if it is the first
    pair = top.copy()
    pair[:-1] = np.maximum(top[:-1], top[1:])
    last = boff[1:] - 1
    single = np.diff(boff) == 1
    n = np.maximum(np.diff(boff) - 1, 1)
    pair[last[~single]] = 0
    pair[last[single]] = top[last[single]]
    mean = np.add.reduceat(pair, boff[:-1], axis=0) / n[:, None]
    most = np.maximum.reduceat(pair, boff[:-1], axis=0)
    z = (mean * net["v_mean"]).sum(1) + (most * net["v_max"]).sum(1) + net["bias"]
    return z, (x, y, top, pair, mean, most, n)


def _by_piece(net: dict, buf: np.ndarray):
    """Of one long text, PIECE chunks at a time: bytes, rows, filters and tops of their blocks, and the chunks.

    Bytes and rows have one block more where there is one, as the filters at a block's last rows read into the next.
    """
    blocks = -(-(len(buf) + PAD) // BLOCK_BYTES)
    for first in range(0, blocks - 1, PIECE):
        n = min(PIECE, blocks - 1 - first) + 1  # blocks of the piece; its last one begins the next piece
        more = min(n + 1, blocks - first)
        back = min(first * BLOCK_BYTES, max(LAGS))
        low, high = first * BLOCK_BYTES - back, (first + more) * BLOCK_BYTES
        seen = buf[low : high + 3]
        out = np.zeros(high + 3 - low, np.uint8)
        out[: len(seen)] = seen
        match = _matches(out)[back:-3]
        out = out[back:-3]
        x, y, top = _filtered(net, out, match, np.array([0, more]))
        top = top[:n]
        yield out, x, y[:n], top, np.maximum(top[:-1], top[1:])


def _forward_long(net: dict, buf: np.ndarray):
    """Logit of one long text; mean and maximum of its chunks, how many have that maximum, and the number of chunks."""
    total, most, ties, n = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.int64), 0
    for *_, pair in _by_piece(net, buf):
        here = pair.max(0)
        ties = np.where(here >= most, (pair == here).sum(0), 0) + np.where(here <= most, ties, 0)
        most = np.maximum(most, here)
        total += pair.sum(0, dtype=np.float64)
        n += len(pair)
    mean = total / n
    return (mean * net["v_mean"]).sum() + (most * net["v_max"]).sum() + net["bias"], (mean, most, ties, n)


def logits(buf: np.ndarray, off: np.ndarray, net: dict) -> np.ndarray:
    parts = [
        _forward(net, *_laid_out(b, o))[0] if len(b) <= BATCH_BYTES else np.array([_forward_long(net, b)[0]])
        for _, _, b, o in k.chunks(buf, off, BATCH_BYTES)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(buf: np.ndarray, off: np.ndarray, net: dict) -> np.ndarray:
    z = logits(buf, off, net).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(net["a"] * z + net["b"], -30, 30)))


def _backward(net: dict, out, boff, kept, dz) -> dict:
    x, y, top, pair, mean, most, n = kept
    doc = np.repeat(np.arange(len(n)), np.diff(boff))
    grad = {"v_mean": mean.T @ dz, "v_max": most.T @ dz, "bias": dz.sum()}
    dpair = (dz / n)[doc, None] * net["v_mean"]
    is_top = (pair == most[doc]) & (pair > 0)
    dpair = dpair + np.where(is_top, (dz[doc, None] * net["v_max"]) / np.maximum(np.add.reduceat(is_top, boff[:-1], axis=0)[doc], 1), 0)
    return grad | _below(net, out, boff, np.repeat(boff[1:] * BLOCK, np.diff(boff)), x, y, top, dpair)


def _backward_long(net: dict, buf: np.ndarray, kept, dz) -> dict:
    mean, most, ties, n = kept
    grad = {"v_mean": (mean * dz).astype(np.float32), "v_max": most * dz, "bias": dz}
    for out, x, y, top, pair in _by_piece(net, buf):
        dpair = dz / n * net["v_mean"] + np.where((pair == most) & (pair > 0), dz * net["v_max"] / np.maximum(ties, 1), 0)
        dpair = np.concatenate([dpair, np.zeros((1, FILTERS))])
        grad = _added(grad, _below(net, out, np.array([0, len(top)]), np.full(len(top), len(x)), x, y, top, dpair))
    return grad


def _added(a: dict, b: dict) -> dict:
    return a | {n: a[n] + v if n in a else v for n, v in b.items()}


def _gradient(net: dict, buf: np.ndarray, off: np.ndarray, slope, most_bytes: int = FIT_BYTES) -> dict:
    """Sum of the texts' gradients, ``most_bytes`` at a time; ``slope(z, i, j)``: that of the logits ``z`` of texts i to j."""
    grad: dict = {}
    for i, j, b, o in k.chunks(buf, off, most_bytes):
        if len(b) > most_bytes:
            z, kept = _forward_long(net, b)
            own = _backward_long(net, b, kept, slope(np.array([z]), i, j)[0])
        else:
            laid = _laid_out(b, o)
            z, kept = _forward(net, *laid)
            own = _backward(net, laid[0], laid[2], kept, slope(z, i, j))
        grad = _added(grad, own)
    return grad


def _below(net: dict, out, boff, end, x, y, top, dpair) -> dict:
    """Gradients of what lies below the chunks; ``end``: for each block the first row its filters can't read."""
    grad = {}
    last = np.zeros(len(top), bool)
    last[boff[1:] - 1] = True
    single = np.repeat(np.diff(boff) == 1, np.diff(boff))
    dpair[last & ~single] = 0
    own = np.ones_like(top, bool)
    own[:-1] = (top[:-1] >= top[1:]) | (last & single)[:-1, None]
    dtop = np.where(own, dpair, 0)
    dtop[1:] += np.where(own, 0, dpair)[:-1]
    dtop *= top > 0
    grad["shift"] = dtop.sum(0)
    at = y.argmax(1) + (np.arange(len(y)) * BLOCK)[:, None]  # (blocks, FILTERS)
    filters, embed = np.zeros_like(net["filters"]), np.zeros((256, CHANNELS))
    for g in range(GROUPS):
        dtop = np.where(at + g < end[:, None], dtop, 0)  # what lies behind a text's blocks counts nothing
        place = np.minimum(at + g, len(x) - 1)
        seen = x[place]  # (blocks, FILTERS, STEP * CHANNELS)
        w = net["filters"][:, g * FILTERS : (g + 1) * FILTERS]
        filters[:, g * FILTERS : (g + 1) * FILTERS] = np.einsum("bf,bfd->df", dtop, seen, optimize=True)
        dx = dtop[:, :, None] * w.T[None]
        bytes_ = out.reshape(-1, STEP)[place]
        for s in range(STEP):
            ids = bytes_[:, :, s].ravel()
            for c in range(CHANNELS - 1):
                embed[:, c] += np.bincount(ids, weights=dx[:, :, s * CHANNELS + c].ravel(), minlength=256)
    return grad | {"filters": filters, "embed": embed}


def fit(buf: np.ndarray, off: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict:
    rng = np.random.Generator(np.random.PCG64(11))
    net = {
        "embed": rng.normal(0, 0.5, (256, CHANNELS)), "filters": rng.normal(0, 0.12, (STEP * CHANNELS, GROUPS * FILTERS)),
        "shift": np.zeros(FILTERS), "v_mean": rng.normal(0, 0.3, FILTERS), "v_max": rng.normal(0, 0.1, FILTERS), "bias": 0.0,
    }
    net["embed"][0] = 0
    net = {n: np.asarray(v, np.float32) for n, v in net.items()}
    if len(np.unique(y)) < 2 or min((y == 0).sum(), (y == 1).sum()) < 4:
        return net | {"a": 0.0, "b": 0.0}
    held = np.arange(len(y)) % 5 == 4
    ids = np.flatnonzero(~held)
    weight = np.where(y == 1, 0.5 / (y[ids] == 1).sum(), 0.5 / max(1, (y[ids] == 0).sum())) * len(ids)
    m, s, t = {n: np.zeros_like(v) for n, v in net.items()}, {n: np.zeros_like(v) for n, v in net.items()}, 0
    for epoch in range(EPOCHS):
        rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
        rng.shuffle(ids)
        for part in np.array_split(ids, max(1, len(ids) // 32)):
            b = np.concatenate([buf[off[i] : off[i + 1]] for i in part])
            o = np.concatenate(([0], np.cumsum(off[part + 1] - off[part])))

            def slope(z, i, j, part=part):
                q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                return (weight[part[i:j]] * (q - y[part[i:j]]) / len(part)).astype(np.float32)

            t += 1
            for n, g in _gradient(net, b, o, slope).items():
                m[n] = 0.9 * m[n] + 0.1 * g
                s[n] = 0.99 * s[n] + 0.01 * np.square(g)
                step = (m[n] / (1 - 0.9**t)) / (np.sqrt(s[n] / (1 - 0.99**t)) + 1e-6)
                net[n] = (net[n] - rate * (step + 0.001 * net[n])).astype(np.float32)
            net["embed"][0] = 0
    at = np.flatnonzero(held)
    z = np.array([logits(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), net)[0] for i in at], np.float64)
    a, c = platt(z, y[at], share[at]) if len(np.unique(y[at])) == 2 else (1.0, 0.0)
    return net | {"a": a, "b": c}


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_classifier(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> dict:
    """A net from labelled rows that are not held out."""
    return train(labelled_sample(docs, labels.filter(~is_held_out()), per_class), fit)


def classify(docs: DataFrame, net: dict) -> DataFrame:
    """(doc_id, text) -> doc_id, score."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(*k.utf8(batch.column(1)), net))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, net: dict) -> DataFrame:
    """The documents whose score reaches the threshold, all columns as they are."""
    return keep_where(docs, lambda texts: score(*k.utf8(texts), net) >= THRESHOLD)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit_classifier(docs, table(spark, sf_dir, "labels"))
    return classify(docs, net).select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
