"""Operator 3: quality rules - counts with fixed limits, and a calibrated hashed-n-gram model.

Base rules over the words of the whole text: fewer than 50 words, or over half of the words in
repeated 3-word windows, fail. The method then judges the rest: a logistic regression over hashed
word 1- and 2-grams and 4-character n-grams (relative frequencies, so length does not
matter), fitted on labelled rows, with Platt scaling on rows left out of the fit, and kept if the
calibrated probability of good quality is at least ``KEEP``.

The fit reads a bounded sample: at most ``SAMPLE`` labelled rows of each class, the smallest by a
hash of their id, and at most ``SAMPLE_BYTES`` of text, in one task. Scoring covers every whole text, in Arrow batches.

Defined cases: a null text has no words and fails; so does an empty one; repeated rows are judged
one by one; with no or one-class labels the model gives every text the probability 1 (0 if all are
bad); an empty table gives no rows; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as k
from .common import stored, table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP = 0.5
#: Labelled rows of each class that a fit may read, and bytes of all their texts.
SAMPLE, SAMPLE_BYTES = 1000, 256 << 20
BITS = 15
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Multipliers of the bytes in a character (at most four; more in malformed ones) and of the characters in a gram.
_RNG = np.random.Generator(np.random.PCG64(33))
_PLACE, _GRAM = (_RNG.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for n in (8, 4))


def base_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of a chunk's texts; see the module."""
    starts, ends, woff = k.words(buf, off)
    inside = k.WORD_BYTE[buf]
    lead = (buf & 0xC0) != 0x80
    h = k.word_hashes(buf, starts, ends)
    repeat = np.zeros(len(h), bool)
    at, place = k.window_starts(woff, 3)
    if len(at):
        key = k.window_hashes(h, 3)[at] + k.mix(np.repeat(np.arange(1, len(off), dtype=np.uint64), np.diff(place)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.any():
            repeat = k.covered(at[twice], 3, len(h))
    dup, raw = np.zeros(len(off) - 1, np.int64), buf.tobytes()
    for i in range(len(off) - 1):
        lines = raw[off[i] : off[i + 1]].split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
            dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": np.diff(woff),
        "word_chars": k.segment_sums(inside & lead, off),
        "n_symbols": k.segment_sums(_SYMBOL[buf], off),
        "n_dup_lines": dup,
        "n_repeat_words": k.segment_sums(repeat, woff),
    }


def base_failed(x: dict[str, np.ndarray]) -> np.ndarray:
    return (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])


def _features(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Families of features of a chunk: bins, and for each text first and end among them."""
    starts, ends, woff = k.words(buf, off)
    h, shift = k.word_hashes(buf, starts, ends), k.U(64 - BITS)
    two = k.window_hashes(h, 2)
    out = [((h >> shift).astype(np.int32), woff[:-1], woff[1:])]
    out.append(((two >> shift).astype(np.int32), woff[:-1], np.maximum(woff[1:] - 1, woff[:-1])))
    # characters: code points, by the bytes they begin at
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    point = np.add.reduceat(buf * _PLACE[np.arange(len(buf)) - np.repeat(lead, np.diff(np.append(lead, len(buf))))], lead, dtype=np.uint32) if len(lead) else np.zeros(0, np.uint32)
    n = max(0, len(point) - 3)
    four = sum(point[i : n + i] * _GRAM[i] for i in range(4)) if n else np.zeros(0, np.uint32)
    bins = (four >> np.uint32(32 - BITS)).astype(np.int32)
    coff = np.searchsorted(lead, off)
    return [*out, (bins, coff[:-1], np.maximum(coff[1:] - 3, coff[:-1]))]


def score(buf: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    """Calibrated probability of good quality of each text of a chunk."""
    z = np.full(len(off) - 1, model["bias"])
    for (bins, first, end), w in zip(_features(buf, off), model["weights"]):
        first, end = np.minimum(first, len(bins)), np.minimum(end, len(bins))
        some = np.flatnonzero(end > first)
        if len(some):
            # every text is summed alone, so that equal texts score alike wherever they stand
            cuts = np.stack([first[some], end[some]], 1).ravel()
            sums = np.add.reduceat(np.append(w[bins].astype(np.float64), 0.0), cuts)[::2]
            z[some] += sums / (end - first)[some]
    return 1 / (1 + np.exp(-np.clip(model["a"] * z + model["b"], -30, 30)))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a z + b))) by Newton steps, with smoothed targets."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, p = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        grad = x.T @ (weight * (q - t)) + 1e-6 * p
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        p = p - step / max(1.0, np.abs(step).max())
    return (float(p[0]), float(p[1])) if p[0] > 0 else (1.0, 0.0)


def _constant(y: np.ndarray) -> dict:
    good = not len(y) or bool(y.max() == 1)
    return {"weights": [np.zeros(1 << BITS, np.float32)] * 3, "bias": 0.0, "a": 1.0, "b": 30.0 if good else -30.0}


def fit(buf: np.ndarray, off: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 60) -> dict:
    """Model from labelled texts; ``share`` weighs each row so that classes count as in the population.

    Texts that the base rules fail teach nothing, as the model never judges them.
    """
    if len(y):
        ok = np.concatenate([~base_failed(base_counts(b, o)) for _, _, b, o in k.chunks(buf, off)])
        buf, y, share = buf[np.repeat(ok, np.diff(off))], y[ok], share[ok]
        off = np.concatenate(([0], np.cumsum(np.diff(off)[ok])))
    if len(np.unique(y)) < 2 or min((y == 0).sum(), (y == 1).sum()) < 4:
        return _constant(y)
    size = 3 << BITS
    row, col, val = [], [], []
    for i, _, b, o in k.chunks(buf, off):
        for f, (bins, first, end) in enumerate(_features(b, o)):
            n = np.maximum(end - first, 0)
            r = np.repeat(np.arange(len(n)), n)
            at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            key, count = np.unique(r.astype(np.int64) * size + bins[at] + (f << BITS), return_counts=True)
            row.append(key // size + i)
            col.append((key % size).astype(np.int32))
            val.append((count / n[key // size]).astype(np.float32))
    row, col, val = np.concatenate(row), np.concatenate(col), np.concatenate(val)
    held = np.arange(len(y)) % 4 == 3
    rms = np.sqrt(np.bincount(col, weights=val * val, minlength=size) / len(y)) + 1e-4
    val = (val / rms[col]).astype(np.float32)
    use = ~held[row]
    r, c, v = row[use], col[use], val[use]
    weight = np.where(y == 1, 0.5 / (y[~held] == 1).sum(), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    w, bias, m, s, mb, sb = np.zeros(size), 0.0, np.zeros(size), np.zeros(size), 0.0, 0.0
    scale = 1 / 30
    for t in range(1, rounds + 1):
        z = np.bincount(r, weights=w[c] * v, minlength=len(y)) * scale + bias
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(c, weights=v * g[r], minlength=size) * scale + 1e-6 * w
        gb = g.sum()
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.1 * (m / fix1) / (np.sqrt(s / fix2) + 1e-6)
        bias -= 0.1 * (mb / fix1) / (np.sqrt(sb / fix2) + 1e-6)
    z = np.bincount(row, weights=w[col] * val, minlength=len(y)) * scale + bias
    a, b = platt(z[held], y[held], share[held]) if len(np.unique(y[held])) == 2 else (1.0, 0.0)
    weights = [x.astype(np.float32) for x in np.split(w * scale / rms, 3)]
    return {"weights": weights, "bias": float(bias), "a": a, "b": b}


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, y, share): at most ``per_class`` rows of each class, the first by a hash of the id, of ``most_bytes`` in all.

    ``share`` is the class's labelled rows for each sampled one. Rows without an id or label are out; of documents
    that repeat an id the least text counts. A text that would bring the sample's bytes beyond the bound, and those after
    it, are not learned from, so the one task that fits a model holds no more.
    """
    rows = labels.select("doc_id", F.col("quality").alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [
        rows.filter(F.col("y") == y).orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id").limit(per_class)
        .withColumn("share", F.lit(float(counts.get(y, 0) / max(1, min(counts.get(y, 0), per_class)))))
        for y in (0, 1)
    ]
    # at most 2 * per_class rows: a proven bound for the broadcast
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select("doc_id", "text").join(sample, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("share").alias("share"))
    rows = stored(rows, "labelled")
    # ids and sizes of 2 * per_class rows at most
    order = Window.orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id")
    sizes = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).withColumn("upto", F.sum("size").over(order))
    return rows.join(F.broadcast(sizes.filter(F.col("upto") <= most_bytes).select("doc_id")), "doc_id", "left_semi")


def train(sample: DataFrame, fitter) -> dict:
    """Runs ``fitter(buf, off, y, share) -> dict of arrays`` on the bounded sample, in one task."""
    import pickle

    def run(batches):
        parts = list(batches)
        if sum(b.num_rows for b in parts):
            rows = pa.Table.from_batches(parts)
            rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
            # the order in which folds are dealt does not follow the ids
            rows = rows.take(pa.array(np.random.Generator(np.random.PCG64(7)).permutation(rows.num_rows)))
            buf, off = k.utf8(rows["text"])
            y, share = rows["y"].to_numpy().astype(np.int64), rows["share"].to_numpy()
        else:
            buf, off, y, share = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitter(buf, off, y, share))], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fitter(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))


def fit_rules(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> dict:
    return train(labelled_sample(docs, labels, per_class), fit)


def judge(texts: pa.Array, model: dict) -> dict[str, np.ndarray]:
    """All columns of the contract, and the probability, of a batch of texts."""
    buf, off = k.utf8(texts)
    parts = []
    for _, _, b, o in k.chunks(buf, off):
        x = base_counts(b, o)
        x["base_failed"] = base_failed(x)
        x["p_good"] = score(b, o, model)
        x["kept"] = ~x["base_failed"] & (x["p_good"] >= KEEP)
        parts.append(x)
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]} if parts else {}


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
_SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, p_good double"


def quality_rules(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text) -> doc_id, the counts, base_failed, kept and p_good."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = judge(batch.column(1), model)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[f]) for f in FIELDS)], ["doc_id", *FIELDS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def keep_where(docs: DataFrame, verdict) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text ``verdict(texts) -> bools`` keeps."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(verdict(batch.column(at))))

    return docs.mapInArrow(run, docs.schema)


def keep_quality_rules(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that the rules keep, all columns as they are."""
    return keep_where(docs, lambda texts: judge(texts, model)["kept"])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
