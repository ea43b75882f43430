"""Operator 1: document fingerprints by consistent weighted sampling.

Terms are the ``SHINGLE``-word sequences of the whole text (the whole sequence if there are fewer
words, one empty term if there are none), weighted by how often they occur. For each sample and term,
r and c are Gamma(2, 1) and b is uniform, all drawn from a hash of the term; with
t = floor(ln w / r + b) and a = c exp(-r (t - b + 1)) the sample is the (term, t) of the least a. Two
texts agree in a sample with a probability of sum(min w) / sum(max w), the generalised Jaccard
similarity. A fingerprint is 16 hashed bits of each of ``SAMPLES`` samples, in hex.

A Gamma(2, 1) is the sum of two exponentials, so the draws are taken as c = E1 + E2,
r (1 - b) = ln(c / E1), r b = E3. For w = 1 this makes t = 0 and a = E1: for terms that occur
once (nearly all) the least hash decides, and gammas are only evaluated for terms that repeat.

Neighbours (the next document by descending doc_id) are found by ranges of ids: every range is
sorted in its task, and gets the first document of the range below as one more row.

Defined cases: a null text is empty; a null id comes after all others; rows that repeat an id follow
each other by text; a single document is its own neighbour; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as k
from .common import shuffle_partitions, table

SHINGLE, SAMPLES = 5, 128
U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(1717))
_ADD = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * U(2) + _RNG.integers(0, 2, SAMPLES, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * U(2) + U(1)
_LOW52 = U((1 << 52) - 1)
#: Texts in one chunk; their number fits the upper 12 bits of a sorting key.
_TEXTS = 4000
#: Ranges of ids at most.
RANGES = 65536


def terms(buf: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of each distinct term, by text."""
    starts, ends, woff = k.words(buf, off)
    h = k.word_hashes(buf, starts, ends)
    at, place = k.window_starts(woff, n)
    parts = [np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(place)) << U(52) | (k.window_hashes(h, n)[at] >> U(12) if len(at) else at.astype(np.uint64))]
    short = np.flatnonzero(np.diff(woff) < n)
    if len(short):
        lone = np.array([int(k.window_hashes(h[woff[i] : woff[i + 1]], c)[0]) if (c := woff[i + 1] - woff[i]) else 1 for i in short.tolist()], np.uint64)
        parts.append(short.astype(np.uint64) << U(52) | lone >> U(12))
    key = np.sort(np.concatenate(parts))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> U(52)).astype(np.int64), k.mix(key & _LOW52), weight


def _exponential(v: np.ndarray) -> np.ndarray:
    return -np.log((v.astype(np.float64) + 0.5) * 2.0**-64)


def samples(text: np.ndarray, x: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, SAMPLES) of 16 bits; see the module. Every text has a term."""
    once = weight == 1
    light, heavy = x[once], x[~once]
    off = np.searchsorted(text[once], np.arange(n + 1))
    some = np.flatnonzero(off[1:] > off[:-1])
    cut, rows = off[:-1][some], text[~once]
    work = np.empty_like(light)
    log_w = np.log(weight[~once])
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
    owners = rows[starts]
    out = np.zeros((n, SAMPLES), np.uint16)
    for i in range(SAMPLES):
        best, sign = np.full(n, np.inf), np.zeros(n, np.uint64)
        if len(some):
            np.bitwise_xor(light, _ADD[i], out=work)
            np.multiply(work, _TIMES[i], out=work)
            # a = E1 falls as its uniform number grows, so the greatest hash has the least a
            v = np.maximum.reduceat(work, cut)
            best[some], sign[some] = _exponential(v), v
        if len(heavy):
            v = (heavy ^ _ADD[i]) * _TIMES[i]
            e1 = _exponential(v)
            c, rb = e1 + _exponential(k.mix(v + U(0x1234567))), _exponential(k.mix(v + U(0x89ABCDE)))
            r = np.log(c / e1) + rb
            t = np.floor((log_w + rb) / r)
            a = c * np.exp(-(r * (t + 1) - rb))
            least = np.minimum.reduceat(a, starts)
            at = np.flatnonzero(a == np.repeat(least, np.diff(np.append(starts, len(a)))))
            own = np.searchsorted(owners, rows[at])
            pick = np.zeros(len(owners), np.int64)
            pick[own[::-1]] = at[::-1]
            win = least < best[owners]
            sign[owners[win]] = v[pick[win]] + t[pick[win]].astype(np.int64).astype(np.uint64) * U(0x9E3779B97F4A7C15)
        out[:, i] = (k.mix(sign) >> U(48)).astype(np.uint16)
    return out


def fingerprints(column: pa.Array, n: int = SHINGLE) -> np.ndarray:
    """(rows, SAMPLES) of 16 bits for a column of texts."""
    parts, (buf, off) = [], k.utf8(column)
    for _, _, b, o in k.chunks(buf, off):
        for i in range(0, len(o) - 1, _TEXTS):
            part = o[i : i + _TEXTS + 1]
            parts.append(samples(*terms(b[part[0] : part[-1]], part - part[0], n), len(part) - 1))
    return np.concatenate(parts) if parts else np.zeros((0, SAMPLES), np.uint16)


def as_hex(prints: np.ndarray) -> list[str]:
    raw = np.ascontiguousarray(prints.astype(">u2")).tobytes().hex()
    size = SAMPLES * 4
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of samples in which two fingerprints agree."""
    return (a == b).mean(1)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_hex(fingerprints(batch.column(1))))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows (range, tail, doc_id, text), dealt by range and sorted so that each row's neighbour follows it.

    Eight ranges a shuffle partition (at most ``RANGES``), bounded by quantiles of the ids; only their bounds and
    the first ids of each come to the driver. A row with ``tail`` is the first of the range below (of the topmost
    for the last).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = shuffle_partitions(spark)
    ranges = min(RANGES, ranges or 8 * n)
    cuts = rows.filter("doc_id is not null").stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    cuts = sorted({int(c) for c in cuts})
    blocks = [cuts[i : i + 64] for i in range(0, len(cuts), 64)] or [[]]
    longs = lambda x: F.from_json(F.lit(json.dumps(x)), "array<bigint>")  # noqa: E731  a literal, once folded
    below = lambda a: F.size(F.filter(a, lambda c: c < F.col("doc_id")))
    block = F.least(below(longs([b[-1] for b in blocks if b])), F.lit(len(blocks) - 1))
    rows = rows.withColumn("block", block)
    rows = rows.withColumn("range", F.col("block") * 64 + below(F.get(F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>"), F.col("block"))))
    heads = {r["range"]: r["head"] for r in rows.groupBy("range").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    above = {r: order[i - 1] for i, r in enumerate(order)}  # the topmost goes to the lowest
    size = (max(heads) if heads else 0) + 1
    head = F.get(longs([heads.get(i) for i in range(size)]), F.col("range"))
    target = F.get(longs([above.get(i) for i in range(size)]), F.col("range"))
    place = lambda r, tail: F.struct(r.cast("long").alias("range"), F.lit(tail).alias("tail"))
    own = place(F.col("range"), False)
    places = F.when(F.col("doc_id").eqNullSafe(head), F.array(own, place(target, True))).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("p")).select("p.range", "p.tail", "doc_id", "text")
    # neighbouring ranges go to one task, each task gets about as many
    return dealt.repartitionById(n, (F.col("range") * n / F.lit(size)).cast("int")).sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), "text")


_FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document.

    The edited text has its last half replaced by the beginning of the next document.
    """

    def run(batches):
        held = None  # the last row so far: range, tail, doc_id, text, fingerprint
        for batch in batches:
            if not batch.num_rows:
                continue
            places, tails, ids, texts = (batch.column(i).to_pylist() for i in range(4))
            prints = fingerprints(batch.column(3))
            if held is not None:
                places, tails, ids, texts = ([held[i], *x] for i, x in enumerate((places, tails, ids, texts)))
                prints = np.concatenate([held[4][None], prints])
            held = (places[-1], tails[-1], ids[-1], texts[-1], prints[-1])
            at = [i for i in range(len(ids) - 1) if not tails[i] and places[i] == places[i + 1]]
            if not at:
                continue
            edited = []
            for i in at:
                half = len(texts[i]) // 2
                edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
            changed, at_ = fingerprints(pa.array(edited, pa.string())), np.array(at)
            columns = [
                pa.array([ids[i] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(as_hex(prints[at_])), pa.array(as_hex(changed)),
                pa.array(likeness(prints[at_], changed)), pa.array(likeness(prints[at_], prints[at_ + 1])),
            ]
            yield pa.RecordBatch.from_arrays(columns, list(_FIELDS))

    return with_next(docs, ranges).mapInArrow(run, _SCHEMA)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
