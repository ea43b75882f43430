"""Operator 6: best-fit packing of documents into sequences, by minimum bin slack.

A document's tokens end with the end token. Documents of more than ``capacity`` tokens are cut into
pieces of ``capacity``, the first of which may be shorter. Only lengths matter for the bins, so the
plan is made on the histogram of lengths (at most ``capacity`` numbers, on the driver): each bin
starts with the longest piece left, a subset-sum dynamic program over bitsets finds the fullest
combination of available lengths for the rest, and that combination is removed, as many times over
as all of its lengths last. Pieces get their places by their rank among pieces of their length: ranks
are counted within (length, salt) groups and shifted by the groups before; a length has more salts the
more frequent it is, so none meets in one task.

Defined cases: a null or empty text is its end token alone; repeated rows are packed each; a null
doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored, table

CAPACITY, END_ID = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Characters that are encoded in one go.
ENCODE_CHARS = 1_000_000


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, uses) of a combination that fills ``room`` as far as ``counts`` allows."""
    everything = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            trail.append((reach, length, take))
            reach |= (reach << (length * take)) & everything
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(trail):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return list(used.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, uses)]): patterns of bins that use up ``counts``."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = dict(fullest(left, capacity - longest))
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        bins = min(left[n] // uses for n, uses in pattern.items())
        for n, uses in pattern.items():
            left[n] -= uses * bins
            if not left[n]:
                del left[n]
        out.append((bins, sorted(pattern.items(), reverse=True)))
    return out


class Places:
    """Sequence and offset of a piece by its length and its rank among pieces of that length."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        rows, used, base = [], {}, 0
        for bins, pattern in patterns:
            offset = 0
            for length, uses in pattern:
                rows.append((length << 48 | used.get(length, 0), base, uses, offset))
                used[length] = used.get(length, 0) + uses * bins
                offset += length * uses
            base += bins
        self.rows = np.array(sorted(rows) or [(0, 0, 1, 0)], np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length.astype(np.int64) << 48 | rank
        start, base, uses, offset = self.rows[np.searchsorted(self.rows[:, 0], key, "right") - 1].T
        nth = key - start
        return base + nth // uses, offset + nth % uses * length


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, start, length, ids_crc32[, ids]).

    ``tokenizer`` is a file of the public vocabularies or an absolute path.
    """

    def run(batches):
        import public_tokenizers

        from .pretokens import encoder

        encode = encoder(tokenizer if tokenizer.startswith("/") else public_tokenizers.path(tokenizer)).encode
        for batch in batches:
            texts = batch.column(1).fill_null("")
            size = np.cumsum(pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            for _, rows in _runs(size // ENCODE_CHARS):
                found, place = encode(texts[rows].to_pylist())  # no more texts as strings than are encoded at once
                out = []
                for i, doc in enumerate(batch.column(0)[rows].to_pylist()):
                    own = np.append(found[place[i] : place[i + 1]], end_id).astype("<u4")
                    start = 0
                    for n, length in enumerate([(len(own) - 1) % capacity + 1, *[capacity] * ((len(own) - 1) // capacity)]):
                        seen = own[start : start + length]
                        out.append((doc, n, start, length, zlib.crc32(seen.tobytes()), seen.astype(np.int32) if ids else None))
                        start += length
                columns = list(zip(*out))
                arrays = [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns[:5])]
                if ids:
                    arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    import pyarrow.compute  # noqa: F401  pa.compute is used in run

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _runs(part: np.ndarray):
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield a, slice(a, b)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Pieces are placed without their ids, which are joined to them at the end by the number of their stored row.
    """
    whole = pieces(docs, tokenizer, capacity, end_id, ids)
    whole = stored(whole.withColumn("row", F.monotonically_increasing_id()) if ids else whole, "pieces")
    cut = whole.drop("ids")
    histogram = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in histogram}
    places = Places(plan(counts, capacity))
    # a length has as many salts as its share of all pieces makes tasks, so that each group is about one task's rows at most
    total, parts = max(1, sum(counts.values())), shuffle_partitions(docs.sparkSession)
    salts = F.get(F.from_json(F.lit(json.dumps([-(-counts.get(n, 0) * parts // total) or 1 for n in range(capacity + 1)])), "array<bigint>"), F.col("length").cast("int"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    groups = groups.select("length", "salt", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(groups, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))

    names = [*cut.columns, "sequence_id", "offset"]

    def place(batches):
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sequence, offset = places.find(column["length"].to_numpy(), column["rank"].to_numpy())
            column |= {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([column[n] for n in names], names)

    types = {f.name: f.dataType.simpleString() for f in cut.schema} | {"sequence_id": "bigint", "offset": "bigint"}
    placed = ranked.select(*cut.columns, "rank").mapInArrow(place, ", ".join(f"{n} {types[n]}" for n in names))
    return placed.join(whole.select("row", "ids"), "row").drop("row") if ids else placed


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
