"""Operator 7: SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: A-Z lower-cased, words joined by one space, XXH64 (seed 42) of every run of
``shingle`` words (repeats included; the whole sequence if there are fewer words); a bit is 1 if
over half of the hashes set it. Without words the fingerprint is zero.

Links: fingerprints with at most ``radius`` differing bits. Bit ``i`` gets a vector phi(i) in
{0,1}^(radius+1) other than zero, and table ``v`` (each v other than zero) hashes the bits with
<phi(i), v> = 1. Whatever ``radius`` bits differ, some v is orthogonal to all of their vectors, so
table v hashes none of them and every pair within the radius shares a bucket in some table. Equal fingerprints are one node
before that. Within a bucket members are compared in its task, and no more than a spanning forest
leaves it once it has over ``SMALL`` nodes; a bucket above ``HOT`` nodes is hashed again by covering
masks over the bits that are still free, which loses no pair either.

:func:`keep_first` asks for ``WIDE_SHINGLE``-word shingles of a similarity of about 0.8 or more. Fingerprints
of such shingles differ in some ten of 64 bits then, more than tables can cover; those of the texts' distinct
words differ in four. So each text gets ``NEAR_PRINTS`` fingerprints of distinct words, each with tables that
cover ``NEAR_RADIUS`` bits, and a pair is missed only if it differs in more bits of every one of them. A link
must also hold in a fingerprint of ``WIDE_BITS`` bits over the longer shingles, whose differing bits measure
the similarity itself. It stands beside the others in every bucket.

Defined cases: a null text has no words; documents without an id get their fingerprint and the
component of equal fingerprints that have an id (null otherwise) and make no links of their own;
repeated rows are equal fingerprints; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as k
from .common import by_bucket, dealt, stored, table
from .components import components

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Buckets up to SMALL nodes give every linked pair, larger ones a spanning forest; above HOT they are split again.
SMALL, HOT = 8, 16384
#: Of keep_first: fingerprints of distinct words and their differing bits; words and bits of the wide one, and how
#: many of these may differ: 38.8 do so in the mean at a similarity of 0.8, with a deviation of 5.7.
NEAR_PRINTS, NEAR_RADIUS = 10, 3
WIDE_SHINGLE, WIDE_BITS, WIDE_RADIUS = 5, 256, 48
U = np.uint64
#: The primes of XXH64.
P1, P2, P3, P4, P5 = (
    U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5),
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For each byte its 8 bits as 8 counters of a byte each.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
_LONG = 256  # shingles of more bytes are hashed one by one


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges of ``buf``, range by range of one length in step."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,)))
    order = np.argsort(np.minimum(size, 65535).astype(np.uint16), kind="stable")
    sizes = size[order]
    cuts = np.flatnonzero(np.diff(sizes)) + 1
    old = np.seterr(over="ignore")
    for part in np.split(order, cuts):
        n = int(size[part[0]])
        at = start[part]
        if n > _LONG:
            raw = buf.tobytes() if len(part) > 64 else None
            for i, a in zip(part, at):
                out[i] = xxhash.xxh64_intdigest(raw[a : a + n] if raw else buf[a : a + n].tobytes(), seed)
            continue
        place = 0
        if n >= 32:
            v = [np.full(len(part), x, np.uint64) for x in (U(seed) + P1 + P2, U(seed) + P2, U(seed), U(seed) - P1)]
            while place + 32 <= n:
                for j in range(4):
                    v[j] = _rotl(v[j] + eight[at + (place + 8 * j)] * P2, 31) * P1
                place += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for j in range(4):
                h = (h ^ (_rotl(v[j] * P2, 31) * P1)) * P1 + P4
        else:
            h = np.full(len(part), U(seed) + P5, np.uint64)
        h += U(n)
        while place + 8 <= n:
            h = _rotl(h ^ (_rotl(eight[at + place] * P2, 31) * P1), 27) * P1 + P4
            place += 8
        if place + 4 <= n:
            h = _rotl(h ^ ((eight[at + place] & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
            place += 4
        while place < n:
            h = _rotl(h ^ (padded[at + place].astype(np.uint64) * P5), 11) * P1
            place += 1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        out[part] = h ^ (h >> U(32))
    np.seterr(**old)
    return out


def shingles(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, start and size of each shingle, each text's place among the shingles."""
    starts, ends, woff = k.words(buf, off)
    size = ends - starts
    to = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    out[np.repeat(to - starts, size) + np.flatnonzero(k.WORD_BYTE[buf])] = _LOWER[buf[k.WORD_BYTE[buf]]]
    count = np.diff(woff)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    place = np.concatenate(([0], np.cumsum(made)))
    at = np.arange(place[-1]) + np.repeat(woff[:-1] - place[:-1], made)
    last = at + np.repeat(np.minimum(count, n), made) - 1
    return out, to[at], to[last] + size[last] - to[at], place


def majority(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """64 bits of each text: those that over half of its hashes set."""
    count = np.diff(place)
    # sums of 8-bit counters hold up to 255 shingles; longer texts are summed in parts
    parts = -(-count // 255)
    poff = np.concatenate(([0], np.cumsum(parts)))
    cut = np.repeat(place[:-1] - 255 * poff[:-1], parts) + 255 * np.arange(poff[-1])
    bits = np.zeros((len(count), 64), np.int64)
    if len(cut):
        lanes = np.stack([np.add.reduceat(_SPREAD[b], cut) for b in np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8).T], 1)
        wide = np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 64).astype(np.int64)
        some = parts > 0
        bits[some] = np.add.reduceat(wide, poff[:-1][some], axis=0)
    return np.packbits(2 * bits > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(buf: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text of a chunk."""
    out, start, size, place = shingles(buf, off, n)
    return majority(xxh64(out, start, size), place)


def wide_fingerprints(buf: np.ndarray, off: np.ndarray, n: int = WIDE_SHINGLE) -> np.ndarray:
    """(texts, WIDE_BITS / 64) words of the second fingerprint, from differently mixed hashes of one shingle."""
    out, start, size, place = shingles(buf, off, n)
    h = xxh64(out, start, size)
    return np.stack([majority(k.mix(h ^ U(0x9E3779B97F4A7C15 * (i + 1) % 2**64)), place) for i in range(WIDE_BITS // 64)], 1)


def word_fingerprints(buf: np.ndarray, off: np.ndarray, n: int = NEAR_PRINTS) -> np.ndarray:
    """(texts, n) fingerprints of each text's distinct words, from differently mixed hashes of a word."""
    out, start, size, place = shingles(buf, off, 1)
    h = xxh64(out, start, size)
    parts = []
    for i in range(0, len(place) - 1, 4000):  # a text's number takes the upper 12 bits of a sorting key
        own = place[i : i + 4001]
        key = np.sort(np.repeat(np.arange(len(own) - 1, dtype=np.uint64), np.diff(own)) << U(52) | h[own[0] : own[-1]] >> U(12))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        at = np.searchsorted(key, np.arange(len(own), dtype=np.uint64) << U(52))
        low = key & U((1 << 52) - 1)
        parts.append(np.stack([majority(k.mix(low ^ U(0xD6E8FEB86659FD93 * (j + 1) % 2**64)), at) for j in range(n)], 1))
    return np.concatenate(parts) if parts else np.zeros((0, n), np.uint64)


def _per_text(docs: DataFrame, columns: dict[str, tuple[str, object]], more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the bigint columns ``more`` and one for each ``name: (type, function of a chunk's bytes and offsets)``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                parts = list(k.chunks(*k.utf8(batch.column(1))))
                found = [[f(b, o) for _, _, b, o in parts] for _, f in columns.values()]
                arrays = [pa.array([x.tobytes() for part in c for x in part], pa.binary()) if c[0].ndim > 1 else pa.array(np.concatenate(c).view(np.int64)) for c in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + i) for i in range(len(more))), *arrays], ["doc_id", *more, *columns])

    schema = ", ".join(["doc_id bigint", *(f"{n} bigint" for n in more), *(f"{n} {t}" for n, (t, _) in columns.items())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(run, schema)


def fingerprint_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp bigint)."""
    return _per_text(docs, {"fp": ("bigint", lambda b, o: fingerprints(b, o, shingle))})


def near_table(docs: DataFrame, prints: int = NEAR_PRINTS, wide: int = WIDE_SHINGLE, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> (doc_id[, more], fp binary: ``prints`` fingerprints of words, wide binary: that of ``wide`` words)."""
    return _per_text(docs, {"fp": ("binary", lambda b, o: word_fingerprints(b, o, prints)), "wide": ("binary", lambda b, o: wide_fingerprints(b, o, wide))}, more)


def covering_masks(radius: int = RADIUS, bits: list[int] | None = None) -> list[int]:
    """2^(radius+1) - 1 masks over ``bits`` (all 64 if none are given); see the module."""
    top, bits = (1 << (radius + 1)) - 1, list(range(64)) if bits is None else bits

    def masks(phi: list[int]) -> list[int]:
        return [sum(1 << b for j, b in enumerate(bits) if (phi[j] & v).bit_count() % 2) for v in range(1, top + 1)]

    if len(bits) == 64 and radius < 6:
        return masks([j % top + 1 for j in range(64)])
    rng = np.random.Generator(np.random.PCG64(radius))
    tries = [masks(rng.integers(1, top + 1, len(bits)).tolist()) for _ in range(20)]
    return max(tries, key=lambda m: min(x.bit_count() for x in m))


class _Nodes:
    """Nodes of a bucket: id, fingerprint and, if there is one, the second fingerprint."""

    def __init__(self, ids: np.ndarray, fps: np.ndarray, wide: np.ndarray | None, radius: int):
        self.ids, self.fps, self.wide, self.radius = ids, fps, wide, radius

    def take(self, at) -> _Nodes:
        return _Nodes(self.ids[at], self.fps[at], None if self.wide is None else self.wide[at], self.radius)

    def near(self, a, b: np.ndarray) -> np.ndarray:
        """Which of the nodes at ``b`` link to the one (or those) at ``a``."""
        out = np.bitwise_count(self.fps[b] ^ self.fps[a]) <= self.radius
        if self.wide is not None and out.any():
            hit = np.flatnonzero(out)
            other = self.wide[a[hit]] if isinstance(a, np.ndarray) else self.wide[a]
            out[hit] = np.bitwise_count(self.wide[b[hit]] ^ other).sum(1, dtype=np.int64) <= WIDE_RADIUS
        return out


def _forest(nodes: _Nodes) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span what the comparisons of one bucket link: each node is compared with those not yet reached."""
    ids, left, a, b = nodes.ids, np.arange(len(nodes.ids)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            j = todo.pop()
            near = nodes.near(j, left)
            if near.any():
                a.append(np.full(near.sum(), ids[j]))
                b.append(ids[left[near]])
                todo += left[near].tolist()
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def _spanned(edges: list) -> list:
    """One edge to the least node of its component for each node of ``edges``."""
    a, b = (np.concatenate([e[i] for e in edges]) for i in (0, 1)) if edges else (np.zeros(0, np.int64),) * 2
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while (label[x] != label[y]).any():
        least = np.minimum(label[x], label[y])
        for end in (x, y):
            np.minimum.at(label, label[end], least)
        while (label != label[label]).any():
            label = label[label]
    some = np.flatnonzero(label != np.arange(len(ids)))
    return [(ids[some], ids[label[some]])]


def _pairs(nodes: _Nodes, mask: int, hot: int, edges: list, depth: int = 0) -> None:
    """Adds edges that connect what links inside the buckets of one mask connect."""
    key = nodes.fps & U(mask)
    order = np.argsort(key, kind="stable")
    nodes, key = nodes.take(order), key[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
    size = np.diff(first)
    # small runs: every pair, by distance within the run
    small = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    for lag in range(1, min(SMALL, int(size.max(initial=1)))):
        if lag >= len(small):
            break
        x, y = small[lag:], small[:-lag]
        same = key[x] == key[y]
        x, y = x[same], y[same]
        near = nodes.near(x, y)
        edges.append((nodes.ids[x[near]], nodes.ids[y[near]]))
    for r in np.flatnonzero(size > SMALL):
        part = nodes.take(slice(first[r], first[r + 1]))
        free = [i for i in range(64) if not mask >> i & 1]
        if size[r] > hot and len(free) > 8 and depth < 3:
            # a large bucket is hashed again by masks that also cover its free bits; they find the same links again and again
            found: list = []
            for deeper in covering_masks(nodes.radius, free):
                _pairs(part, mask | deeper, hot, found, depth + 1)
                found = _spanned(found)
            edges.extend(found)
        else:
            edges.append(_forest(part))


def links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT, bucket_nodes: int = 50_000) -> DataFrame:
    """Edges (a, b) that connect just what links of at most ``radius`` bits connect.

    ``nodes`` has (node bigint, fp bigint or binary[, wide binary]), each once: one fingerprint, or several, of
    which one must be within the radius; with a wide one links must hold there too. The entries of all
    tables are dealt to groups of about ``bucket_nodes`` by table and hashed key, packed as bytes; a task
    holds one group at a time.
    """
    masks = covering_masks(radius)
    parts = max(1, -(-nodes.count() // bucket_nodes))
    names = ["ids", "fps", "wide"][: len(nodes.columns)]

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, many = batch.column(0).to_numpy(), pa.types.is_binary(batch.column(1).type)
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64) if many else batch.column(1).to_numpy().view(np.uint64)
            wide = {"wide": np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WIDE_BITS // 64)} if len(names) > 2 else {}
            for f, own in enumerate(fps.reshape(len(ids), -1).T):
                for v, mask in enumerate(masks):
                    sub = (k.mix(own & U(mask)) >> U(33)).astype(np.int64) % parts
                    yield from dealt((f * len(masks) + v) * parts + sub, {"ids": ids, "fps": own} | wide)

    def compare(bucket, held):
        ids, fps = (np.frombuffer(b"".join(held[c]), t) for c, t in (("ids", np.int64), ("fps", np.uint64)))
        wide = np.frombuffer(b"".join(held["wide"]), np.uint64).reshape(-1, WIDE_BITS // 64) if "wide" in held else None
        edges: list = []
        _pairs(_Nodes(ids, fps, wide, radius), masks[bucket // parts % len(masks)], hot, edges)
        a, b = _spanned(edges)[0]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    entries = nodes.mapInArrow(spread, "bucket bigint, " + ", ".join(f"{n} binary" for n in names))
    return by_bucket(entries, compare, "a bigint, b bigint")


def components_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp[, wide]) -> (fp[, wide], component_id), one row a fingerprint."""
    keys = [c for c in prints.columns if c != "doc_id"]
    nodes = stored(prints.groupBy(*keys).agg(F.min("doc_id").alias("node")), "fingerprints")
    found = components(links(nodes.filter("node is not null").select("node", *keys), radius))
    return nodes.join(found, "node", "left").select(*keys, F.coalesce("component", "node").alias("component_id"))


def _with_components(prints: DataFrame, radius: int) -> DataFrame:
    prints = stored(prints, "simhash")
    keys = [c for c in prints.columns if c != "doc_id"]
    return prints.join(components_of(prints, radius), keys).select("doc_id", *keys, "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, component_id): all links within ``radius`` bits."""
    return _with_components(fingerprint_table(docs, shingle), radius)


def similar_groups(docs: DataFrame, prints: int = NEAR_PRINTS, radius: int = NEAR_RADIUS, wide: int = WIDE_SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, component_id): groups of a likeness of about 0.8 in ``wide``-word shingles."""
    return _with_components(near_table(docs, prints, wide), radius).select("doc_id", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, prints: int = NEAR_PRINTS, radius: int = NEAR_RADIUS, wide: int = WIDE_SHINGLE) -> DataFrame:
    """One document of each group, all columns as they are: that with the smallest doc_id, of rows that repeat it the one whose text has the least hash.

    Groups are of texts, not of ids: rows that repeat an id with other texts are documents of their own. Documents
    without an id stay. Equal rows are one.
    """
    place = "_place_of_" + "_".join(docs.columns)
    marked = docs.withColumn(place, F.xxhash64("text"))  # tells the rows of one id apart
    named = marked.select("doc_id", "text", F.col(place).alias("h"))
    found = stored(near_table(named.filter("doc_id is not null"), prints, wide, ("h",)), "simhash")
    keys = ["fp", "wide"]
    # nodes are numbered, as one id may stand for several texts; the numbers hold once they are written
    nodes = stored(found.groupBy(*keys).agg(F.min(F.struct("doc_id", "h")).alias("first")).withColumn("node", F.monotonically_increasing_id()), "fingerprints")
    groups = nodes.join(components(links(nodes.select("node", *keys), radius)), "node", "left")
    first = groups.groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("first").alias("first"))
    first = first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias(place))
    kept = marked.join(first, ["doc_id", place], "left_semi")
    one = kept.withColumn("_n_" + place, F.row_number().over(Window.partitionBy("doc_id", place).orderBy("text"))).filter(F.col("_n_" + place) == 1)
    return one.select(docs.columns).unionByName(docs.filter("doc_id is null"))
