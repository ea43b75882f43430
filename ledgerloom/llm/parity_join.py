"""Operator 11: n-gram Jaccard join by parity sketches.

A text's set holds the distinct runs of ``SHINGLE`` words (A-Z lower-cased; with fewer words the whole
sequence). Two texts link if 100 |A & B| >= ``PERCENT`` |A | B|. Equal sets are one node, named by their
smallest doc_id, before anything else. For the others:

* Sizes fall into bands; a family has the sets of one band and those of the next that can still link into it.
  In family f at most d symbols may differ, and each set gets a sketch of K > d words of 64 bits: each shingle
  flips one bit of one word. Differing bits of two sketches are no more than differing shingles.
* Pigeonhole: d differing shingles leave K - d places of the sketches untouched, so links share a bucket (family,
  place, word). As few shingles fall into one place, the words in a bucket's key are 96 bits: those of the sketch
  and 32 that are the XOR of the shingles' hashes. Words with under ``LOW`` set bits say little and are skipped,
  unless a set has more of them than the K - d - 1 that a pair can spare: where all equal words of a pair are
  low ones, both sets have that many.
* A bucket gives a star of candidates from its smallest id. Tasks make stars of what they hold before they send
  one id a bucket on, so a bucket that a third of all sets share is never in one task.
* Candidates whose sketches differ in too few bits are verified on the texts themselves.
* Stars leave out pairs. Where a group of candidates is not one component of links yet, its sets are compared
  across components, by blocks of sketches, and the nearest pairs that were not yet verified are, for twice and
  twice as many pairs of each component, until none is left. So no link is lost; only a pair that joins what
  other links have joined is never looked at.

Shingles are compared by 64-bit hashes and equal sets by 128 bits of sums of them.

Defined cases: texts that are null or have no words have an empty set and link with nothing, not even each other;
rows that repeat a doc_id are one document, which links what any of its texts links; rows without an id get the
component of equal sets that have one (null otherwise) and make no links; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as k
from .common import by_bucket, dealt, stored, table
from .components import components

SHINGLE, PERCENT = 3, 90
LOW = 2
#: Entries that are sorted at once in a task, and shingles of all sets for each group of buckets.
FLUSH, GROUP = 1 << 21, 1 << 22
#: Sets and bytes of sketches of a block.
BLOCK, BLOCK_BYTES = 1024, 1 << 24
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Bands:
    """Bands of set sizes, the bits that may differ in each family, and the words of its sketches."""

    def __init__(self, percent: int = PERCENT, largest: int = 1 << 40):
        first, growth = [1], 1.125 * 100 / percent
        while first[-1] <= largest:
            first.append(max(first[-1] + 1, int(first[-1] * growth)))
        self.percent, self.first = percent, np.array(first, np.int64)
        top = self.first[1:] - 1
        self.top = np.append(top, np.iinfo(np.int32).max * 1024)
        d = (100 - percent) * (self.top + self.top * 100 // percent) // (100 + percent)
        self.spare = (d >= 12) + (d >= 24) + d // 40
        self.words = np.where(d > 0, d + 1 + self.spare, 0)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, n, "right") - 1

    def widths(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Band of each size, words in its family and words in the family below (0 for those that cannot link into it)."""
        band = self.of(np.maximum(n, 1))
        below = np.maximum(band - 1, 0)
        guest = (band > 0) & (n * self.percent <= 100 * self.top[below])
        return band, np.where(n > 0, self.words[band], 0), np.where(guest & (n > 0), self.words[below], 0)

    def near(self, differing: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether so many differing shingles of sets of ``sizes`` in all still make a link."""
        return differing * (100 + self.percent) <= (100 - self.percent) * sizes


def shingle_sets(buf: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text of a chunk, ascending, and where each text's begin."""
    low = _LOWER[buf]
    starts, ends, woff = k.words(low, off)
    words = k.word_hashes(low, starts, ends)
    at, place = k.window_starts(woff, shingle)
    runs = k.window_hashes(words, shingle)[at] if len(at) else np.zeros(0, np.uint64)
    count = np.diff(woff)
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        whole = np.array([k.mix(words[woff[i] : woff[i + 1]] * k._PLACE[: count[i]] + U(count[i])).sum(dtype=np.uint64) for i in short], np.uint64)
        runs = np.insert(runs, place[short], whole)
        place = place + np.concatenate(([0], np.cumsum((count > 0) & (count < shingle))))
    for a, b in zip(place[:-1].tolist(), place[1:].tolist()):
        runs[a:b].sort()
    new = np.ones(len(runs), bool)
    new[1:] = runs[1:] != runs[:-1]
    new[place[:-1][np.diff(place) > 0]] = True
    return runs[new], np.concatenate(([0], np.cumsum(new)))[place]


def sketches(h: np.ndarray, off: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity sketches of ``width[i]`` words for the sets ``h[off[i]:off[i + 1]]``, the XOR of 32 bits of the hashes at each place, and where each sketch begins."""
    at = np.concatenate(([0], np.cumsum(width)))
    words, cells = np.zeros(at[-1], np.uint64), np.zeros(at[-1], np.uint32)
    size = np.diff(off) * (width > 0)
    if size.sum():
        own = h[np.repeat(width > 0, np.diff(off))]
        # hashes ascend in a set, and so do their places
        place = ((own >> U(32)) * np.repeat(width, size).astype(np.uint64) >> U(32)).astype(np.int64) + np.repeat(at[:-1], size)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        words[place[first]] = np.bitwise_xor.reduceat(U(1) << (own & U(63)), first)
        cells[place[first]] = np.bitwise_xor.reduceat((own >> U(6)).astype(np.uint32), first)
    return words, cells, at


def prints(docs: DataFrame, bands: Bands, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, n, k1, k2, sketch, cells): size, 128 bits of the set, its sketches in both families, and their cells."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, k1, k2, blobs = [], [], [], ([], [])
            for _, _, b, o in k.chunks(*k.utf8(batch.column(1))):
                h, off = shingle_sets(b, o, shingle)
                size = np.diff(off)
                n.append(size)
                for keys, salt in ((k1, 0x243F6A8885A308D3), (k2, 0x13198A2E03707344)):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(k.mix(h ^ U(salt)), dtype=np.uint64)))
                    keys.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
                _, own, below = bands.widths(size)
                *ours, at = sketches(h, off, own)
                *lower, lower_at = sketches(h, off, below)
                spans = list(zip(at[:-1].tolist(), at[1:].tolist(), lower_at[:-1].tolist(), lower_at[1:].tolist()))
                for out, x, y in zip(blobs, ours, lower):
                    x, y, w = memoryview(x.view(np.uint8)), memoryview(y.view(np.uint8)), x.itemsize
                    out += [bytes(x[w * a : w * b]) + bytes(y[w * c : w * d]) for a, b, c, d in spans]
            columns = [batch.column(0), *(pa.array(np.concatenate(x)) for x in (n, k1, k2)), *(pa.array(x, pa.binary()) for x in blobs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k1", "k2", "sketch", "cells"])

    schema = "doc_id bigint, n bigint, k1 bigint, k2 bigint, sketch binary, cells binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _star(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys and the least id of each; distinct pairs (least id, other id) of equal keys."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(ids, first) if len(first) else ids
    centre = np.repeat(least, np.diff(np.append(first, len(keys))))
    other = np.flatnonzero(centre != ids)
    a, b = centre[other], ids[other]
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return keys[first], least, a[new], b[new]


def _joined(column: pa.Array, kind: type) -> np.ndarray:
    """The bytes of all rows of a binary column as numbers."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind) if off[-1] > off[0] else np.zeros(0, kind)


def candidates(nodes: DataFrame, bands: Bands, groups: int) -> DataFrame:
    """Pairs (a, b), a < b, that connect all sets of a bucket; ``nodes`` has (node, n, sketch, cells)."""

    def entries(ids, n, words, cells):
        band, own, below = bands.widths(n)
        width = np.stack([own, below], 1).ravel()
        family = np.stack([band, band - 1], 1).ravel()
        place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        owner = np.repeat(np.arange(len(width)), width)
        low = np.bitwise_count(words) < LOW
        all_low = np.bincount(owner[low], minlength=len(width))
        use = ~low | (all_low > bands.spare[family])[owner]
        place, owner = place[use].astype(np.uint64), owner[use]
        key = k.mix(k.mix(k.mix(words[use] + place * U(0x9E3779B97F4A7C15)) + cells[use]) + (family[owner] + 1).astype(np.uint64) * U(0xD6E8FEB86659FD93))
        return key, ids[owner // 2]

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            words, cells = _joined(batch.column(2), np.uint64), _joined(batch.column(3), np.uint32)
            _, own, below = bands.widths(n)
            ends = np.cumsum(own + below)
            i = 0
            while i < len(ids):
                begin = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, begin + FLUSH, "right")))
                keys, least, a, b = _star(*entries(ids[i:j], n[i:j], words[begin : ends[j - 1]], cells[begin : ends[j - 1]]))
                yield from dealt((keys % U(groups)).astype(np.int64), {"x": keys, "y": least})
                yield from dealt(-1 - b % groups, {"x": a, "y": b})
                i = j

    def compare(bucket, held):
        x, y = b"".join(held["x"]), b"".join(held["y"])
        if bucket < 0:
            a, b = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
        else:
            _, _, a, b = _star(np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return by_bucket(nodes.mapInArrow(spread, "bucket bigint, x binary, y binary"), compare, "a bigint, b bigint").distinct()


def _parts(bands: Bands, n_a, n_b, sketch_a: list, sketch_b: list) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """The words of both sets of each pair in the family of the smaller one; None if they share none."""
    out = []
    band_a, own_a, below_a = bands.widths(n_a)
    band_b, own_b, below_b = bands.widths(n_b)
    for i in range(len(n_a)):
        f = min(band_a[i], band_b[i])
        a, b = (np.frombuffer(s, np.uint64)[own if band > f else 0 :][: bands.words[f]] for s, band, own in ((sketch_a[i], band_a[i], own_a[i]), (sketch_b[i], band_b[i], own_b[i])))
        out.append((a, b) if len(a) == len(b) == bands.words[f] and len(a) and max(band_a[i], band_b[i]) <= f + 1 else None)
    return out


def plausible(pairs: DataFrame, members: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches do not rule out a link."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 4))
            parts = _parts(bands, n_a, n_b, batch.column(3).to_pylist(), batch.column(5).to_pylist())
            far = np.array([np.iinfo(np.int32).max if p is None else int(np.bitwise_count(p[0] ^ p[1]).sum(dtype=np.int64)) for p in parts])
            keep = bands.near(np.maximum(far, np.abs(n_a - n_b)), n_a + n_b)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    own = members.select("node", "n", "sketch")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
    both = both.join(own.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
    return both.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, texts: DataFrame, bands: Bands, shingle: int = SHINGLE) -> DataFrame:
    """(a, b, linked): pairs of nodes, judged on their whole texts."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            z = [batch.column(i).to_pylist() for i in (2, 3)]
            number = {t: i for i, t in enumerate(dict.fromkeys(z[0] + z[1]))}
            raw = [zstandard.decompress(t) for t in number]
            sets = []
            for _, _, b, o in k.chunks(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw])))):
                h, off = shingle_sets(b, o, shingle)
                sets += np.split(h, off[1:-1])
            linked = []
            for a, b in zip(*z):
                a, b = sorted((sets[number[a]], sets[number[b]]), key=len)
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
                linked.append(len(a) > 0 and 100 * both >= bands.percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["a", "b", "linked"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("z_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("z").alias("z_b")), "b")
    found = both.select("a", "b", "z_a", "z_b").mapInArrow(run, "a bigint, b bigint, linked boolean")
    return found.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def _packed(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, z): compressed texts of the documents that are nodes, each once."""

    def run(batches):
        press = zstandard.ZstdCompressor(1)
        for batch in batches:
            z = [press.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["node", "z"])

    small = docs.select(F.col("doc_id").cast("long").alias("node"), "text").filter("node is not null").mapInArrow(run, "node bigint, z binary")
    return small.join(nodes.select("node").distinct(), "node").distinct()


def across(members: DataFrame, bands: Bands, most: int, block: int = BLOCK) -> DataFrame:
    """(a, b, more): plausible pairs of one group but of different labels, the ``most`` nearest ones of each label.

    ``members`` has (group, node, n, sketch, label). Blocks hold sets of one band, and of one label where it
    fills a block, so that no two blocks of one label are compared. ``more`` tells that a label had others.
    """
    sizes = F.array(*(F.lit(int(x)) for x in bands.first))
    rows = members.withColumn("band", F.size(F.filter(sizes, lambda x: x <= F.col("n"))) - 1)
    room = np.maximum(1, np.minimum(block, BLOCK_BYTES // (8 * np.maximum(bands.words, 1)))).tolist()
    rows = rows.withColumn("room", F.element_at(F.array(*map(F.lit, room)), F.col("band") + 1))
    many = rows.groupBy("group", "band", "room", "label").agg(F.count("*").alias("c"))
    small = many.filter("c < room").groupBy("group", "band").agg(F.sum("c").alias("rest"))
    placed = rows.join(many.drop("room"), ["group", "band", "label"]).join(small, ["group", "band"], "left").withColumn("big", F.expr("if(c < room, null, label)"))
    placed = placed.withColumn("cut", F.expr("if(big is null, pmod(xxhash64(label, 1), ceil(rest / room)), pmod(xxhash64(node, 1), ceil(c / room)))"))
    placed = stored(placed.withColumn("block", F.expr("xxhash64(group, band, big, cut)")).select("group", "band", "big", "block", "node", "n", "label", "sketch"), "blocks")
    blocks = placed.select("group", "band", "big", "block").distinct()
    other = blocks.select("group", *(F.col(c).alias(f"{c}_2") for c in ("band", "big", "block")))
    near = (F.col("band_2") == F.col("band")) & (F.col("block_2") >= F.col("block")) | (F.col("band_2") == F.col("band") + 1)
    pairs = blocks.join(other, "group").filter(near & ~F.coalesce(F.col("big") == F.col("big_2"), F.lit(False)))
    pairs = stored(pairs.select("block", "block_2", F.expr("xxhash64(block, block_2)").alias("bucket")), "pairs")
    sides = [
        placed.join(pairs.select("block", "bucket"), "block").withColumn("side", F.lit(0)),
        placed.join(pairs.filter("block <> block_2").select(F.col("block_2").alias("block"), "bucket"), "block").withColumn("side", F.lit(1)),
    ]
    held = sides[0].unionByName(sides[1]).select("bucket", "side", "node", "n", "label", "sketch")

    def compare(bucket, held):
        side, node, n, label = (np.array(held[c], np.int64) for c in ("side", "node", "n", "label"))
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        band, own, below = bands.widths(n)
        f = int(band[left[0]])
        width = int(bands.words[f])
        right = right[(band[right] == f) | (below[right] == width)]
        get = lambda i: np.frombuffer(held["sketch"][i], np.uint64)[own[i] if band[i] > f else 0 :][:width]
        if not width or not len(right):
            return
        words = np.stack([get(i) for i in right])
        found = []
        for i in left:
            some = np.flatnonzero((label[right] != label[i]) & bands.near(np.abs(n[right] - n[i]), n[right] + n[i]))
            if len(some):
                far = np.bitwise_count(words[some] ^ get(i)).sum(1, dtype=np.int64)
                keep = bands.near(far, n[right[some]] + n[i])
                margin = (far[keep] << 20) // (n[right[some[keep]]] + n[i])
                found.append(np.stack([np.full(keep.sum(), i), right[some[keep]], margin]))
        if not found:
            return
        i, j, margin = np.concatenate(found, 1)
        take, more = np.zeros(len(i), bool), np.zeros(len(i), bool)
        for end in (i, j):
            order = np.lexsort((node[j], node[i], margin, label[end]))
            own_label = label[end][order]
            first = np.flatnonzero(np.concatenate(([True], own_label[1:] != own_label[:-1])))
            size = np.diff(np.append(first, len(order)))
            rank = np.arange(len(order)) - np.repeat(first, size)
            take[order[rank < most]] = True
            more[order] |= np.repeat(size > most, size)
        a, b = np.minimum(node[i], node[j])[take], np.maximum(node[i], node[j])[take]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(more[take])], ["a", "b", "more"])

    return by_bucket(held, compare, "a bigint, b bigint, more boolean").groupBy("a", "b").agg(F.max("more").alias("more")).filter("a < b")


def links(docs: DataFrame, nodes: DataFrame, bands: Bands, shingle: int = SHINGLE, most: int = 32, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between nodes (node, n, sketch, cells) whose components are those of all links."""
    nodes = nodes.filter("node is not null")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    found = stored(candidates(nodes, bands, max(1, -(-total // GROUP))), "candidates")
    groups = components(found).select("node", F.col("component").alias("group"))
    members = stored(nodes.drop("cells").join(groups, "node"), "members")
    texts = stored(_packed(docs, members), "texts")
    tested = stored(verified(plausible(found, members, bands), texts, bands, shingle), "tested")
    while True:
        linked = tested.filter("linked").select("a", "b")
        labels = members.select("node").distinct().join(components(linked), "node", "left").select("node", F.coalesce("component", "node").alias("label"))
        labelled = stored(members.join(labels, "node"), "labelled")
        open_groups = stored(labelled.groupBy("group").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("group"), "open")
        if not open_groups.take(1):
            return linked
        rest = stored(across(labelled.join(open_groups, "group"), bands, most, block), "across")
        new = rest.select("a", "b").join(tested, ["a", "b"], "left_anti")
        tested = tested.unionByName(stored(verified(new, texts, bands, shingle), "tested"))
        if not rest.filter("more").take(1):  # every plausible pair across labels is verified now
            return tested.filter("linked").select("a", "b")
        most *= 4


def similar_sets(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, most: int = 32, block: int = BLOCK) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id)."""
    bands = Bands(percent)
    found = stored(prints(docs, bands, shingle), "prints")
    keys = ["n", "k1", "k2"]
    classes = stored(found.filter("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("sketch", "cells"))), "classes")
    rows = stored(found.select("doc_id", *keys).join(classes.select(*keys, "node"), keys, "left").select("doc_id", "n", "node"), "rows")
    # texts of one doc_id belong together
    ends = rows.filter("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("top"))
    several = ends.filter("a < top").join(rows.select("doc_id", F.col("node").alias("b")), "doc_id").filter("a < b").select("a", "b")
    edges = links(docs, classes.select("node", "n", "sketch", "cells"), bands, shingle, most, block).unionByName(several)
    out = rows.join(components(edges), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.expr("if(n = 0, doc_id, coalesce(component, node))").alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) AS p
  JOIN n AS na ON na.doc_id = p.a JOIN n AS nb ON nb.doc_id = p.b WHERE 100 * common >= 90 * (na.n + nb.n - common)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM documents AS d LEFT JOIN n USING (doc_id)
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) AS r ON r.a = d.doc_id
"""
