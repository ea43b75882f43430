"""Operator 10: substring dedup by prefix-partitioned suffix trees.

A window is ``min_words`` consecutive words of one document. It is a repeat if its words also stand in a
document with a smaller doc_id; every word that a repeat covers is removed.

The trees are sparse: of a window's ``SHORT``-word runs the one with the least hash is its anchor, the same
in every copy, and only suffixes that start at an anchor are kept, each with the words before it that
windows of this anchor reach. A window is then the last l words before an anchor and the first
``min_words`` - l words of the suffix there, so two suffixes share it just if their common prefix has at
least ``min_words`` - l words and their words before the anchor agree in the last l.

1. Documents are packed, compressed, into chunks of about ``CHUNK_BYTES`` of text and stored.
2. Each chunk sends the distinct hashes of its anchors (about a fifth of its words) and gets back those
   that other chunks have too, with a mark on those that more than ``hot`` chunks have. Hashes decide
   here no more than which suffixes can share anything.
3. Suffixes at such anchors are sent, words and all, to subtrees by a prefix: that of ``SHORT`` words, and
   where it is marked, by the longest that matters, ``min_words`` words from the window's first on, so no
   frequent phrase gathers all its suffixes. There are as many subtrees as memory asks for. Equal ones of
   a chunk are one before the shuffle, with the least doc_id: a passage that a third of all documents
   share sends one suffix a chunk (and a chunk for each ``CHUNK_BYTES`` of all text to one subtree).
4. A subtree sorts its suffixes word by word; common prefixes of neighbours give its internal nodes at
   each depth, and the same over the words before the anchor, backwards, gives those of the left tree.
   Pairs of a node and a left node whose depths make ``min_words`` are the deep nodes. Each tells the
   suffixes below it but those of its least document which of their windows are repeats; what of them
   follows each other in a document joins to its maximal repeats.
5. Each chunk adds the deep nodes within itself by the same tree, marks its windows, and cuts.

Both joins with the chunks read one shuffle of them, by the chunk's number. Words are compared by 64-bit
hashes of the words themselves; the hashes of step 2 have 40 bits.

Defined cases: a null text has no words; documents shorter than a window keep all words; rows with the
same doc_id do not remove from each other; a null doc_id counts as greater than any other; an empty
table gives no rows; other columns are carried by :func:`cut_repeats` and else ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as k
from .common import by_bucket, dealt, stored, table

MIN_WORDS, SHORT = 13, 5
CHUNK_BYTES = 1 << 21
#: Chunks whose distinct anchors make about one group of step 2, and whose suffixes make about one subtree.
CHUNKS_PER_GROUP, CHUNKS_PER_TREE = 16, 6
#: Anchors of more chunks than this are split by longer prefixes.
HOT = 1024
NO_ID = np.iinfo(np.int64).max
U = np.uint64
_LOW40 = U((1 << 40) - 1)
_CHUNK = "chunk bigint, ids binary, offsets binary, body binary, rest binary"


class _Words:
    """Words of a chunk, its windows (``at``: first words) and the suffixes at their anchors.

    Suffix ``i`` starts at word ``q[i]`` and has the windows whose first words are ``s1[i]`` to ``s2[i]``.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, ids: np.ndarray, n: int):
        self.buf, self.n, self.short = buf, n, min(SHORT, n)
        self.starts, self.ends, self.woff = k.words(buf, off)
        self.h = k.word_hashes(buf, self.starts, self.ends)
        self.at, self.place = k.window_starts(self.woff, n)
        runs = k.window_hashes(self.h, self.short)
        # the leftmost least hash of the runs in each window
        reach = n - self.short + 1
        if len(self.at):
            anchor = np.lib.stride_tricks.sliding_window_view(runs, reach).argmin(1)[self.at] + self.at
        else:
            anchor = self.at
        new = np.concatenate(([True], anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.suffix = np.cumsum(new) - 1
        self.q, self.s1 = anchor[first], self.at[first]
        self.s2 = self.at[np.append(first[1:], len(self.at)) - 1] if len(first) else self.s1
        self.least = runs[self.q] if len(first) else np.zeros(0, np.uint64)
        self.doc = ids[np.searchsorted(self.woff, self.s1, "right") - 1] if len(first) else ids[:0]

    def keys(self) -> np.ndarray:
        """A hash of each suffix's words and of where among them its anchor stands."""
        power, inverse = k._powers(len(self.h))
        total = np.zeros(len(self.h) + 1, np.uint64)
        np.cumsum(self.h * power, out=total[1:])
        return k.mix((total[self.s2 + self.n] - total[self.s1]) * inverse[self.s1] + (self.q - self.s1).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def _unpack(ids: bytes, offsets: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.decompress(body), np.uint8), np.frombuffer(offsets, np.int64), np.frombuffer(ids, np.int64)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for ``size[i]`` numbers each."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def deep_windows(h: np.ndarray, off: np.ndarray, left: np.ndarray, doc: np.ndarray, n: int, short: int) -> np.ndarray:
    """For each suffix a mask: bit l tells that its window with l words before the anchor is in a smaller document too.

    Suffix ``i`` has the words ``h[off[i]:off[i + 1]]`` (hashes); its anchor is the one after ``left[i]`` of them.
    """
    size, reach = np.diff(off), n - short
    right = size - left
    mask = np.zeros(len(size), np.uint16 if reach < 16 else np.uint64)
    if len(size) < 2:
        return mask

    def levels(first: np.ndarray, step: int, depth: int, have: np.ndarray) -> np.ndarray:
        """Node of each suffix at each depth up to ``depth`` of the tree of the words from ``first`` on."""
        words = np.zeros((depth, len(size)), np.uint64)
        for j in range(depth):
            some = np.flatnonzero(have > j)
            words[j, some] = h[first[some] + step * j]
        order = np.lexsort(words[::-1]) if depth else np.arange(len(size))
        nodes, common = np.zeros((depth + 1, len(size)), np.int32), np.ones(len(size) - 1, bool)
        for j in range(depth):
            sorted_ = words[j][order]
            common &= sorted_[1:] == sorted_[:-1]  # neighbours whose common prefix is longer than j
            nodes[j + 1, order] = np.concatenate(([0], np.cumsum(~common)))
        return nodes

    below = levels(off[:-1] + left, 1, n, right)
    before = levels(off[:-1] + left - 1, -1, reach, left)
    for l in range(reach + 1):  # noqa: E741
        some = np.flatnonzero((left >= l) & (right >= n - l))
        if len(some) < 2:
            continue
        deep = below[n - l, some].astype(np.int64) << 32 | before[l, some]
        order = np.lexsort((doc[some], deep))
        deep, own = deep[order], doc[some][order]
        new = np.concatenate(([True], deep[1:] != deep[:-1]))
        least = own[np.flatnonzero(new)][np.cumsum(new) - 1]
        mask[some[order[own > least]]] |= mask.dtype.type(1 << l)
    return mask


def pack(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Stored chunks of ``docs``; see step 1. ``rest`` has the other columns as Arrow rows."""
    names = docs.columns
    at_id, at_text = names.index("doc_id"), names.index("text")

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, off = k.utf8(batch.column(at_text))
            ids = batch.column(at_id).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            other = batch.drop_columns(["text"]) if len(names) > 1 else batch
            for i, j, b, o in k.chunks(buf, off, CHUNK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, other.schema) as out:
                    out.write_batch(other.slice(i, j - i))
                press = zstandard.ZstdCompressor(9)
                row = [ids[i:j].tobytes(), o.tobytes(), press.compress(b.tobytes()), press.compress(sink.getvalue().to_pybytes())]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], ["chunk", "ids", "offsets", "body", "rest"])
                number += 1

    return stored(docs.mapInArrow(run, _CHUNK), "chunks")


def _shared_anchors(chunks: DataFrame, min_words: int, groups: int, hot: int) -> DataFrame:
    """(chunk, anchors): those of a chunk's anchors that other chunks have, in six bytes each: 40 bits and the mark (step 2)."""

    def six(low: np.ndarray, mark: np.ndarray) -> np.ndarray:
        out = np.ascontiguousarray(low).view(np.uint8).reshape(-1, 8)[:, :6].copy()
        out[:, 5] = mark
        return out

    def send(batches):
        for batch in batches:
            for chunk, ids, offsets, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                least = np.unique(_Words(*_unpack(ids, offsets, body), min_words).least & _LOW40)
                yield from dealt((k.mix(least.copy()) % U(groups)).astype(np.int64), {"h": six(least, 0)[:, :5]}, {"chunk": chunk})

    def meet(bucket, held):
        size = [len(x) // 5 for x in held["h"]]
        h = np.zeros((sum(size), 8), np.uint8)
        h[:, :5] = np.frombuffer(b"".join(held["h"]), np.uint8).reshape(-1, 5)
        h, chunk = h.view(np.uint64).ravel(), np.repeat(np.array(held["chunk"], np.int64), size)
        order = np.argsort(h, kind="stable")
        h, chunk = h[order], chunk[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(first, len(h)))
        count = np.repeat(count, count)
        yield from dealt(chunk[count > 1], {"h": six(h[count > 1], count[count > 1] > hot)})

    sent = chunks.select("chunk", "ids", "offsets", "body").mapInArrow(send, "bucket bigint, h binary, chunk bigint")
    back = by_bucket(sent, meet, "bucket bigint, h binary")
    return back.groupBy(F.col("bucket").alias("chunk")).agg(F.collect_list("h").alias("anchors"))


def _found(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``x`` are among the sorted values, and where."""
    if not len(sorted_values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x, at


def _told(base: DataFrame, anchors: DataFrame, min_words: int, groups: int) -> DataFrame:
    """(chunk, told): suffixes of a chunk, by their keys, and which of their windows smaller documents elsewhere have (3 and 4)."""

    def send(batches):
        for batch in batches:
            for chunk, ids, offsets, body, anchors in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))):
                if not anchors:
                    continue
                w = _Words(*_unpack(ids, offsets, body), min_words)
                raw = np.frombuffer(b"".join(anchors), np.uint8).reshape(-1, 6)
                known = np.zeros((len(raw), 8), np.uint8)
                known[:, :5] = raw[:, :5]
                known = known.view(np.uint64).ravel()
                order = np.argsort(known)
                yes, place = _found(known[order], w.least & _LOW40)
                which = np.flatnonzero(yes)
                marked = raw[order[place[which]], 5] > 0
                # one of equal suffixes, with their least document
                key, doc = w.keys()[which], w.doc[which]
                order = np.lexsort((doc, key))
                order = order[np.concatenate(([True], np.diff(key[order]) != 0))] if len(order) else order
                which, key, doc, marked = which[order], key[order], doc[order], marked[order]
                s1, end, q, shift = w.s1[which], w.s2[which] + min_words, w.q[which], np.zeros(len(which), np.int64)
                bucket = (k.mix(w.least[which] + U(1)) % U(groups)).astype(np.int64)
                if marked.any():
                    # each window becomes a suffix of its own that starts with its first word
                    lone, many = ~marked, np.flatnonzero(marked)
                    count = (end - s1 - min_words + 1)[many]
                    from_ = np.repeat(many, count)
                    begin = _spread(s1[many], count)
                    long = (k.mix(k.window_hashes(w.h, min_words)[begin] + U(1)) % U(groups)).astype(np.int64)
                    shift = np.concatenate([shift[lone], q[from_] - begin])
                    key, doc = np.concatenate([key[lone], key[from_]]), np.concatenate([doc[lone], doc[from_]])
                    bucket = np.concatenate([bucket[lone], groups + long])
                    s1, end, q = np.concatenate([s1[lone], begin]), np.concatenate([end[lone], begin + min_words]), np.concatenate([q[lone], begin])
                order = np.argsort(bucket, kind="stable")
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)])) if len(order) else [0]
                press = zstandard.ZstdCompressor(3)
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    own = order[a:b]
                    which_words = _spread(s1[own], (end - s1)[own])
                    text, _ = _joined(w.buf, w.starts[which_words], w.ends[which_words])
                    small = np.stack([q[own] - s1[own], (end - s1)[own], shift[own]], 1).astype(np.uint8 if min_words < 100 else np.uint16)
                    rows.append((int(bucket[own[0]]), key[own].tobytes(), doc[own].tobytes(), small.tobytes(), press.compress(text.tobytes()), chunk))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4, pa.int64()))], ["bucket", "key", "d", "small", "text", "chunk"])

    def subtree(bucket, held):
        key, d = (np.frombuffer(b"".join(held[c]), t) for c, t in (("key", np.uint64), ("d", np.int64)))
        left, size, shift = np.frombuffer(b"".join(held["small"]), np.uint8 if min_words < 100 else np.uint16).reshape(-1, 3).astype(np.int64).T
        hashes = []
        for text in held["text"]:
            text = np.frombuffer(zstandard.decompress(text), np.uint8)
            starts, ends, _ = k.words(text, np.array([0, len(text)]))
            hashes.append(k.word_hashes(text, starts, ends))
        off = np.concatenate(([0], np.cumsum(size)))
        mask = deep_windows(np.concatenate(hashes), off, left, d, min_words, min_words if bucket >= groups else min(SHORT, min_words))
        chunk = np.repeat(np.array(held["chunk"], np.int64), [len(x) // 8 for x in held["key"]])
        tell = np.flatnonzero(mask)
        yield from dealt(chunk[tell], {"key": key[tell], "mask": mask[tell].astype(np.uint64) << shift[tell].astype(np.uint64)})

    # the same columns and kind of join as the last join, so that both read one shuffle of the chunks
    ready = base.join(anchors, "chunk", "left").select(*base.columns, "anchors")
    sent = ready.mapInArrow(send, "bucket bigint, key binary, d binary, small binary, text binary, chunk bigint")
    back = by_bucket(sent, subtree, "bucket bigint, key binary, mask binary")
    return back.groupBy(F.col("bucket").alias("chunk")).agg(F.collect_list(F.struct("key", "mask")).alias("told"))


def _repeats(w: _Words, told: list[dict]) -> np.ndarray:
    """Which windows of a chunk are repeats."""
    mask = np.zeros(len(w.q), np.uint64)
    if told:
        key, said = (np.frombuffer(b"".join(t[c] for t in told), np.uint64) for c in ("key", "mask"))
        order = np.argsort(key, kind="stable")
        key, said = key[order], said[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        said = np.bitwise_or.reduceat(said, first)
        yes, place = _found(key[first], w.keys())
        mask[yes] = said[place[yes]]
    # within the chunk: suffixes at anchors that two of its documents have
    order = np.lexsort((w.doc, w.least))
    anchor, doc = w.least[order], w.doc[order]
    two = np.unique(anchor[1:][(anchor[1:] == anchor[:-1]) & (doc[1:] != doc[:-1])])
    which = np.flatnonzero(_found(two, w.least)[0])
    if len(which):
        size = w.s2[which] + w.n - w.s1[which]
        off = np.concatenate(([0], np.cumsum(size)))
        mask[which] |= deep_windows(w.h[_spread(w.s1[which], size)], off, (w.q - w.s1)[which], w.doc[which], w.n, w.short)
    return (mask[w.suffix] >> (w.q[w.suffix] - w.at).astype(np.uint64) & U(1)) > 0


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words joined by single spaces, and where each begins."""
    size = ends - starts
    to = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    source = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    out[np.repeat(to - starts, size) + source] = buf[source]
    return out, to


def _cut(docs: DataFrame, min_words: int, hot: int, finish, schema) -> DataFrame:
    """Runs all steps; ``finish(words, offsets, gone, ids, rest)`` makes the rows of a chunk."""
    if min_words - min(SHORT, min_words) > 63:
        raise ValueError("windows of at most 68 words")
    chunks = pack(docs.select(*[F.col(c) for c in docs.columns]), min_words)
    n = chunks.count()
    spark = docs.sparkSession
    parts = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    base = chunks.select("chunk", "ids", "offsets", "body", "rest").repartition(parts, "chunk")
    anchors = _shared_anchors(chunks, min_words, -(-n // CHUNKS_PER_GROUP) or 1, hot)
    told = _told(base, anchors, min_words, -(-n // CHUNKS_PER_TREE) or 1)

    def run(batches):
        for batch in batches:
            for ids, offsets, body, rest, told in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                buf, off, ids = _unpack(ids, offsets, body)
                w = _Words(buf, off, ids, min_words)
                repeats = _repeats(w, told or [])
                gone = k.covered(w.at[repeats], min_words, len(w.h)) if repeats.any() else np.zeros(len(w.h), bool)
                yield finish(w, off, gone, ids, rest)

    return base.join(told, "chunk", "left").select(*base.columns, "told").mapInArrow(run, schema)


def _digest(w: _Words, off, gone, ids, rest) -> pa.RecordBatch:
    keep = ~gone
    out, _ = _joined(w.buf, w.starts[keep], w.ends[keep])
    size = (w.ends - w.starts + 1) * keep
    end = np.concatenate(([0], np.cumsum(size)))[w.woff]
    raw = memoryview(out)
    sha = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(end[:-1], end[1:])]
    removed = k.segment_sums(gone, w.woff)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, mask=ids == NO_ID), pa.array(np.diff(w.woff)), pa.array(removed), pa.array(sha)],
        ["doc_id", "n_words", "n_removed", "kept_sha256"],
    )


def repeat_digests(docs: DataFrame, min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _cut(ids, min_words, hot, _digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def _spans(w: _Words, off, gone, ids, rest) -> pa.RecordBatch:
    edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a run that crosses into the next text is two spans
    cut = np.unique(np.concatenate([first, w.woff[1:-1][np.isin(w.woff[1:-1], np.flatnonzero(gone))]])).astype(np.int64)
    stop = np.minimum(end[np.searchsorted(end, cut, "right")], w.woff[np.searchsorted(w.woff, cut, "right")]) if len(cut) else cut
    text = np.searchsorted(w.woff, cut, "right") - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[text], mask=ids[text] == NO_ID), pa.array(cut - w.woff[text]), pa.array(stop - cut)], ["doc_id", "first_word", "n_words"]
    )


def repeat_spans(docs: DataFrame, min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, first_word, n_words): the maximal runs of words that repeats cover."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _cut(ids, min_words, hot, _spans, "doc_id bigint, first_word bigint, n_words bigint")


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """``docs`` with repeats cut from the texts, all columns as they are but ``n_chars`` counted anew.

    A removed word goes with the white space after it; texts without repeats stay byte by byte.
    """
    schema, names = docs.schema, docs.columns

    def finish(w: _Words, off, gone, ids, rest):
        with pa.ipc.open_stream(zstandard.decompress(rest)) as stream:
            other = stream.read_all().combine_chunks()
        edge = np.append(w.starts[1:], len(w.buf))
        last = w.woff[1:][np.diff(w.woff) > 0] - 1
        edge[last] = off[1:][np.diff(w.woff) > 0]
        drop = np.zeros(len(w.buf) + 1, np.int8)
        drop[w.starts[gone]] += 1
        np.subtract.at(drop, edge[gone], 1)
        keep = np.cumsum(drop[:-1]) == 0
        size = np.concatenate(([0], np.cumsum(k.segment_sums(keep, off))))
        texts = pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(size.astype(np.int32).tobytes()), pa.py_buffer(w.buf[keep].tobytes())])
        cut = k.segment_sums(gone, w.woff) > 0
        columns = []
        for name in names:
            if name == "text":
                columns.append(texts)
                continue
            column = other[name].chunk(0) if other[name].num_chunks else pa.array([], other[name].type)
            if name == "n_chars":
                column = pa.compute.if_else(pa.array(cut), pa.compute.utf8_length(texts).cast(column.type), column)
            columns.append(column)
        return pa.RecordBatch.from_arrays(columns, names)

    import pyarrow.compute  # noqa: F401  pa.compute is used in finish

    return _cut(docs, min_words, hot, finish, schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))
