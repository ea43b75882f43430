"""Operator 2: SentencePiece encoding with seeded merge-dropout, and decoding.

Merge-type (BPE) models merge, again and again, the adjacent pair whose piece has the best score (the
leftmost of equals). With dropout each candidate merge - its text, the places where its left and
right part begin and end - is skipped if a keyed hash falls below ``dropout``; the hash decides once
for a candidate, so the agenda passes over it for good, and the same seed gives the same ids on every
machine. Pieces never join a space to what stands before it, so texts are cut before each run of
spaces, and each occurrence of a part has its own key by the seed, the document and the part's place:
equal words differ within a document, between documents and between seeds. What a part becomes depends
on no more than which of its candidates are skipped, so a worker remembers the candidates that any order
of merges can propose for a part, and the ids of a (part, skipped candidates).

Many parts are merged in step: symbols of all parts stand in one array, each round finds every part's
best candidate and merges it. Parts of over ``LONG`` characters go through a heap one by one.

Characters without a piece become byte pieces, as does a literal U+2581 (which would else
decode to a space), so decoding is lossless for every text.

Defined cases: a null or empty text has no ids and decodes to an empty text; a null doc_id is a key like
any other; repeated rows have equal ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as k
from .common import table
from .pretokens import Memory, hashes

MODEL, SEED, DROPOUT = "piece_bpe_32k.model", 42, 0.1
LONG = 96
ENCODE_CHARS = 2_000_000
#: Distinct parts whose candidates a worker remembers before it starts anew.
PLANS = 400_000
U = np.uint64
_NONE = np.iinfo(np.int64).max
_C = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))
_ALL = (1 << 64) - 1


def _mix1(x: int) -> int:
    x &= _ALL
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & _ALL
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & _ALL
    return x ^ x >> 33


class Pieces:
    """A merge-type model: the ids of characters, of bytes, and of each pair that may merge."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unit: dict[str, int] = {}
        self.byte = np.zeros(256, np.int64)
        raw = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                raw.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                self.unit[piece.replace("▁", " ")] = i
                raw.append(piece.replace("▁", " ").encode())
        self.size = np.array([len(r) for r in raw], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        order = sorted(set(self.unit.values()), key=lambda i: (-sp.get_score(i), i))
        rank = np.zeros(n, np.int64)
        score = None
        for place, i in enumerate(order):  # equal scores share a rank, so that the leftmost goes first
            if sp.get_score(i) != score:
                score, now = sp.get_score(i), place
            rank[i] = now
        pairs = sorted(
            (self.unit[p[:j]] * n + self.unit[p[j:]], i) for p, i in self.unit.items() for j in range(1, len(p)) if p[:j] in self.unit and p[j:] in self.unit
        )
        self.n = n
        self.pair = np.array([x for x, _ in pairs], np.int64)
        self.merged = np.array([i for _, i in pairs], np.int64)
        self.shift = U(64 - max(1, (len(pairs) * 16).bit_length()))
        at = self._slot(self.pair)
        self.slots = np.zeros(1 << 64 - int(self.shift), np.int32)
        self.slots[at] = np.arange(len(at))
        self.slots[np.flatnonzero(np.bincount(at, minlength=1) > 1)] = -1  # several pairs: found by search
        self.rank = rank
        self.by_pair = dict(pairs)
        self.char = np.full(0x110000, -1, np.int64)
        for p, i in self.unit.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[0x2581] = -1
        self.longest = max(map(len, self.unit), default=1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _C[0] >> self.shift).astype(np.int64)

    def candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; the rank is _NONE where nothing merges."""
        key = left * self.n + right
        at = self.slots[self._slot(key)]
        if len(more := np.flatnonzero(at < 0)):
            at[more] = np.minimum(np.searchsorted(self.pair, key[more]), len(self.pair) - 1)
        ok = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        merged = self.merged[at]
        return np.where(ok, self.rank[merged], _NONE), merged


def _skipped(key: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, bar: int) -> np.ndarray:
    h = key + a.astype(np.uint64) * _C[0] + b.astype(np.uint64) * _C[1] + c.astype(np.uint64) * _C[2]
    return k.mix(h) < U(bar)


def merge_one(model: Pieces, symbols: list[int], key: int, bar: int) -> list[tuple[int, int]]:
    """(id, first character) of one part's symbols after all merges, by an agenda."""
    n = len(symbols)
    ids, end = list(symbols), list(range(1, n + 1))
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    agenda: list[tuple[int, int, int, int, int]] = []
    c0, c1, c2 = map(int, _C)

    def propose(i: int) -> None:
        j = after[i]
        if j < 0 or ids[i] < 0 or ids[j] < 0:
            return
        found = model.by_pair.get(ids[i] * model.n + ids[j])
        if found is not None and not (bar and _mix1(key + i * c0 + j * c1 + end[j] * c2) < bar):
            heapq.heappush(agenda, (int(model.rank[found]), i, j, end[j], found))

    for i in range(n):
        propose(i)
    while agenda:
        _, i, j, stop, found = heapq.heappop(agenda)
        if end[i] != j or after[i] != j or end[j] != stop:
            continue  # one of its parts has merged since
        ids[i], end[i], after[i] = found, stop, after[j]
        end[j] = -1
        if after[i] >= 0:
            before[after[i]] = i
        propose(i)
        if before[i] >= 0:
            propose(before[i])
    out, i = [], 0
    while 0 <= i < n:
        out.append((ids[i], i))
        i = after[i]
    return out


def merge_many(model: Pieces, ids: np.ndarray, off: np.ndarray, keys: np.ndarray, bar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, first character and id of all symbols after merging parts in step."""
    part = np.repeat(np.arange(len(off) - 1), np.diff(off))
    start = np.arange(len(ids)) - np.repeat(off[:-1], np.diff(off))
    end = start + 1
    done = []

    def weigh(i: np.ndarray) -> None:
        """Candidates of the symbols at ``i`` with their right neighbours."""
        if not len(i):
            return
        j = np.minimum(i + 1, len(ids) - 1)
        r, m = model.candidates(ids[i], ids[j])
        r[(i + 1 >= len(ids)) | (part[j] != part[i])] = _NONE
        if bar:
            some = np.flatnonzero(r != _NONE)
            skip = _skipped(keys[part[i[some]]], start[i[some]], start[j[some]], end[j[some]], bar)
            r[some[skip]] = _NONE
        rank[i], into[i] = r, m

    rank, into = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    weigh(np.arange(len(ids)))
    while len(ids):
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        # the best rank, then the leftmost
        value = np.where(rank == _NONE, _NONE, rank << 24 | start)
        best = np.minimum.reduceat(value, first)
        open_ = best != _NONE
        size = np.diff(np.append(first, len(ids)))
        mine = np.repeat(open_, size)
        if not open_.all():
            done.append((part[~mine], start[~mine], ids[~mine]))
        hit = np.flatnonzero((value == np.repeat(best, size)) & mine)
        ids[hit], end[hit] = into[hit], end[hit + 1]
        keep = mine.copy()
        keep[hit + 1] = False
        to = np.cumsum(keep) - 1
        hit = to[hit]
        ids, part, start, end, rank, into = (x[keep] for x in (ids, part, start, end, rank, into))
        left = hit[hit > 0] - 1
        weigh(np.concatenate([hit, left[part[left] == part[left + 1]]]))
    if not done:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*done))


def proposals(model: Pieces, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All candidates that any order of merges can propose, part after part, and their number in each part.

    A candidate is its first character, the first of its right part and its end in seven bits each.
    """
    part = np.repeat(np.arange(len(off) - 1), np.diff(off))
    start = np.arange(len(ids)) - off[part]
    room = off[part + 1] - np.arange(len(ids))
    span = [ids, ids]  # span[n]: the piece of the n characters from each on, or a negative number
    owner, code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, model.longest + 1):
        here = np.flatnonzero(room >= n)
        if not len(here):
            break
        whole = np.full(len(ids), -1)
        for m in range(1, n):
            left, right = span[m][here], span[n - m][here + m]
            ok = (left >= 0) & (right >= 0)
            rank, merged = model.candidates(left[ok], right[ok])
            at, merged = here[ok][rank != _NONE], merged[rank != _NONE]
            whole[at] = merged
            owner.append(part[at])
            code.append(start[at] << 14 | start[at] + m << 7 | start[at] + n)
        span.append(whole)
    owner, code = np.concatenate(owner), np.concatenate(code)
    return code[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(off) - 1)


class Encoder:
    """Ids of texts with one seed and dropout; one for each worker."""

    def __init__(self, path: str, seed: int = SEED, dropout: float = DROPOUT):
        self.model = Pieces(path)
        self.bar = int(dropout * 2.0**64) if dropout else 0
        self.bar = min(self.bar, _ALL)
        self.seed = _mix1(seed + 1)
        self.memory, self.plans = Memory(), Memory(PLANS)

    def encode(self, texts: list[str], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the n + 1 places of the texts among them.

        ``docs`` has a number of each text's document.
        """
        size = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        off = np.concatenate(([0], np.cumsum(size)))
        cp = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le"), np.uint32)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        space = cp == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[off[:-1][size > 0]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(cp))
        h = hashes(cp, start, end)
        place = np.searchsorted(start, off)
        text = np.repeat(np.arange(len(texts)), np.diff(place))
        nth = (np.arange(len(start)) - place[text]).astype(np.uint64)
        key = k.mix(h ^ k.mix(k.mix(docs.astype(np.int64).view(np.uint64)[text] ^ U(self.seed)) + nth))

        def learn(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self._merge(cp, start[at], end[at], key[at])

        ids, to = self.memory.find(self._outcome(cp, start, end, h, key) if self.bar else h, learn)
        return ids, to[place]

    def _outcome(self, cp, start, end, h, key) -> np.ndarray:
        """Equal for occurrences of a part that skip the same candidates; that of a long part is its own."""
        out = key.copy()
        short = np.flatnonzero(end - start <= LONG)
        start, end, h, key = start[short], end[short], h[short], key[short]

        def learn(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            off = np.concatenate(([0], np.cumsum(end[at] - start[at])))
            source = np.arange(off[-1]) + np.repeat(start[at] - off[:-1], np.diff(off))
            return proposals(self.model, self.model.char[cp[source]], off)

        code, to = self.plans.find(h, learn)
        gone = np.flatnonzero(_skipped(np.repeat(key, np.diff(to)), code >> 14, code >> 7 & 127, code & 127, self.bar))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(k.mix(code[gone].astype(np.uint64) + U(1)))))
        at = np.searchsorted(gone, to)
        out[short] = k.mix(h ^ k.mix(total[at[1:]] - total[at[:-1]]))
        return out

    def _merge(self, cp, start, end, key) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        short = size <= LONG
        off = np.concatenate(([0], np.cumsum(size[short])))
        source = np.arange(off[-1]) + np.repeat(start[short] - off[:-1], size[short])
        part, first, ids = merge_many(self.model, self.model.char[cp[source]], off, key[short], self.bar)
        part = np.flatnonzero(short)[part]
        rows = [(part, first, ids)]
        for i in np.flatnonzero(~short).tolist():
            got = merge_one(self.model, self.model.char[cp[start[i] : end[i]]].tolist(), int(key[i]), self.bar)
            rows.append((np.full(len(got), i), np.array([a for _, a in got]), np.array([x for x, _ in got])))
        part, first, ids = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(part << 32 | first)
        part, first, ids = part[order], first[order], ids[order]
        if (lost := ids < 0).any():
            # a character without a piece becomes the pieces of its bytes
            raw = [self.model.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in cp[start[part[lost]] + first[lost]]]
            count = np.ones(len(ids), np.int64)
            count[lost] = [len(r) for r in raw]
            to = np.concatenate(([0], np.cumsum(count)))
            out = np.repeat(ids, count)
            out[np.repeat(lost, count)] = np.concatenate(raw)
            part, ids = np.repeat(part, count), out
        return ids, np.bincount(part, minlength=len(start))


def decode(model: Pieces, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other and their places; the space in front of each is dropped."""
    ids = ids.astype(np.int64)
    size = model.size[ids]
    to = np.concatenate(([0], np.cumsum(size)))
    out = model.raw[np.arange(to[-1]) + np.repeat(model.at[ids] - to[:-1], size)]
    off = to[place]
    some = off[1:] > off[:-1]
    keep = np.ones(len(out), bool)
    keep[off[:-1][some]] = False
    return out[keep], off - np.concatenate(([0], np.cumsum(some)))


@lru_cache(4)
def _encoder(path: str, seed: int, dropout: float) -> Encoder:
    return Encoder(path, seed, dropout)


def _path(model: str) -> str:
    import public_tokenizers

    return model if model.startswith("/") else public_tokenizers.path(model)


def _encoded(batches, model, seed, dropout):
    for batch in batches:
        texts, ids = [x or "" for x in batch.column(1).to_pylist()], batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
        part = np.cumsum([len(t) for t in texts]) // ENCODE_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        encoder = _encoder(_path(model), seed, dropout)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield encoder, batch.slice(a, b - a), texts[a:b], encoder.encode(texts[a:b], ids[a:b])


def encode(docs: DataFrame, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids array<int>)."""

    def run(batches):
        for _, batch, _, (ids, place) in _encoded(batches, model, seed, dropout):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
                off = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))))
                out, place = decode(_encoder(_path(model), 0, 0.0).model, lists.flatten().to_numpy(zero_copy_only=False), off)
                raw = out.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(place[:-1], place[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    import pyarrow.compute  # noqa: F401  pa.compute is used in run

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """doc_id, n_chars, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, lossless."""

    def run(batches):
        for encoder, batch, texts, (ids, place) in _encoded(batches, model, seed, dropout):
            raw, at = decode(encoder.model, ids, place)
            raw, four = memoryview(raw), memoryview(ids.astype("<u4")).cast("B")
            decoded = [raw[a:b] for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.diff(place)),
                 pa.array([zlib.crc32(four[4 * a : 4 * b]) for a, b in zip(place[:-1], place[1:])], pa.int64()),
                 pa.array([hashlib.sha256(d).hexdigest() for d in decoded]), pa.array([d == t.encode() for d, t in zip(decoded, texts)])],
                ["doc_id", "n_chars", "n_ids", "ids_crc32", "decoded_sha256", "lossless"],
            )

    schema = "doc_id bigint, n_chars bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op2_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
