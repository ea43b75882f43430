"""Operator 12: phrase collocations by vertical positional lists.

Texts (A-Z lower-cased) are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``;
all counts are by language. Words of a chunk of about ``CHUNK_BYTES`` of text get consecutive positions, with
a gap between pieces, so words that follow each other do so in one piece. For each phrase of j words that is
frequent in the whole corpus a chunk has the list of positions where it stands; level j + 1 merge-joins those
lists with the postings of the words that follow (positions whose next j words are frequent too, as a
frequent phrase has frequent parts only), and regroups them. A list's length is the exact count in its chunk.

1. Chunks are stored once, with a dictionary of their words.
2. At each level a chunk sends its distinct phrases, by 64-bit hashes, and their counts to buckets. A bucket adds
   them up and answers every chunk with one bit a phrase: frequent or not. One of the chunks that have a frequent
   phrase is told its count and gives its row: text, count, and the hashes of its parts.
3. What is left of a chunk (positions of frequent phrases, nothing else) is stored for the next level.
4. Scores are exact decimals, joined by hash: a * n against the counts of both parts of each cut. Phrases
   inside a longer one that is as frequent go: it is enough to look one word longer, as any phrase in between is
   at least as frequent as the longer one.

A chunk sends a phrase once, so no word or phrase is hot. Sums, joins and the rows of a language are Spark's;
a language's best rows are taken in shares of about ``SHARE`` before they meet.

Defined cases: a null text is empty; a null language is ``und``; texts and pieces without words count nothing;
repeated rows count each time; a long text is cut at ends of pieces only; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as k
from .common import by_bucket, stored, table

MAX_WORDS, LEAST, TOP, PERCENT = 5, 100, 2000, 100
CHUNK_BYTES, SHARE = 1 << 23, 50_000
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_ROWS = "chunk bigint, state binary, key bigint, a bigint, lang string, phrase string, lefts array<bigint>, rights array<bigint>"
_FIELDS = pa.schema(
    [("chunk", pa.int64()), ("state", pa.binary()), ("key", pa.int64()), ("a", pa.int64()), ("lang", pa.string()), ("phrase", pa.string())]
    + [(c, pa.list_(pa.int64())) for c in ("lefts", "rights")]
)


def chain(symbols: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase, its words given one array a place; that of a single word is the word's own."""
    out = symbols[0]
    for j, s in enumerate(symbols[1:], 1):
        out = k.mix(out * U(0x9E3779B97F4A7C15) + s + U(j))
    return out


class Chunk:
    """Words by position (0 in gaps, else a number from 1 on), the hash, language and text of each, and a level's positions."""

    def __init__(self, ids: np.ndarray, symbols: np.ndarray, langs: list[str], lang: np.ndarray, words: list[bytes], at: np.ndarray | None = None):
        self.ids, self.symbols, self.langs, self.lang, self.words, self.at = ids, symbols, langs, lang, words, at

    def dump(self) -> bytes:
        planes = np.ascontiguousarray(self.ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        bits = None
        if self.at is not None:
            mark = np.zeros(len(self.ids), bool)
            mark[self.at] = True
            bits = np.packbits(mark).tobytes()
        state = (planes.tobytes(), self.symbols.tobytes(), self.langs, self.lang.astype(np.int32).tobytes(), b"\n".join(self.words), bits)
        return zstandard.compress(pickle.dumps(state), 3)

    @classmethod
    def load(cls, raw: bytes) -> Chunk:
        planes, symbols, langs, lang, words, bits = pickle.loads(zstandard.decompress(raw))
        ids = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        at = None if bits is None else np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(ids)))
        symbols = np.frombuffer(symbols, np.uint64)
        return cls(ids, symbols, langs, np.frombuffer(lang, np.int32), words.split(b"\n") if len(symbols) else [], at)

    def lists(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the phrases of ``level`` words, ascending, where the list of each begins, and the positions of all lists."""
        if level == 1:
            at = np.flatnonzero(self.ids)
            keys = self.symbols[self.ids[at] - 1]
        else:
            # a position and the one after it both begin a frequent phrase of one word less
            at = self.at[np.flatnonzero(np.diff(self.at) == 1)]
            keys = chain([self.symbols[self.ids[at + j] - 1] for j in range(level)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.append(first, len(keys)), at[order]

    def kept(self, at: np.ndarray, level: int) -> Chunk:
        """The chunk with nothing but the phrases of ``level`` words at ``at``."""
        cover = k.covered(at, level, len(self.ids)) if len(at) else np.zeros(len(self.ids), bool)
        # of a run of other positions one stays, as a gap
        stay = cover.copy()
        stay[1:] |= cover[:-1]
        place = np.cumsum(stay) - 1
        ids = np.where(cover, self.ids, 0)[stay]
        used = np.unique(ids[ids > 0])
        number = np.zeros(len(self.symbols) + 1, np.int64)
        number[used] = np.arange(1, len(used) + 1)
        return Chunk(number[ids], self.symbols[used - 1], self.langs, self.lang[used - 1], [self.words[i - 1] for i in used], place[at])


def _split_long(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with more cuts, at ends of pieces, in texts beyond ``size`` bytes; each part's text."""
    out, owner = [off[:1]], []
    for i in range(len(off) - 1):
        a, b = int(off[i]), int(off[i + 1])
        cuts = []
        while b - a > size:
            breaks = np.flatnonzero(_BREAK[buf[a + size : b]])
            if not len(breaks):
                break
            a += size + int(breaks[0]) + 1
            cuts.append(a)
        out.append(np.array([*cuts, b] if not cuts or cuts[-1] < b else cuts, np.int64))
        owner += [i] * len(out[-1])
    return np.concatenate(out), np.array(owner, np.int64)


def _chunk(buf: np.ndarray, off: np.ndarray, lang: list[str]) -> tuple[Chunk, dict[str, int]]:
    """The chunk of some texts, and its words by language."""
    langs = sorted(set(lang))
    number = {x: i for i, x in enumerate(langs)}
    of_text = np.array([number[x] for x in lang], np.int64)
    salt = np.array([xxhash.xxh64_intdigest(x.encode(), 12) for x in langs], np.uint64)
    symbols, gaps, starts, ends, owner = [], [], [], [], []
    for i, _, b, o in k.chunks(buf, off):
        b = _LOWER[b]
        inside = _WORD[b]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        cut = o[1:-1][(o[1:-1] > 0) & (o[1:-1] < len(b))]
        # runs of word bytes, also cut where a text ends
        s = np.unique(np.concatenate([np.flatnonzero(edge == 1), cut[inside[cut]]]))
        e = np.unique(np.concatenate([np.flatnonzero(edge == -1), cut[inside[cut - 1]]]))
        text = np.searchsorted(o, s, "right") - 1
        broken = np.cumsum(_BREAK[b])[s] if len(s) else s
        gap = np.ones(len(s), bool)
        gap[1:] = (text[1:] != text[:-1]) | (broken[1:] != broken[:-1])
        symbols.append(k.mix(k.word_hashes(b, s, e) ^ salt[of_text[i + text]]))
        gaps.append(gap)
        starts.append(s + off[i])
        ends.append(e + off[i])
        owner.append(of_text[i + text])
    symbols, gaps, starts, ends, owner = map(np.concatenate, (symbols, gaps, starts, ends, owner))
    distinct, first, which, count = np.unique(symbols, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")  # frequent words get small numbers
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    place = np.arange(len(symbols)) + np.cumsum(gaps)
    ids = np.zeros(place[-1] + 2 if len(place) else 1, np.int64)
    ids[place] = rank[which]
    first = first[order]
    low = memoryview(_LOWER[buf])
    words = [bytes(low[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    n = np.bincount(owner, minlength=len(langs))
    return Chunk(ids, distinct[order], langs, owner[first], words), {x: int(c) for x, c in zip(langs, n) if c}


def _state(chunk: int, state: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"chunk": chunk, "state": state}], _FIELDS)


def pack(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunks (chunk, state), and their words by language in other rows (lang, a)."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, str]] = []
        bytes_held = 0

        def flush():
            nonlocal number, held, bytes_held
            off = np.concatenate(([0], np.cumsum([len(b) for b, _ in held])))
            chunk, n = _chunk(np.concatenate([b for b, _ in held]), off, [x for _, x in held])
            yield _state(number, chunk.dump())
            yield pa.RecordBatch.from_pylist([{"lang": x, "a": c} for x, c in n.items()], _FIELDS)
            number, held, bytes_held = number + 1, [], 0

        for batch in batches:
            buf, off = k.utf8(batch.column(0))
            off, owner = _split_long(buf, off, size)
            lang = batch.column(1).to_pylist()
            for a, b, i in zip(off[:-1].tolist(), off[1:].tolist(), owner.tolist()):
                held.append((buf[a:b], "und" if lang[i] is None else lang[i]))
                bytes_held += b - a
                if bytes_held >= size:
                    yield from flush()
        if bytes_held:
            yield from flush()

    return docs.select("text", F.col("lang").cast("string")).mapInArrow(run, _ROWS)


def _sent(chunks: DataFrame, level: int, parts: int) -> DataFrame:
    """Distinct phrases and counts of each chunk, dealt to buckets."""

    def run(batches):
        for batch in batches:
            for chunk, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, first, _ = Chunk.load(state).lists(level)
                bucket = (keys % U(parts)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                if len(keys):
                    blobs = [[x.tobytes() for x in np.split(c[order], cuts)] for c in (keys, np.diff(first).astype(np.uint32))]
                    each = bucket[order][np.concatenate(([0], cuts))]
                    yield pa.RecordBatch.from_arrays([pa.array(each), *(pa.array(b, pa.binary()) for b in blobs), pa.array(np.full(len(each), chunk))], ["bucket", "keys", "counts", "chunk"])

    return chunks.select("chunk", "state").mapInArrow(run, "bucket bigint, keys binary, counts binary, chunk bigint")


def _answers(sent: DataFrame, least: int, parts: int) -> DataFrame:
    """(chunk, told): for each bucket which of the chunk's phrases are frequent, which rows it gives, and their counts."""

    def work(bucket, held):
        chunk = np.array(held["chunk"], np.int64)
        turn = np.argsort(k.mix(chunk.astype(np.uint64) + U(bucket)))  # rows of phrases come from chunks in turn
        size = np.array([len(held["keys"][i]) // 8 for i in turn])
        keys = np.frombuffer(b"".join(held["keys"][i] for i in turn), np.uint64)
        n = np.frombuffer(b"".join(held["counts"][i] for i in turn), np.uint32).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
        total = np.add.reduceat(n[order], first)
        often = total >= least
        frequent, total_of, gives = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        frequent[order] = np.repeat(often, np.diff(np.append(first, len(keys))))
        gives[order[first[often]]] = True
        total_of[order[first]] = total
        ends = np.cumsum(size)
        rows = []
        for i, a, b in zip(turn, ends - size, ends):
            if frequent[a:b].any():
                own = gives[a:b]
                rows.append((int(chunk[i]), bucket, np.packbits(frequent[a:b]).tobytes(), np.packbits(own).tobytes(), total_of[a:b][own].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.binary()] * 3))], ["chunk", "part", "frequent", "gives", "totals"])

    back = by_bucket(sent, work, "chunk bigint, part bigint, frequent binary, gives binary, totals binary", parts)
    return back.groupBy("chunk").agg(F.collect_list(F.struct("part", "frequent", "gives", "totals")).alias("told"))


def _rows(chunk: Chunk, level: int, at: np.ndarray, keys: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    """Rows of the phrases that begin at ``at``."""
    ids = [chunk.ids[at + j] - 1 for j in range(level)]
    symbols = [chunk.symbols[i] for i in ids]
    lists = []
    for cuts in ([symbols[:j] for j in range(1, level)], [symbols[j:] for j in range(1, level)]):
        flat = np.stack([chain(c) for c in cuts], 1).ravel() if cuts else np.zeros(0, np.uint64)
        lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * (level - 1)), pa.array(flat.view(np.int64))))
    words = [b" ".join(chunk.words[i] for i in own).decode() for own in zip(*(i.tolist() for i in ids))]
    lang = [chunk.langs[i] for i in chunk.lang[ids[0]].tolist()]
    empty = [pa.nulls(len(at), t) for t in (pa.int64(), pa.binary())]
    return pa.RecordBatch.from_arrays([*empty, pa.array(keys.view(np.int64)), pa.array(totals), pa.array(lang, pa.string()), pa.array(words, pa.string()), *lists], schema=_FIELDS)


def _level(chunks: DataFrame, level: int, least: int, parts: int) -> DataFrame:
    """The chunks with what is frequent at ``level``, and rows of its phrases."""

    def run(batches):
        for batch in batches:
            for number, state, told in zip(*(batch.column(i).to_pylist() for i in range(3))):
                chunk = Chunk.load(state)
                keys, first, at = chunk.lists(level)
                frequent, gives, totals = np.zeros(len(keys), bool), np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
                order = np.argsort(keys % U(parts), kind="stable")
                bucket = (keys % U(parts))[order]
                for t in told or []:
                    a, b = np.searchsorted(bucket, np.array([t["part"], t["part"] + 1], np.uint64))
                    own = order[a:b]
                    frequent[own] = np.unpackbits(np.frombuffer(t["frequent"], np.uint8), count=len(own))
                    mine = own[np.unpackbits(np.frombuffer(t["gives"], np.uint8), count=len(own)) > 0]
                    gives[mine], totals[mine] = True, np.frombuffer(t["totals"], np.int64)
                if not frequent.any():
                    continue
                if gives.any():
                    yield _rows(chunk, level, at[first[:-1][gives]], keys[gives], totals[gives])
                yield _state(number, chunk.kept(np.sort(at[np.repeat(frequent, np.diff(first))]), level).dump())

    told = _answers(_sent(chunks, level, parts), least, parts)
    return chunks.select("chunk", "state").join(told, "chunk").select("chunk", "state", "told").mapInArrow(run, _ROWS)


def frequent_phrases(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, size: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, n), and (key, lang, phrase, a, lefts, rights) of the phrases of 1 to ``max_words`` words found ``least`` times.

    ``lefts`` and ``rights`` have the keys of the first j and of the other words, for each j.
    """
    packed = stored(pack(docs, size), "chunks")
    n = packed.filter("lang is not null").groupBy("lang").agg(F.sum("a").alias("n"))
    chunks, found = packed.filter("state is not null"), []
    parts = max(1, chunks.count())
    for level in range(1, max_words + 1):
        out = stored(_level(chunks, level, least, parts), "phrases")
        found.append(out.filter("key is not null").select("key", "lang", "phrase", "a", "lefts", "rights"))
        chunks = out.filter("state is not null")
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    return n, rows


def collocations(
    docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP, percent: int = PERCENT, size: int = CHUNK_BYTES
) -> DataFrame:
    """(text, lang) -> each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    n, rows = frequent_phrases(docs, least, max_words, size)
    phrases = rows.filter("size(lefts) > 0")
    longer = phrases.filter("size(lefts) > 1").select(F.explode(F.expr("array(element_at(lefts, -1), rights[0])")).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, "key", "left").filter(f"longer is null or 100 * cast(longer as decimal(20, 0)) < {percent} * cast(a as decimal(20, 0))").drop("longer")
    cuts = kept.join(n, "lang").select("key", "lang", "phrase", "a", "n", F.posexplode(F.arrays_zip("lefts", "rights")).alias("cut", "part"))
    counts = rows.select("key", "a")
    cuts = cuts.join(counts.select(F.col("key").alias("left"), F.col("a").alias("l")), F.col("part.lefts") == F.col("left"))
    cuts = cuts.join(counts.select(F.col("key").alias("right"), F.col("a").alias("r")), F.col("part.rights") == F.col("right"))
    exact = "(1000 * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(17, 0)) * cast(r as decimal(17, 0)))"
    scored = cuts.withColumn("score", F.expr(exact)).groupBy("key", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    scored = stored(scored.select("key", "lang", "phrase", "a", "best.l", "best.r", "n", "best.score"), "scored")
    shares = max(1, -(-scored.count() // SHARE))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("key"), F.lit(shares))
    few = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", share).orderBy(*best))).filter(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, words, count(*) AS a FROM (SELECT lang, k, w[i:i + k - 1] AS words FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k)))
  GROUP BY ALL HAVING count(*) >= 100
), c AS (SELECT * FROM f WHERE len(words) > 1),
inside AS (
  SELECT lang, words[i:i + k - 1] AS words, max(a) AS longer FROM (SELECT lang, words, a, k, unnest(range(1, len(words) - k + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS k) WHERE k < len(words)) GROUP BY ALL
), kept AS (SELECT c.* FROM c LEFT JOIN inside AS i ON i.lang = c.lang AND i.words = c.words WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (
  SELECT kept.lang, kept.words, kept.a, k, x.a AS l, y.a AS r, n, CAST(1000::HUGEINT * kept.a * n // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM kept) AS kept JOIN total USING (lang)
  JOIN f AS x ON x.lang = kept.lang AND x.words = kept.words[1:k] JOIN f AS y ON y.lang = kept.lang AND y.words = kept.words[k + 1:]
), best AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best) WHERE rank <= 2000
"""
