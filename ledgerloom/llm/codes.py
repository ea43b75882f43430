"""Operator 13: vector codes (one codebook for each part of a vector), in exact integers.

Component x becomes floor(1024 * x). Vectors are cut into ``PARTS`` equal parts; a codebook has ``ENTRIES``
entries a part, at first those of the smallest vec_ids. Each round assigns every part to its nearest entry
(squared distance, ties to the lower index) and replaces each used entry by the floor of its parts' mean.

Nearest entries are found by segment-mean lower bounds. For a block of s components with sums S and
residual norms R (the length of what is left after the mean), |x - e|^2 >= (Sx - Se)^2 / s + (Rx - Re)^2.
That is the distance of two images of block means and residual norms. Entries are filtered by the bound over
the whole part, then by those over blocks of the ``LEVELS``, coarse to fine, and those that survive get exact
integer distances. Bounds are floats, lowered by more than rounding can add to them, so no nearest entry (nor
one that ties with it) is ever filtered out.

A task reads vectors in batches and gives sums and counts for each entry; they are added up as decimals. The
driver holds the codebooks alone: ENTRIES times a vector's components, however many rows there are. Every
round reads the table anew, so nothing is lost with an executor.

Defined cases: a vector that is null or holds null or non-finite components is dropped; an empty table gives
no rows; rows may repeat, also with another vector for the same vec_id (the least of them seeds); a null
vec_id is coded as well and comes last among the seeds; with fewer ids than ENTRIES the codebook is shorter;
vectors shorter than the longest one, and all if its length is no multiple of PARTS, count as filled up with
zeros; components of 2^18 or more in magnitude have no distance in 64 bits and stop the job with an error;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components of the blocks of the finer bounds; entries whose distances tighten the last one; vectors that are compared at once.
LEVELS, TRIED, BLOCK = (4, 2), 8, 2048
LIMIT = 1 << 28


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows to keep, and their integers (rows, width), of a list column of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    # a null component becomes not a number, so one test finds both
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(n), size)
    keep = np.ones(n, bool) if not column.null_count else np.asarray(column.is_valid())
    keep[row[~np.isfinite(values)]] = False
    out = np.zeros((n, width), np.int64)
    good = keep[row]
    scaled = np.floor(values[good] * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"components of {LIMIT // SCALE} or more have no exact distance in 64 bits")
    out[row[good], (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size))[good]] = scaled
    return keep, out[keep]


def _image(x: np.ndarray, size: int) -> np.ndarray:
    """Scaled mean and residual norm of each block of ``size`` components: images are no farther apart than vectors."""
    first = np.arange(0, x.shape[1], size)
    f = x.astype(np.float64)
    mean = np.add.reduceat(f, first, axis=1) / np.sqrt(np.diff(np.append(first, x.shape[1])))
    residual = np.sqrt(np.maximum(np.add.reduceat(f * f, first, axis=1) - mean**2, 0))
    return np.concatenate([mean, residual], 1)


def _bounds(a: np.ndarray, b: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Squared distances of all images of a and b, less ``slack``."""
    out = a @ (-2 * b.T)
    out += (a**2).sum(1)[:, None]
    out += (b**2).sum(1)
    out -= slack
    return out


def nearest(x: np.ndarray, book: np.ndarray, levels: tuple[int, ...] = LEVELS, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry and its exact squared distance for each row; how many distances were computed."""
    n, width = x.shape
    code, error, computed = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    if not n or not width:
        return code, error, computed
    sizes = [width, *(size for size in levels if size < width)]
    images = [_image(book, size) for size in sizes]
    norms = (book.astype(np.float64) ** 2).sum(1)
    tried = min(TRIED, len(book))
    largest = max(int(np.abs(x).max()), int(np.abs(book).max()))
    kind = np.int32 if width * (2 * largest) ** 2 < 1 << 31 else np.int64

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a -= b
        return np.einsum("ij,ij->i", a, a)

    book = book.astype(kind)
    for at in range(0, n, block):
        own = x[at : at + block].astype(kind)
        rows = np.arange(len(own))
        # more than rounding can add to a bound of any level
        slack = ((own.astype(np.float64) ** 2).sum(1)[:, None] + norms) * 2.0**-19
        best, left = np.full(len(own), np.iinfo(np.int64).max), np.ones((len(own), len(book)), bool)
        for size, image in zip(sizes, images):
            low = _bounds(_image(own, size), image, slack)
            # what entries of the least bounds are away, others have to stay within
            some = 1 if size != sizes[-1] else tried
            few = low.argmin(1)[:, None] if some == 1 else np.argpartition(low, some - 1, axis=1)[:, :some]
            best = np.minimum(best, distances(np.repeat(own, some, axis=0), book[few.ravel()]).reshape(-1, some).min(1))
            left &= low <= best[:, None]
            computed += few.size
        # survivors come by row and index, each row has one at least
        i, j = np.nonzero(left)
        exact = distances(own[i], book[j])
        computed += len(i)
        least = np.minimum.reduceat(exact, np.searchsorted(i, rows))
        hit = np.flatnonzero(exact == least[i])
        code[at : at + block] = j[hit[np.searchsorted(i[hit], rows)]]
        error[at : at + block] = least
    return code, error, computed


def _kept(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("embedding").isNotNull() & F.expr("not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"))


def seeds(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> tuple[np.ndarray, int]:
    """The first codebooks (parts, entries, width of a part) and the width of a vector; rows of at most ``entries`` ids come here."""
    kept = _kept(vectors)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    ids = [r[0] for r in kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    wanted = F.col("vec_id").isin([i for i in ids if i is not None])
    if None in ids:
        wanted = F.coalesce(wanted, F.lit(True)) | F.col("vec_id").isNull()
    rows = kept.filter(wanted).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).collect() if ids else []
    rows.sort(key=lambda r: (r["vec_id"] is None, r["vec_id"]))
    _, x = matrix(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), width)
    return x.reshape(len(rows), parts, width // parts).transpose(1, 0, 2).copy(), width


def _sums(vectors: DataFrame, books: np.ndarray, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each used (part, entry) its count and sums of components: at most as many as the codebooks have."""
    parts, entries, wide = books.shape

    def run(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, x = matrix(batch.column(0), width)
            for p in range(parts):
                own = x[:, p * wide : (p + 1) * wide]
                code, _, _ = nearest(own, books[p])
                if len(code):
                    order = np.argsort(code, kind="stable")
                    begin = np.concatenate(([0], np.flatnonzero(np.diff(code[order])) + 1))
                    used = code[order][begin]
                    total[p, used] += np.add.reduceat(own[order], begin, axis=0)
                    count[p] += np.bincount(code, minlength=entries)
        for p in range(parts):
            used = np.flatnonzero(count[p])
            if len(used):
                place = np.tile(np.arange(wide), len(used))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(place), p)), pa.array(np.repeat(used, wide)), pa.array(place), pa.array(total[p, used].ravel()), pa.array(np.repeat(count[p, used], wide))],
                    ["part", "entry", "place", "total", "n"],
                )

    found = vectors.select("embedding").mapInArrow(run, "part bigint, entry bigint, place bigint, total bigint, n bigint")
    found = found.groupBy("part", "entry", "place").agg(*(F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("total", "n")))
    out: dict = {}
    for r in found.collect():
        n, sums = out.setdefault((r["part"], r["entry"]), (int(r["n"]), [0] * wide))
        sums[r["place"]] = int(r["total"])
    return out


def fit(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> tuple[np.ndarray, int]:
    """Codebooks (parts, entries, width of a part) fitted on every row, and the width of a vector."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    books, width = seeds(vectors, entries, parts)
    for _ in range(rounds if width and books.shape[1] else 0):
        for (p, e), (n, sums) in _sums(vectors, books, width).items():
            books[p, e] = [s // n for s in sums]
    return books, width


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(vec_id, embedding, label) -> (vec_id, label, code, error) of the rows that are kept."""
    wide = books.shape[2]

    def run(batches):
        for batch in batches:
            keep, x = matrix(batch.column(2), width)
            if not len(x):
                continue
            error, codes = np.zeros(len(x), np.int64), np.zeros((len(x), len(books)), np.uint8 if books.shape[1] <= 256 else np.uint16)
            for p, book in enumerate(books):
                codes[:, p], own, _ = nearest(x[:, p * wide : (p + 1) * wide], book)
                error += own
            digits = [bytes(c).hex() for c in codes.astype(codes.dtype.newbyteorder(">"))]
            rows = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(digits), pa.array(error)], ["vec_id", "label", "code", "error"])

    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = found.schema["label"].dataType.simpleString()
    return found.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint")


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256.

    The sums by label are joined by Spark's own choice: it broadcasts them if they turn out small, and splits a
    hot label's rows if they do not.
    """
    books, width = fit(vectors, rounds, entries, parts)
    rows = stored(encode(vectors, books, width), "codes")
    sums = rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> str:
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS v, vec_id, label, embedding FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT v, (pos - 1) // (len // {0}) AS part, (pos - 1) % (len // {0}) AS place, CAST(floor(1024 * CAST(value AS DOUBLE)) AS BIGINT) AS x"
        " FROM (SELECT v, len(embedding) AS len, unnest(embedding) AS value, unnest(range(1, len(embedding) + 1)) AS pos FROM kept))".format(parts),
        f"book0 AS MATERIALIZED (SELECT part, e, place, x AS c FROM x JOIN (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) USING (v))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"near{r} AS MATERIALIZED (SELECT v, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM"
            f" (SELECT v, x.part, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN book{r} AS b ON x.part = b.part AND x.place = b.place GROUP BY v, x.part, e) GROUP BY v, part)"
        )
        if r < rounds:
            steps.append(
                f"book{r + 1} AS MATERIALIZED (SELECT b.part, b.e, b.place, coalesce(m.c, b.c) AS c FROM book{r} AS b LEFT JOIN"
                f" (SELECT part, e, place, CAST((s - (s % n + n) % n) // n AS BIGINT) AS c FROM (SELECT x.part, e, place, sum(x) AS s, count(*) AS n FROM x JOIN near{r} USING (v, part) GROUP BY x.part, e, place)) AS m"
                " ON b.part = m.part AND b.e = m.e AND b.place = m.place)"
            )
    return (
        "WITH " + ", ".join(steps) + ", coded AS (SELECT vec_id, label, code, error FROM kept JOIN (SELECT v, string_agg(format('{:02x}', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error"
        f" FROM near{rounds} GROUP BY v) USING (v))"
        f" SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,"
        f" (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, e, place)) FROM book{rounds}) AS codebooks_sha256 FROM coded"
    )


SQL = _sql()
