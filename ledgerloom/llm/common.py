"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names it; where that is unset the context's own checkpoint folder is taken, and
    on one machine, where every task sees it, one in /tmp. A cluster without either is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir("/tmp/checkpoints")
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(keys: np.ndarray, columns: dict[str, np.ndarray], extra: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, column blobs): the entries of ``columns`` dealt out by ``keys``, packed as bytes.

    One row holds all entries of one bucket, so a shuffle moves few rows of many entries.
    """
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    first = np.concatenate(([0], cuts))
    arrays = [pa.array(keys[order][first].astype(np.int64))]
    for c in columns.values():
        arrays.append(pa.array([x.tobytes() for x in np.split(c[order], cuts)], pa.binary()))
    arrays += [pa.array([v] * len(first), pa.int64()) for v in (extra or {}).values()]
    yield pa.RecordBatch.from_arrays(arrays, ["bucket", *columns, *(extra or {})])


def by_bucket(df: DataFrame, work: Callable[[int, dict[str, list]], Iterator[pa.RecordBatch]], schema: str, least: int = 1) -> DataFrame:
    """Calls ``work(bucket, columns)`` once for each bucket of ``df`` (bucket, blobs...).

    Rows are dealt by bucket, to ``least`` partitions at least, and sorted, so a task holds one bucket at a time.
    """
    names = [c for c in df.columns if c != "bucket"]

    def run(batches):
        now, held = None, {n: [] for n in names}
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names}
            for i, bucket in enumerate(batch.column(batch.schema.get_field_index("bucket")).to_pylist()):
                if bucket != now:
                    if now is not None:
                        yield from work(now, held)
                    now, held = bucket, {n: [] for n in names}
                for n in names:
                    held[n].append(columns[n][i])
        if now is not None:
            yield from work(now, held)

    n = max(least, shuffle_partitions(df.sparkSession))
    return df.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
