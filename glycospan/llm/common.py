"""Helpers that the text operators share: slices of Arrow batches, word codes, window hashes, checkpoints."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at a time in a task, unless one text is longer.
SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15


def texts_of(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The id, the text and further columns under names that cannot clash with others."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        *(F.col(f"`{c}`").alias(f"more_{i}") for i, c in enumerate(more)),
    )


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with whole rows and about ``limit`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def words_of(texts: list[str | None]) -> list[list[bytes]]:
    """Words of each text: runs of characters other than the six ASCII spaces, as UTF-8."""
    return [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]


def word_codes(words: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(code of each word, the distinct words by code, offsets of the texts)."""
    flat = [w for ws in words for w in ws]
    distinct = list(dict.fromkeys(flat))
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    return codes, distinct, np.concatenate(([0], np.cumsum([len(ws) for ws in words], dtype=np.int64))).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word that depends on its bytes alone."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in distinct), np.uint64, len(distinct))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial 64-bit hash of every ``width`` consecutive values; windows at the end are left out."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, base, span, block = np.zeros(n, np.uint64), 0, _BASE, 1, values
    while True:  # blocks of 1, 2, 4, ... values, put together by the binary digits of the width
        if width & span:
            out = out * np.uint64(base) + block[at : at + n]
            at += span
        if 2 * span > width:
            return mixed(out)
        block = block[:-span] * np.uint64(base) + block[span:]
        base, span = base * base % (1 << 64), 2 * span


def inside(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the ``n`` window starts have their whole window in one text."""
    ok = np.ones(n, bool)
    for end in offsets[1:-1]:
        ok[max(0, end - width + 1) : end] = False
    return ok


def runs_of(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``width`` that begins at one of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:n]) > 0


def shared_folder(df: DataFrame) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``.

    Where it is unset, a local session takes a folder in its warehouse; others raise, as a
    warehouse on the driver's disk is not seen by the executors.
    """
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written by a reliable checkpoint: computed once, and not again when an executor is lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df))
    return df.checkpoint(eager=True)


def written(df: DataFrame, replaced: str | None = None) -> tuple[DataFrame, str]:
    """(``df`` written as a table of its own in the shared folder and read again, the table's path).

    The table at ``replaced``, which an earlier call gave, is deleted once it is no longer read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(df).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaced:
        deleted(spark, replaced)
    return spark.read.parquet(path), path


def deleted(spark: SparkSession, path: str) -> None:
    """Remove a table of ``written`` that is no longer read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
