"""Shared helpers: scratch tables in the shared folder (``materialize``), Arrow buffers, block iteration, tree sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.shared import kept as materialize  # noqa: F401

#: Bytes (or characters) of text that the Python side handles at once; bounds a worker's memory.
BLOCK = 1 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str, text_col: str, binary: bool = True) -> DataFrame:
    """Two columns ``id`` and ``text`` (null text becomes empty); other columns never travel."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), (text.cast("binary") if binary else text).alias("text"))


def one_row_each(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose (id, text_sha256) is in ``kept``, null ids too, with all their columns; one
    of rows that repeat both."""
    key = lambda id_, sha: F.concat(F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("null")), F.lit("/"), sha)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.withColumn("__row_key", key(F.col(f"`{id_col}`"), F.sha2(text, 256)))
    keys = kept.select(key(F.col(f"`{id_col}`"), F.col("text_sha256")).alias("__row_key")).distinct()
    return rows.join(keys.hint("merge"), "__row_key", "left_semi").dropDuplicates(["__row_key"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary Arrow column, without copying."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def blocks(sizes: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of neighbouring rows of at most ``most`` in all; a larger row stands alone."""
    i, total = 0, 0
    for j, n in enumerate(sizes):
        if total and total + n > most:
            yield i, j
            i, total = j, 0
        total += int(n)
    if i < len(sizes):
        yield i, len(sizes)


def spaced(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of ``off`` with a space after each, and where each starts (and the end)."""
    n = len(off) - 1
    starts = off - off[0] + np.arange(n + 1)
    out = np.full(starts[-1], 32, np.uint8)
    for k in range(n):
        out[starts[k] : starts[k + 1] - 1] = data[off[k] : off[k + 1]]
    return out, starts


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SLICE = 256


def slices(vector: np.ndarray) -> pa.RecordBatch:
    """A float64 vector as rows (i, part) of short slices."""
    v = np.asarray(vector, np.float64).ravel()
    parts = [v[i : i + _SLICE].tobytes() for i in range(0, len(v), _SLICE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["i", "part"])


SLICES = "i int, part binary"


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, raw in zip(b.column("i").to_pylist(), b.column("part").to_pylist()):
            x = np.frombuffer(raw, np.float64)
            total[i] = total[i] + x if i in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["i", "part"])


def tree_sum(parts: DataFrame) -> np.ndarray | None:
    """Sum the vectors that partitions gave as ``slices``: first over groups of partitions, then by slice,
    both on the executors and as a stream; the driver gets one vector."""
    width = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = parts.withColumn("g", F.spark_partition_id() % width).repartition(width, "g").select("i", "part").mapInArrow(_add, SLICES)
    rows = first.repartition(8, "i").mapInArrow(_add, SLICES).collect()
    if not rows:
        return None
    by_slice = {r["i"]: np.frombuffer(r["part"], np.float64) for r in rows}
    return np.concatenate([by_slice[i] for i in sorted(by_slice)])
