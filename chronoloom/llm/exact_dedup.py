"""Exact deduplication by content-defined chunk recipes.

1. Each text (UTF-8 bytes) is cut into chunks where a gear hash of the last 32 bytes meets a mask, so
   equal passages give equal chunks wherever they stand. The cut needs no other document.
2. Chunks are grouped by (hash, content): Spark compares the contents themselves, first within each
   map task, so a chunk moves at most once from each task. A hash that stands for one content only is
   a verified identifier.
3. A document then is an ordered list of identifiers (8 bytes for about 2 KB). Equal lists of verified
   identifiers mean equal texts. Where a hash stands for several contents (a collision), the documents
   that hold it are compared by their texts as well.
4. Lists are grouped with map-side aggregation and joined back; a hot list is a skewed sort-merge join
   without anything above it, which adaptive execution splits.

Defined cases: null text counts as empty, so all null and empty texts form one group; a null id never
stays while another id is there; rows that repeat an id are judged alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import blocks, buffers, id_text, materialize, one_row_each

MIN_CHUNK, MASK_BITS, MAX_CHUNK, WINDOW = 512, 11, 8192, 32
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def _candidates(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) where the gear hash of the 32 bytes before meets the mask."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def cut_points(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; the last is its length. An empty text has one empty chunk."""
    n, block, cand = len(data), 1 << 20, [np.zeros(0, np.int64)]
    for i in range(0, n, block):
        lead = min(i, WINDOW)
        found = _candidates(data[i - lead : i + block]) - lead
        cand.append(found[found > 0] + i)
    cand = np.concatenate(cand)
    ends, start = [], 0
    while n - start > MIN_CHUNK:
        k = int(np.searchsorted(cand, start + MIN_CHUNK))
        end = min(int(cand[k]) if k < len(cand) else n, start + MAX_CHUNK, n)
        ends.append(end)
        start = end
    return ends if ends and ends[-1] == n else [*ends, n]


def _cuts_of_block(data: np.ndarray, off: np.ndarray) -> Iterator[list[int]]:
    """Like ``cut_points`` for neighbouring texts, with one hash pass over all. The first WINDOW bytes
    of a text, whose hash would see the text before, are below MIN_CHUNK and never a cut."""
    cand = _candidates(data)
    at = np.searchsorted(cand, off)
    for i in range(len(off) - 1):
        lo, n, start, ends = int(off[i]), int(off[i + 1] - off[i]), 0, []
        own = cand[at[i] : at[i + 1] + 1] - lo
        while n - start > MIN_CHUNK:
            k = int(own.searchsorted(start + MIN_CHUNK))
            end = min(int(own[k]) if k < len(own) else n, start + MAX_CHUNK, n)
            ends.append(end)
            start = end
        yield ends if ends and ends[-1] == n else [*ends, n]


def _recipes(batch: pa.RecordBatch, digest: Callable[[bytes], int]) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(row, chunks, hashes) of every text of a batch."""
    off, data = buffers(batch.column("text"))
    for i, j in blocks(np.diff(off)):
        part = data[off[i] : off[j]]
        rel = off[i : j + 1] - off[i]
        cuts = [cut_points(part)] if j == i + 1 else _cuts_of_block(part, rel)
        raw = part.tobytes()
        for k, ends in enumerate(cuts):
            lo = int(rel[k])
            chunks = [raw[lo + a : lo + b] for a, b in zip([0, *ends[:-1]], ends)]
            hashes = [digest(c) for c in chunks]
            yield i + k, chunks, [h - (1 << 64) if h >> 63 else h for h in hashes]


def _chunk_rows(batches: Iterator[pa.RecordBatch], digest: Callable[[bytes], int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[bytes, int] = {}
        size = 0
        for _, chunks, hashes in _recipes(batch, digest):
            for c, h in zip(chunks, hashes):
                if c not in seen:
                    seen[c] = h
                    size += len(c)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.int64()), pa.array(list(seen), pa.binary())], ["h", "chunk"])
                seen, size = {}, 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.int64()), pa.array(list(seen), pa.binary())], ["h", "chunk"])


def _recipe_rows(batches: Iterator[pa.RecordBatch], digest: Callable[[bytes], int], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [hashes for _, _, hashes in _recipes(batch, digest)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(lists, pa.list_(pa.int64()))], [*columns, "recipe"])


def ambiguous_hashes(texts: DataFrame, digest: Callable[[bytes], int]) -> DataFrame:
    """Chunk hashes that stand for more than one content."""
    chunks = texts.mapInArrow(lambda b: _chunk_rows(b, digest), "h long, chunk binary")
    contents = chunks.groupBy("h", "chunk").count().select("h")
    return contents.groupBy("h").count().filter("count > 1").select("h")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """One row per row of ``docs``: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.
    ``digest`` gives the 64-bit hash of a chunk; its collisions cost time, never a wrong group."""
    texts = id_text(docs, id_col, text_col)
    id_type = texts.schema["id"].dataType.simpleString()
    doubtful = materialize(ambiguous_hashes(texts, digest), "dedup-ambiguous")
    texts = texts.withColumn("sha", F.sha2("text", 256))
    kind = f"id {id_type}, sha string"
    lists = texts.mapInArrow(lambda b: _recipe_rows(b, digest, ("id", "sha")), f"{kind}, recipe array<long>")
    lists = materialize(lists.withColumn("key", F.xxhash64("recipe")), "dedup-recipes")
    if doubtful.isEmpty():
        lists = lists.withColumn("exact", F.lit(None).cast("binary"))
    else:
        # lists that hold a doubtful identifier are compared with their texts
        unsure = lists.select("key", F.explode("recipe").alias("h")).join(doubtful, "h", "left_semi").select(F.col("key").alias("unsure")).distinct()
        whole = texts.mapInArrow(lambda b: _recipe_rows(b, digest, ("id", "sha", "text")), f"{kind}, text binary, recipe array<long>").withColumn("key", F.xxhash64("recipe"))
        lists = whole.join(unsure.hint("merge"), whole["key"] == unsure["unsure"], "left").withColumn("exact", F.when(F.col("unsure").isNotNull(), F.col("text"))).drop("text", "unsure")
    groups = lists.groupBy("key", "recipe", "exact").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    same = (lists["key"] == groups["key"]) & (lists["recipe"] == groups["recipe"]) & lists["exact"].eqNullSafe(groups["exact"])
    return lists.join(groups.hint("merge"), same).select(
        lists["id"].alias(id_col), "keep_id", "group_size", lists["id"].eqNullSafe(F.col("keep_id")).alias("kept"), lists["sha"].alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one of rows that repeat an id and text."""
    return one_row_each(docs, exact_groups(docs, id_col, text_col).filter("kept"), id_col, text_col)
