"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased and their white space made single spaces. An item is cut into
stretches of at most SEGMENT characters; it is found where a text passage is within k = RATE * m edits of
one of its stretches of m characters. (An item that is quoted whole within that rate has such a stretch.)
By the q-gram lemma such a passage shares at least m + 1 - q * (k + 1) q-grams with the stretch, all within
2 k + 1 neighbouring diagonals (text position less item position). Every task therefore

1. looks up the q-grams of its texts in a bit table, then in the sorted q-grams of the stretches,
2. counts, in overlapping bands of diagonals of width 2 * (2 k + 1), the item positions that are met, and
   keeps bands that meet the bound (no occurrence within budget is lost), and
3. verifies a kept region by a banded alignment on its characters.

Stretches of fewer than SHORT characters have no room for edits: they are found where they stand exactly,
between characters that are no letters or digits, by an automaton of all of them.

The stretches travel with the tasks, about ``BLOCK_CHARS`` characters of them at once (checked); a larger
benchmark is dealt into blocks, each of which is searched in all texts. Texts are never moved for it.
Occurrences of frequent q-grams are looked at in parts of at most MOST_HITS, by place and by stretch.

Defined cases: null and empty texts match nothing; items that are null or of white space are not searched;
equal items are found each; a text with several occurrences of an item reports the best; rows that repeat
an id are told apart by their texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import BLOCK, blocks, id_text, materialize

Q, RATE, SHORT, SEGMENT = 10, 0.08, 24, 1000
#: Characters of benchmark text that travel with a task.
BLOCK_CHARS = 4_000_000
#: Pairs of equal q-grams that are held at once.
MOST_HITS = 4_000_000
_P = 0x9E3779B1
_TABLE_BITS = 22


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """32-bit hashes of all runs of q characters."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    out, width, doubled, done = None, 1, c, 0
    while True:  # runs of 1, 2, 4, ... characters, put together by the bits of q
        if q & width:
            out = doubled[:n] if out is None else out * np.uint32(pow(_P, width, 1 << 32)) + doubled[done : done + n]
            done += width
        if width * 2 > q:
            return out * np.uint32(0x85EBCA6B)
        doubled = doubled[:-width] * np.uint32(pow(_P, width, 1 << 32)) + doubled[width:]
        width *= 2


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """Edits that an item of m characters may have: the rate, or less where the lemma's bound would fall under 1."""
    return max(0, min(int(rate * m), (m - q) // q))


@dataclass
class Index:
    """The q-grams of some items, sorted by hash and item."""

    ids: list
    items: list[np.ndarray]
    hashes: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    q: int

    @classmethod
    def of(cls, ids: list, texts: list[str], q: int = Q, rate: float = RATE) -> Index:
        items = [codes(t) for t in texts]
        g = [grams(c, q) for c in items]
        hashes = np.concatenate([*g, np.zeros(0, np.uint32)])
        item = np.repeat(np.arange(len(items)), [len(x) for x in g])
        place = np.concatenate([*(np.arange(len(x)) for x in g), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        keys = hashes[order].astype(np.uint64) << np.uint64(32) | item[order].astype(np.uint64)
        edits = np.array([budget(len(c), q, rate) for c in items], np.int64)
        bound = np.array([len(c) for c in items], np.int64) + 1 - q * (edits + 1)
        return cls(ids, items, hashes[order], keys, item[order], place[order], edits, bound, q)

    def table(self) -> np.ndarray:
        t = np.zeros(1 << _TABLE_BITS, bool)
        t[self.hashes >> np.uint32(32 - _TABLE_BITS)] = True
        return t


def align(item: np.ndarray, text: np.ndarray, first: int, width: int) -> tuple[int, int]:
    """Least edits between ``item`` and a stretch of ``text``, and where the stretch ends, over alignments
    that stay on diagonals first .. first + width - 1."""
    m, far = len(item), len(item) + 1
    at = np.arange(first, first + width)
    padded = np.full(m + width, np.iinfo(np.uint32).max, np.uint32)
    lo, hi = max(0, first), min(len(text), first + m + width)
    if hi > lo:
        padded[lo - first : hi - first] = text[lo:hi]
    inside = (at >= 0) & (at <= len(text))
    row = np.where(inside, 0, far)
    t = np.arange(width)
    for i in range(1, m + 1):
        new = row + (padded[i - 1 : i - 1 + width] != item[i - 1])
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new[(at + i < 0) | (at + i > len(text))] = far
        row = np.minimum.accumulate(new - t) + t
    k = int(row.argmin())
    return int(row[k]), int(at[k] + m)


def _hits(index: Index, at: np.ndarray, g: np.ndarray, i: int, j: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, first entry, entries of the index) of the q-grams g at rising places, for the items i to j - 1,
    in parts of at most MOST_HITS entries. Every stretch of ``reach`` places is whole in one of the parts."""
    key = g.astype(np.uint64) << np.uint64(32)
    lo, hi = (np.searchsorted(index.keys, key + np.uint64(x)) for x in (i, j))
    some = hi > lo
    at, g, lo, n = at[some], g[some], lo[some], (hi - lo)[some]
    if not len(at):
        return
    if n.sum() <= MOST_HITS or (at[-1] - at[0] <= 2 * reach and j - i == 1):
        yield at, lo, n
    elif at[-1] - at[0] > 2 * reach:
        mid = (at[0] + at[-1]) // 2
        for part in (at < mid + reach, at >= mid):
            yield from _hits(index, at[part], g[part], i, j, reach)
    else:
        yield from _hits(index, at, g, i, (i + j) // 2, reach)
        yield from _hits(index, at, g, (i + j) // 2, j, reach)


def search(texts: list[str], index: Index, table: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text number, item number, end, edits) of every item found in normalised texts."""
    joined = codes("\n" * 1 + "\n".join(texts) + "\n")
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    g = grams(joined, index.q)
    hit = np.flatnonzero(table[g >> np.uint32(32 - _TABLE_BITS)])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    # places of the hits of one band: an item's length and two steps
    reach = max((len(c) for c in index.items), default=0) + 4 * int(index.edits.max(initial=0)) + 2
    for at, lo, n in _hits(index, hit, g[hit], 0, len(index.items), reach):
        which = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        pos = np.repeat(at, n)
        doc, item, place = np.searchsorted(starts, pos, "right") - 1, index.item[which], index.place[which]
        diagonal, step = pos - place + (1 << 20), 2 * index.edits[item] + 1
        # bands of two steps overlap by one: every hit counts in the band that begins at its step and in the one before
        band = np.concatenate([diagonal // step, diagonal // step - 1])
        doc, item, place = np.tile(doc, 2), np.tile(item, 2), np.tile(place, 2)
        order = np.lexsort((place, band, item, doc))
        d, i, b, p = doc[order], item[order], band[order], place[order]
        same = (d[1:] == d[:-1]) & (i[1:] == i[:-1]) & (b[1:] == b[:-1])
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        fresh = np.concatenate(([True], ~(same & (p[1:] == p[:-1]))))
        counted = np.add.reduceat(fresh.astype(np.int64), first)
        for f in first[counted >= index.bound[i[first]]]:
            x, y, z = int(d[f]), int(i[f]), int(b[f])
            k = int(index.edits[y])
            if best.get((x, y), (k + 1, 0))[0] == 0:
                continue
            own = joined[starts[x] : starts[x + 1] - 1]
            found = align(index.items[y], own, z * (2 * k + 1) - (1 << 20) - int(starts[x]), 2 * (2 * k + 1))
            if found[0] <= k and found < best.get((x, y), (k + 1, 0)):
                best[x, y] = found
    return [(x, y, end, edits) for (x, y), (edits, end) in sorted(best.items())]


def automaton(items: list[tuple[int, str]]):
    """Finds the short items; ``items`` are (number, normalised text)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, text in items:
        found.add_word(text, (*found.get(text, ()), k))
    found.make_automaton()
    return found


def search_short(text: str, items, sizes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(item number, end, 0) of the short items that stand in a normalised text between other characters than
    letters and digits."""
    for last, numbers in items.iter(text):
        first = last + 1 - sizes[numbers[0]]
        if (first == 0 or not text[first - 1].isalnum()) and (last + 1 == len(text) or not text[last + 1].isalnum()):
            for k in numbers:
                yield k, last + 1, 0


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """The stretches to search, normalised, in blocks that fit a task (checked)."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("length(text) > 0")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                text = normalise(text)
                for lo in range(0, len(text), SEGMENT):
                    # the last stretch ends with the item and may overlap the one before
                    part = text[max(0, min(lo, len(text) - SEGMENT)) :][:SEGMENT]
                    rows.append(k)
                    parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(parts, pa.string())], ["id", "text"])

    item_type = items.schema["id"].dataType.simpleString()
    parts = materialize(items.mapInArrow(cut, f"id {item_type}, text string").distinct(), "decontam-items")
    total = parts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-2 * total // most) if total > most else 1
    block = F.pmod(F.xxhash64("id", "text"), F.lit(int(n)))
    for b in range(int(n)):
        rows = parts.filter(block == b) if n > 1 else parts
        size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        # the rows are different and short, so a part of the block is smaller
        deal = -(-size // most)
        for d in range(int(deal)):
            some = rows.filter(F.pmod(F.xxhash64("text", "id", F.lit(1)), F.lit(int(deal))) == d) if deal > 1 else rows
            found = sorted(((r["id"], r["text"]) for r in some.collect()), key=lambda x: (x[0] is None, x[0], x[1]))
            if found:
                yield [x[0] for x in found], [x[1] for x in found]


def _matches_of_block(texts: DataFrame, ids: list, items: list[str], id_type: str, item_type: str) -> DataFrame:
    long, short = ([k for k, t in enumerate(items) if (len(t) >= SHORT) == want] for want in (True, False))
    index = Index.of(long, [items[k] for k in long])
    sizes = [len(t) for t in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.table()
        exact = automaton([(k, items[k]) for k in short]) if short else None
        for batch in batches:
            best: dict[tuple, tuple[int, int]] = {}

            def keep(row: int, k: int, end: int, edits: int, best=best) -> None:
                at = (row, ids[k])
                best[at] = min((edits, end), best.get(at, (edits, end)))

            raw = batch.column("text").to_pylist()
            for i, j in blocks(np.array([len(t) for t in raw]), BLOCK // 2):
                some = [normalise(t) for t in raw[i:j]]
                for x, y, end, edits in search(some, index, table):
                    keep(i + x, index.ids[y], end, edits)
                for x, text in enumerate(some if exact else ()):
                    for k, end, edits in search_short(text, exact, sizes):
                        keep(i + x, k, end, edits)
            found = list(best.items())
            of = pa.array([row for (row, _), _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(of), batch.column("t").take(of), pa.array([item for (_, item), _ in found], kind), pa.array([end for _, (_, end) in found], pa.int64()), pa.array([edits for _, (edits, _) in found], pa.int32())],
                ["id", "t", "item_id", "end", "edits"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(_parse(item_type))
    return texts.mapInArrow(run, f"id {id_type}, t long, item_id {item_type}, end long, edits int")


def _parse(kind: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(f"x {kind}")["x"].dataType


def _hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, t (hash of the text), item_id, end (characters of the normalised text before the passage's end),
    edits (of the stretch found): one row per row of ``docs`` and item found in it."""
    texts = id_text(docs, id_col, text_col, binary=False)
    texts = texts.select("id", _hash("text").alias("t"), "text")
    id_type, item_type = texts.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    # written one by one, so that the driver holds the index of one block however long the benchmark is
    blocks_of = item_blocks(benchmark, item_col, item_text)
    parts = [materialize(_matches_of_block(texts, ids, items, id_type, item_type), "decontam-block") for ids, items in blocks_of]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"id {id_type}, t long, item_id {item_type}, end long, edits int")
    return reduce(DataFrame.union, parts)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, contaminated, n_items, items (ids found, in order), min_edits."""
    found = materialize(matches(docs, benchmark, id_col, text_col, item_col, item_text), "decontam-matches")
    # an item without an id counts, but has none to list
    by_row = found.groupBy("id", "t").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("nameless"), F.min("edits").alias("min_edits"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), _hash(text_col).alias("of"))
    out = rows.join(by_row.hint("merge"), rows["doc"].eqNullSafe(by_row["id"]) & (rows["of"] == by_row["t"]), "left")
    items = F.coalesce("items", F.array().cast(by_row.schema["items"].dataType))
    n = F.size(items) + F.coalesce("nameless", F.lit(0))
    return out.select(F.col("doc").alias(id_col), (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), items.alias("items"), "min_edits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    found = matches(docs, benchmark, id_col, text_col, item_col, item_text).select(F.col("id").alias("__found_id"), F.col("t").alias("__found_t")).distinct()
    return docs.join(found.hint("merge"), docs[id_col].eqNullSafe(F.col("__found_id")) & (_hash(text_col) == F.col("__found_t")), "left_anti")
