"""Removal of long repeated byte strings by a hash-compared suffix sort.

A byte goes when some LENGTH-byte window that covers it also starts elsewhere, in any text.

1. In every window the 64-byte gram with the smallest hash is its anchor, so equal windows have equal
   anchors at the same place in them, and only windows of one anchor need comparing. Neighbouring windows
   with one anchor form a run of about 170; a text travels as its runs: (anchor hash, 128-bit BLAKE2b digest
   of the bytes the run spans, places).
2. A run that occurs again as a whole (equal digests) is a repeat as a whole; one of its places stands for
   it from here.
3. Where an anchor has different runs, the bytes of those runs (not texts) are gathered by anchor. Their
   windows are suffixes cut at LENGTH bytes: a mergesort puts them in order, each comparison finding the
   common extension by binary search over prefix polynomial hashes, and neighbours that agree in LENGTH
   bytes are verified on the bytes.
4. A task sorts at most BUCKET runs of an anchor at once. More of them are dealt out first: the distances
   from a window's start to its anchor are halved, and the bytes that all windows of a half share are the
   key of a bucket that only runs with equal bytes there enter. Buckets of one run are done, those of at
   most BUCKET runs are sorted, others are halved again, down to single distances, where the shared bytes
   are the whole window. So an anchor that very many texts have costs some rows a run, in any number of
   tasks, and nothing is capped or left out.
5. The repeats of a run are one interval (all its windows hold the anchor). Intervals are gathered by
   text, merged and cut out.

Defined cases: null counts as empty; texts shorter than LENGTH lose nothing; rows that repeat a text are
repeats of each other; rows that repeat an id are told apart by their texts; null ids take part and are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import BLOCK, blocks, buffers, id_text, materialize, mix64, signed
from chronoloom.llm.hashing import PrefixHash

LENGTH, GRAM = 400, 64
#: Runs that are sorted at once: about 300 kB of bytes and 90,000 windows.
BUCKET = 512
#: Distances from a window's start to its anchor.
PLACES = LENGTH - GRAM + 1
#: Tasks that one bucket's rows are dealt to where they meet its count.
SALTS = 16
_POS = np.uint64((1 << 21) - 1)


def runs_of(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, text number, anchor, first window, last window) of the runs of neighbouring texts."""
    n = len(data)
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    if n < length:
        return empty
    prefix = PrefixHash(data)
    p = np.arange(n - gram + 1)
    h = mix64(prefix.of(p, p + gram))
    least, width, need = (h & ~_POS) | p.astype(np.uint64), 1, length - gram + 1
    while width * 2 <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if need > width:
        least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
    anchor = (least & _POS).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(anchor)]
    s = np.flatnonzero(np.arange(len(anchor)) + length <= off[text + 1])
    if not len(s):
        return empty
    a, t = anchor[s], text[s]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (t[1:] != t[:-1]))))
    last = np.append(first[1:] - 1, len(s) - 1)
    return h[a[first]], t[first], a[first], s[first], s[last]


def _pieces(off: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, from, to) of the texts; a text longer than BLOCK in pieces that share no window and miss none."""
    out, step = [], BLOCK - LENGTH
    for k in range(len(off) - 1):
        lo, hi = int(off[k]), int(off[k + 1])
        if hi - lo <= BLOCK:
            out.append((k, lo, hi))
        else:
            out += [(k, x, min(hi, x + step + LENGTH - 1)) for x in range(lo, hi - LENGTH + 1, step)]
    return out


def _digests(parts: Iterable) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128-bit digest of each part."""
    raw = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)
    return raw[:, 0].copy(), raw[:, 1].copy()


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        off, data = buffers(batch.column("text"))
        pieces = _pieces(off)
        for i, j in blocks(np.array([hi - lo for _, lo, hi in pieces], np.int64)):
            some = pieces[i:j]
            part = np.concatenate([data[lo:hi] for _, lo, hi in some])
            at = np.cumsum([0, *(hi - lo for _, lo, hi in some)])
            g, t, a, lo, hi = runs_of(part, at)
            raw = memoryview(part.tobytes())
            f1, f2 = _digests(raw[x : y + LENGTH] for x, y in zip(lo.tolist(), hi.tolist()))
            rows = np.array([r for r, _, _ in some], np.int64)[t]
            back = np.array([x for _, x, _ in some], np.int64)[t] - off[rows] - at[t]
            of = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("t").take(of), *(pa.array(x) for x in (signed(g), f1, f2, a + back, lo + back, hi + back))], ["id", "t", "g", "f1", "f2", "a", "lo", "hi"])


class SuffixSort:
    """Windows of ``length`` bytes of a byte array, in the order of their bytes, by mergesort within buckets."""

    def __init__(self, data: np.ndarray, length: int):
        self.length, self.data = length, np.concatenate([data, np.zeros(1, np.uint8)])
        self.prefix = PrefixHash(data)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the windows at x and y, by binary search over prefix hashes."""
        s, down = self.prefix.sums, self.prefix.down
        sx, sy, dx, dy = s[x], s[y], down[x], down[y]
        out = np.full(len(x), self.length)
        todo = np.flatnonzero((s[x + self.length] - sx) * dx != (s[y + self.length] - sy) * dy)
        lo, hi = np.zeros(len(todo), np.int64), np.full(len(todo), self.length - 1)
        x, y, sx, sy, dx, dy = (v[todo] for v in (x, y, sx, sy, dx, dy))
        while len(todo) and (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (s[x + mid] - sx) * dx == (s[y + mid] - sy) * dy
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[todo] = lo
        return out

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        e = self.extension(x, y)
        whole = e >= self.length
        a, b = self.data[np.where(whole, x, x + e)], self.data[np.where(whole, y, y + e)]
        return np.where(whole, or_equal, a < b)

    def sort(self, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``at``: windows, bucket by bucket; begin, end: the bucket of each. The windows in order within buckets."""
        index, width = np.arange(len(at)), 1
        most = int((end - begin).max()) if len(at) else 0
        while width < most:
            rel = index - begin
            run = rel // width
            sib = begin + (run ^ 1) * width
            sib_end = np.minimum(sib + width, end)
            act = np.flatnonzero(sib < sib_end)
            lo, hi, base = sib[act].copy(), sib_end[act].copy(), sib[act]
            mine, left = at[act], (run[act] & 1) == 1  # the sibling of an odd run stands left: equals stay before
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                before = self.less(at[mid], mine[open_], left[open_])
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            place = index.copy()
            place[act] = begin[act] + (run[act] & ~1) * width + (rel[act] - run[act] * width) + (lo - base)
            moved = np.empty_like(at)
            moved[place] = at
            at, width = moved, width * 2
        return at

    def repeats(self, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Which of the windows (sorted by bucket) have an equal one in their bucket; by position in the array."""
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        size = np.diff(np.append(first, len(bucket)))
        begin = np.repeat(first, size)
        keep = np.repeat(size, size) > 1
        kept = np.flatnonzero(keep)
        if not len(kept):
            return np.zeros(0, np.int64)
        shift = np.cumsum(keep) - 1
        b = shift[begin[kept]]
        n = np.repeat(size, size)[kept]
        ordered = self.sort(at[kept], b, b + n)
        x, y = ordered[:-1], ordered[1:]
        pair = np.flatnonzero((b[1:] == b[:-1]) & (self.extension(x, y) >= self.length))
        # verify on the bytes, in pieces of bounded size
        good = np.zeros(len(pair), bool)
        for i in range(0, len(pair), 4096):
            k = pair[i : i + 4096]
            span = np.arange(self.length)
            good[i : i + 4096] = (self.data[x[k, None] + span] == self.data[y[k, None] + span]).all(axis=1)
        pair = pair[good]
        return np.unique(np.concatenate([x[pair], y[pair]]))


def _compare(rows: list[tuple]) -> Iterator[tuple[int, int, int, int, int]]:
    """(g, f1, f2, first, last place of a repeat against the anchor) of runs (bucket, g, f1, f2, n, anchor in
    bytes, bytes, least and past greatest distance of the windows to compare)."""
    data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    size = np.array([len(r[6]) for r in rows], np.int64)
    anchor, low, high = (np.array([r[k] for r in rows], np.int64) for k in (5, 7, 8))
    base = np.cumsum(size) - size
    begin = np.maximum(anchor - high + 1, 0)
    windows = np.minimum(size - LENGTH, anchor - low) - begin + 1
    owner = np.repeat(np.arange(len(rows)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows - begin, windows)
    _, group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
    bucket = group[owner] * 1024 + anchor[owner] - at
    order = np.argsort(bucket, kind="stable")
    pos = base[owner] + at
    again = SuffixSort(data, LENGTH).repeats(pos[order], bucket[order])
    if not len(again):
        return
    who = np.searchsorted(base, again, "right") - 1
    where = again - base[who] - anchor[who]
    first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
    for w, a, b in zip(who[first], np.minimum.reduceat(where, first), np.maximum.reduceat(where, first)):
        if rows[w][4] == 1:
            yield *rows[w][1:4], int(a), int(b)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in the order of buckets; buckets are taken together up to a bounded number of bytes."""
    held: list[tuple] = []
    size, b = 0, None

    def out() -> pa.RecordBatch:
        found = list(_compare(held))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(5)], ["g", "f1", "f2", "first", "last"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("b", "g", "f1", "f2", "n", "at", "span", "low", "high")]
        for row in zip(*columns):
            if row[0] != b and size > 1 << 19:
                yield out()
                held, size = [], 0
            b = row[0]
            held.append(row)
            size += len(row[6])
    if held:
        yield out()


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs in the halves of their distances that they have windows in, with the digest of the bytes
    that all windows of the half share."""
    for batch in batches:
        rows, low, high, shared = [], [], [], []
        for k, (at, lo, hi, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "low", "high", "size")))):
            span = batch.column("span")[k].as_buffer()
            mid = (lo + hi) // 2
            for x, y in ((lo, mid), (mid, hi)):
                if x <= at and y - 1 >= at - (size - LENGTH):
                    rows.append(k)
                    low.append(x)
                    high.append(y)
                    shared.append(memoryview(span)[at - x : at - y + 1 + LENGTH])
        k1, k2 = _digests(shared)
        of = pa.array(rows, pa.int64())
        kept = ("g", "f1", "f2", "n", "at", "span")
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in kept), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(k1), pa.array(k2)], [*kept, "low", "high", "k1", "k2"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, found = batch.column("text"), [[] for _ in range(7)]
        for k, wanted in enumerate(batch.column("wanted").to_pylist()):
            raw = text[k].as_py()
            for w in wanted:
                for col, v in zip(found, (w["g"], w["f1"], w["f2"], w["n"], w["m"], w["a"] - w["lo"], raw[w["lo"] : w["hi"] + LENGTH])):
                    col.append(v)
        kinds = (*[pa.int64()] * 6, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], ["g", "f1", "f2", "n", "m", "at", "span"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        off, data = buffers(batch.column("text"))
        removed, n_spans, digests = [], [], []
        for k, cuts in enumerate(batch.column("cuts").to_pylist()):
            raw = data[off[k] : off[k + 1]]
            keep, spans, reach = hashlib.sha256(), 0, 0
            gone = 0
            for lo, hi in sorted((c["x"], c["y"]) for c in cuts or ()):
                lo, hi = min(lo, len(raw)), min(hi, len(raw))
                if hi <= reach and spans:
                    continue
                if lo > reach or not spans:
                    keep.update(raw[reach:lo])
                    spans += hi > lo
                    gone += hi - lo
                else:
                    gone += hi - reach
                reach = hi
            keep.update(raw[reach:])
            removed.append(gone)
            n_spans.append(spans)
            digests.append(keep.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


_BUCKETS = "b long, g long, f1 long, f2 long, n long, at long, span binary, low long, high long"
_FOUND = "g long, f1 long, f2 long, first long, last long"


def _dealt(hot: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(buckets to sort, repeats found) of runs of anchors that have more than BUCKET of them."""
    key = ["g", "low", "k1", "k2"]
    buckets, found, now = [], [], hot.select("g", "f1", "f2", "n", "at", "span", F.lit(0).cast("long").alias("low"), F.lit(PLACES).cast("long").alias("high"))
    while not now.isEmpty():
        halves = now.withColumn("size", F.length("span")).mapInArrow(_halves, "g long, f1 long, f2 long, n long, at long, span binary, low long, high long, k1 long, k2 long")
        counts = halves.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).filter("held > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = halves.withColumn("salt", F.pmod("f1", F.lit(SALTS)).cast("int"))
        rows = materialize(salted.join(counts.hint("merge"), [*key, "salt"]).withColumn("b", F.xxhash64(*key)), "suffix-halves")
        found.append(rows.filter("high = low + 1 AND n = 1").select("g", "f1", "f2", (-F.col("low")).alias("first"), (-F.col("low")).alias("last")))
        wide = rows.filter("high > low + 1")
        buckets.append(wide.filter(F.col("held") <= BUCKET).select("b", "g", "f1", "f2", "n", "at", "span", "low", "high"))
        now = wide.filter(F.col("held") > BUCKET).select("g", "f1", "f2", "n", "at", "span", "low", "high")
    return buckets, found


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t, text: an id and the hash of its text stand for a row; rows equal in both lose the same bytes."""
    texts = id_text(docs, id_col, text_col)
    return texts.select("id", F.xxhash64("text").alias("t"), "text")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, lo, hi): byte intervals that go of the texts with that id and hash; they may overlap."""
    texts = _keyed(docs, id_col, text_col)
    id_type = texts.schema["id"].dataType.simpleString()
    runs = materialize(texts.mapInArrow(_run_rows, f"id {id_type}, t long, g long, f1 long, f2 long, a long, lo long, hi long"), "suffix-runs")
    key = F.xxhash64("id", "t", "lo")
    by_run = runs.groupBy("g", "f1", "f2").agg(F.count(F.lit(1)).alias("n"), *(F.min_by(c, key).alias(c) for c in ("id", "t", "a", "lo", "hi")))
    several = by_run.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).filter("m > 1 AND least = 1").select("g", "m")
    classes = materialize(by_run.join(several.hint("merge"), "g", "left").filter("n > 1 OR m IS NOT NULL"), "suffix-classes")

    unsure = classes.filter("m IS NOT NULL").select("id", "t", F.struct("g", "f1", "f2", "n", "m", "a", "lo", "hi").alias("w"))
    wanted = unsure.groupBy("id", "t").agg(F.collect_list("w").alias("wanted")).withColumnsRenamed({"id": "wanted_id", "t": "wanted_t"})
    one = texts.dropDuplicates(["id", "t"]) if _repeats_ids(docs, id_col) else texts
    spans = one.join(wanted.hint("merge"), one["id"].eqNullSafe(F.col("wanted_id")) & (one["t"] == F.col("wanted_t"))).select("text", "wanted")
    spans = materialize(spans.mapInArrow(_spans, "g long, f1 long, f2 long, n long, m long, at long, span binary"), "suffix-spans")
    few = spans.filter(F.col("m") <= BUCKET).select(F.col("g").alias("b"), "g", "f1", "f2", "n", "at", "span", F.lit(0).cast("long").alias("low"), F.lit(PLACES).cast("long").alias("high"))
    buckets, found = _dealt(spans.filter(F.col("m") > BUCKET))
    for more in buckets:
        few = few.union(more)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = few.repartition(parts, "b").sortWithinPartitions("b").mapInArrow(_compared, _FOUND)
    for more in found:
        partial = partial.union(more)

    whole = classes.filter("n > 1").select("g", "f1", "f2", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    lo = F.coalesce(F.col("a") + F.col("first"), F.col("lo"))
    hi = F.coalesce(F.col("a") + F.col("last"), F.col("hi")) + LENGTH
    return runs.join(whole.union(partial).hint("merge"), ["g", "f1", "f2"]).select("id", "t", lo.alias("x"), hi.alias("y"))


def _repeats_ids(docs: DataFrame, id_col: str) -> bool:
    ids = docs.select(F.col(f"`{id_col}`").alias("id"))
    return not ids.groupBy("id").count().filter("count > 1").isEmpty()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256."""
    cuts = repeated_spans(docs, id_col, text_col).groupBy("id", "t").agg(F.collect_set(F.struct("x", "y")).alias("cuts")).withColumnsRenamed({"id": "cut_id", "t": "cut_t"})
    texts = _keyed(docs, id_col, text_col)
    id_type = texts.schema["id"].dataType.simpleString()
    joined = texts.join(cuts.hint("merge"), texts["id"].eqNullSafe(F.col("cut_id")) & (texts["t"] == F.col("cut_t")), "left").select("id", "text", "cuts")
    return joined.mapInArrow(_cut, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
