"""Masked pseudo-likelihood of documents under a bidirectional window network.

Each word is predicted from the SIDE words before and after it; a document's score is the sum of the
conditional log-probabilities of all its words.

1. Words of all texts are counted. The KNOWN most frequent ones (ties by hash) are tokens of the network;
   every other word falls in one of RARE hashed tokens. The counts also start the output biases.
2. The network (token vectors, one hidden layer, a softmax over CLASSES groups and one within the group)
   is trained in numpy, in rounds: in each round every partition starts from the shared parameters,
   passes once over its blocks of that round, and the results are averaged, weighted by words. The blocks
   of all rounds together are the whole corpus.
3. Every whole text is scored with the averaged network. A word of a hashed token adds the logarithm of
   its own share of that token, from the counts of all words: shares of a token sum to 1, one count of
   which is kept for words that were never counted (spread over as many as there are counted ones, and
   one). The counts of the most frequent words, at most COMMON of them at any corpus size (cut between
   classes of equal counts), travel with the tasks. Scored blocks are written once; their other rare words
   are dealt by hash into lots, each lot looks them up in its counts, and the sums go back to the block. A
   lot holds at most about LOT_WORDS words.

What is gathered grows with the input: the word counts, and one parameter set from each partition and
round (summed on the executors; the driver gets one set of a fixed size).

Defined cases: null counts as empty; a text without words has n_tokens 0, log_likelihood 0 and a null
mean; repeated rows count and are scored each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import SLICES, blocks, buffers, id_text, materialize, signed, slices, spaced, tree_sum
from chronoloom.llm.hashing import word_hashes

KNOWN, RARE, CLASSES = 1536, 512, 64
TOKENS = KNOWN + RARE
PER_CLASS = TOKENS // CLASSES
SIDE, DIM, HIDDEN = 3, 12, 24
ROUNDS, BATCH, RATE = 2, 4096, 0.01
_BLOCK = 1 << 19
#: Most words whose counts travel with the tasks (16 bytes each).
COMMON = 200_000
#: Fewest lots of rare words, and counted words that a lot holds in the mean.
LOTS, LOT_WORDS = 256, 400_000
#: Scores beyond this bound count as this much.
_LIMIT = 60
_RARE_WORD = np.dtype([("h", "<u8"), ("k", "<i4")])
_PART_SUM = np.dtype([("k", "<i4"), ("s", "<f8")])


class Vocabulary:
    def __init__(self, frequent: np.ndarray, counts: np.ndarray, distinct: np.ndarray):
        """``frequent``: word hashes by falling frequency; ``counts``: of all tokens; ``distinct``: different
        words of the hashed tokens."""
        self.order = np.argsort(frequent, kind="stable")
        self.sorted, self.counts, self.distinct = frequent[self.order], counts, distinct

    #: Hashes, sorted, and counts of the words that tasks look up themselves, and the class of counts they begin at.
    common: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    common_from = 1 << 30

    def log_shares(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log-probability of rare words within their token; ``n`` is their count, 0 of a word never counted."""
        k = (h % np.uint64(RARE)).astype(np.int64)
        return np.log(np.where(n > 0, n, 1 / (self.distinct[k] + 1.0))) - np.log(self.counts[KNOWN + k] + 1.0)

    def tokens(self, h: np.ndarray) -> np.ndarray:
        rare = KNOWN + (h % np.uint64(RARE)).astype(np.int64)
        if not len(self.sorted):
            return rare
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], rare)


def contexts(tokens: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The 2 * SIDE neighbours of every token of neighbouring texts; TOKENS beyond a text's ends."""
    n = len(tokens)
    text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    at, out = np.arange(n), np.full((n, 2 * SIDE), TOKENS, np.int16)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        p = at + d
        ok = (p >= cut[text]) & (p < cut[text + 1])
        out[ok, k] = tokens[p[ok]]
    return out


class WindowNetwork:
    SHAPES = {"E": (TOKENS + 1, DIM), "W": (2 * SIDE * DIM, HIDDEN), "b": (HIDDEN,), "C": (HIDDEN, CLASSES), "c": (CLASSES,), "V": (CLASSES, HIDDEN, PER_CLASS), "v": (CLASSES, PER_CLASS)}

    def __init__(self, counts: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(0, 1, s) * {"E": 0.3, "W": 1 / np.sqrt(2 * SIDE * DIM), "C": 0.1, "V": 0.1}.get(k, 0)).astype(np.float32) for k, s in self.SHAPES.items()}
        c = (counts + 1.0).reshape(CLASSES, PER_CLASS)
        self.p["c"] = np.log(c.sum(1) / c.sum()).astype(np.float32)
        self.p["v"] = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES]).astype(np.float64)

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for k, s in self.SHAPES.items():
            n = int(np.prod(s))
            self.p[k] = vector[at : at + n].reshape(s).astype(np.float32)
            at += n

    def hidden(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.p["E"][ctx].reshape(len(ctx), -1)
        return x, np.tanh(x @ self.p["W"] + self.p["b"])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        np.clip(z, -_LIMIT, _LIMIT, out=z)
        np.exp(z, out=z)
        z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
        return z

    @staticmethod
    def _by_class(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """The order of rows by class, the classes in that order, and (class, from, to) of each one there."""
        cls = (tokens // PER_CLASS).astype(np.uint8)
        order = np.argsort(cls, kind="stable")
        cls = cls[order]
        at = np.searchsorted(cls, np.arange(CLASSES + 1))
        return order, cls, [(k, at[k], at[k + 1]) for k in range(CLASSES) if at[k + 1] > at[k]]

    def _within(self, h: np.ndarray, cls: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """Scores of the words of each row's class; rows are in the order of classes."""
        z = np.empty((len(h), PER_CLASS), np.float32)
        for k, i, j in runs:
            np.matmul(h[i:j], self.p["V"][k], out=z[i:j])
        z += self.p["v"][cls]
        return z

    @staticmethod
    def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
        np.clip(z, -_LIMIT, _LIMIT, out=z)
        own = z[np.arange(len(at)), at]
        np.exp(z, out=z)
        return own - np.log(z @ np.ones(z.shape[1], z.dtype))

    def log_probabilities(self, ctx: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        _, h = self.hidden(ctx)
        out = self._log_softmax_at(h @ self.p["C"] + self.p["c"], tokens // PER_CLASS).astype(np.float64)
        order, cls, runs = self._by_class(tokens)
        out[order] += self._log_softmax_at(self._within(h[order], cls, runs), tokens[order] % PER_CLASS)
        return out

    def gradients(self, ctx: np.ndarray, tokens: np.ndarray) -> dict[str, np.ndarray]:
        n, rows = np.float32(len(tokens)), np.arange(len(tokens))
        x, h = self.hidden(ctx)
        q = self._softmax(h @ self.p["C"] + self.p["c"])
        q[rows, tokens // PER_CLASS] -= 1
        q /= n
        g = {"C": h.T @ q, "c": q.sum(0), "V": np.zeros_like(self.p["V"]), "v": np.zeros_like(self.p["v"])}
        dh = q @ self.p["C"].T
        order, cls, runs = self._by_class(tokens)
        own = h[order]
        r = self._softmax(self._within(own, cls, runs))
        r[rows, tokens[order] % PER_CLASS] -= 1
        r /= n
        back = np.empty_like(own)
        for k, i, j in runs:
            np.matmul(own[i:j].T, r[i:j], out=g["V"][k])
            np.matmul(r[i:j], self.p["V"][k].T, out=back[i:j])
        g["v"][[k for k, _, _ in runs]] = np.add.reduceat(r, [i for _, i, _ in runs])
        dh[order] += back
        dz = dh * (1 - h * h)
        g["W"], g["b"] = x.T @ dz, dz.sum(0)
        dx = (dz @ self.p["W"].T).reshape(-1, DIM)
        flat = ctx.ravel()
        order = np.argsort(flat, kind="stable")
        at = flat[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        g["E"] = np.zeros_like(self.p["E"])
        g["E"][at[first]] = np.add.reduceat(dx[order], first)
        return g


class Trainer:
    """Adam on a WindowNetwork, batch by batch."""

    def __init__(self, net: WindowNetwork):
        self.net, self.t, self.words = net, 0, 0
        self.m = {k: np.zeros(s, np.float32) for k, s in net.SHAPES.items()}
        self.v = {k: np.zeros(s, np.float32) for k, s in net.SHAPES.items()}

    def step(self, ctx: np.ndarray, tokens: np.ndarray) -> None:
        self.t += 1
        self.words += len(tokens)
        rate = np.float32(RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, g in self.net.gradients(ctx, tokens).items():
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.v[k] += np.float32(0.001) * (g * g - self.v[k])
            self.net.p[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))


def _tokenised(batch: pa.RecordBatch, wanted: Callable[[], bool] = lambda: True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, word hashes, where each text's words begin) of the blocks of a batch; ``wanted``
    is asked at each block."""
    off, data = buffers(batch.column("text"))
    for i, j in blocks(np.diff(off), _BLOCK):
        if not wanted():
            continue
        row, starts = spaced(off[i : j + 1], data)
        h, at = word_hashes(row)
        yield i, j, h, np.searchsorted(at, starts)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, h, _ in _tokenised(batch):
            words, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n.astype(np.int64))], ["h", "n"])


def vocabulary(texts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The tokens, and the counts (h, n) of all words."""
    counts = materialize(texts.mapInArrow(_count_rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-counts")
    top = counts.orderBy(F.desc("n"), "h").limit(KNOWN).collect()
    per, distinct = np.zeros(TOKENS), np.zeros(RARE)
    for r in counts.groupBy(F.col("h").bitwiseAND(F.lit(RARE - 1)).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect():
        per[KNOWN + r["k"]], distinct[r["k"]] = r["n"], r["d"]
    for k, r in enumerate(top):
        per[k] = r["n"]
        per[KNOWN + (r["h"] & (RARE - 1))] -= r["n"]
        distinct[r["h"] & (RARE - 1)] -= 1
    words = Vocabulary(np.array([r["h"] for r in top], np.int64).view(np.uint64), per, distinct)
    sizes = sorted(((r["c"], r["n"]) for r in counts.groupBy(_count_class().alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total = 0
    for c, n in sizes:
        total += n
        if total > COMMON:
            break
        words.common_from = c
    found = counts.filter(_count_class() >= words.common_from).select("h", "n").toArrow()
    h, n = (found.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    words.common = (h.view(np.uint64)[order], n[order])
    return words, counts


def _count_class():
    """Counts in a few hundred classes, in their order."""
    return F.floor(F.log2("n") * 8).cast("int")


def fit(texts: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, WindowNetwork, DataFrame]:
    """Train on all words of all texts; the counts of all words come along."""
    words, counts = vocabulary(texts)
    net = WindowNetwork(words.counts)
    for turn in range(rounds):

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            trainer, number = Trainer(net), itertools.count(1)
            for batch in batches:
                for _, _, h, cut in _tokenised(batch, lambda: next(number) % rounds == turn):
                    if not len(h):
                        continue
                    tokens = words.tokens(h)
                    ctx = contexts(tokens, cut)
                    for i in range(0, len(tokens), BATCH):
                        trainer.step(ctx[i : i + BATCH], tokens[i : i + BATCH])
            if trainer.words:
                yield slices(np.append(net.vector() * trainer.words, trainer.words))

        total = tree_sum(texts.mapInArrow(learn, SLICES))
        if total is not None and total[-1] > 0:
            net.load(total[:-1] / total[-1])
    return words, net, counts


def _records(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` neighbouring records each."""
    off = np.concatenate(([0], np.cumsum(sizes * values.dtype.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(values.tobytes())])


def _read_records(col: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The records of neighbouring binary values, and how many each value has."""
    off, data = buffers(col)
    return data[off[0] : off[-1]].view(kind), np.diff(off) // kind.itemsize


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with equal keys."""
    new = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    edges = [0, *(np.flatnonzero(new) + 1), len(keys[0])]
    return ((int(i), int(j)) for i, j in zip(edges, edges[1:]) if j > i)


def _shares(batches: Iterator[pa.RecordBatch], words: Vocabulary) -> Iterator[pa.RecordBatch]:
    """(block, sums) from rows in the order of lot and block: a lot's counts (block -1), then the rare words
    of blocks. The sums are over the words of each text."""
    lot, held, table = None, [], None
    for batch in batches:
        lots, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lot", "block"))
        for i, j in _runs(lots, block < 0):
            if lots[i] != lot:
                lot, held, table = lots[i], [], None
            part = batch.slice(i, j - i)
            if block[i] < 0:
                held.append([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "n")])
                continue
            if table is None:
                h, n = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in held)]) for k in (0, 1))
                h = h.view(np.uint64)
                order = np.argsort(h)
                # a row more, for words that were never counted
                table, held = (h[order], np.append(n[order], 0)), []
            found, sizes = _read_records(part.column("data"), _RARE_WORD)
            h = found["h"]
            at = np.searchsorted(table[0], h)
            at[table[0][np.minimum(at, len(table[0]) - 1)] != h if len(table[0]) else np.ones(len(h), bool)] = len(table[0])
            lp = words.log_shares(h, table[1][at])
            row = np.repeat(np.arange(len(sizes)), sizes)
            first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (found["k"][1:] != found["k"][:-1]))))
            out = np.empty(len(first), _PART_SUM)
            out["k"], out["s"] = found["k"][first], np.add.reduceat(lp, first)
            yield pa.RecordBatch.from_arrays([part.column("block"), _records(out, np.bincount(row[first], minlength=len(sizes)))], ["block", "data"])


def _with_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts from rows in the order of block: the block itself (lot -1), then the sums of its lots."""
    now, total, last = None, np.zeros(0), None

    def done() -> Iterator[pa.RecordBatch]:
        if last is not None:
            yield pa.RecordBatch.from_arrays([last.column("ids")[0].values, last.column("ns")[0].values, pa.array(total)], ["id", "n_tokens", "log_likelihood"])

    for batch in batches:
        block, lots = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "lot"))
        for i, j in _runs(block, lots):
            if lots[i] < 0:
                yield from done()
                now, last = block[i], batch.slice(i, 1)
                total = last.column("lps")[0].values.to_numpy(zero_copy_only=False).copy()
            else:
                assert block[i] == now
                sums, _ = _read_records(batch.column("data").slice(i, j - i), _PART_SUM)
                total += np.bincount(sums["k"], sums["s"], len(total))
    yield from done()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[Vocabulary, WindowNetwork, DataFrame] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, log_likelihood, mean_log_likelihood."""
    texts = id_text(docs, id_col, text_col)
    id_type = texts.schema["id"].dataType.simpleString()
    words, net, counts = model or fit(texts)
    lots = max(LOTS, -(-int(words.distinct.sum()) // LOT_WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, cut in _tokenised(batch):
                tokens = words.tokens(h)
                ctx = contexts(tokens, cut)
                lp = np.concatenate([*(net.log_probabilities(ctx[k : k + BATCH], tokens[k : k + BATCH]) for k in range(0, len(tokens), BATCH)), np.zeros(0)])
                text = np.repeat(np.arange(j - i), np.diff(cut))
                sums = np.bincount(text, lp, j - i).astype(np.float64)
                rare = tokens >= KNOWN
                h, text = h[rare], text[rare]
                if len(words.common[0]):
                    at = np.minimum(np.searchsorted(words.common[0], h), len(words.common[0]) - 1)
                    held = words.common[0][at] == h
                    sums += np.bincount(text[held], words.log_shares(h[held], words.common[1][at[held]]), j - i)
                    h, text = h[~held], text[~held]
                lot = (signed(h) % lots).astype(np.int32)
                order = np.argsort(lot, kind="stable")
                found = np.empty(len(order), _RARE_WORD)
                found["h"], found["k"] = h[order], text[order]
                names, sizes = np.unique(lot, return_counts=True)
                one = lambda col: pa.ListArray.from_arrays(pa.array([0, len(col)], pa.int32()), col)
                dealt = pa.StructArray.from_arrays([pa.array(names.astype(np.int32)), _records(found, sizes)], ["lot", "data"])
                ids = batch.column("id").slice(i, j - i)
                ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
                yield pa.RecordBatch.from_arrays([one(ids), one(pa.array(np.diff(cut), pa.int64())), one(pa.array(sums)), one(dealt)], ["ids", "ns", "lps", "rare"])

    scored = texts.mapInArrow(run, f"ids array<{id_type}>, ns array<bigint>, lps array<double>, rare array<struct<lot int, data binary>>")
    scored = materialize(scored.withColumn("block", F.monotonically_increasing_id()), "lm-blocks")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    null = lambda kind: F.lit(None).cast(kind)
    asked = scored.select("block", F.inline("rare")).select("lot", "block", null("long").alias("h"), null("long").alias("n"), "data")
    known = counts.filter(_count_class() < words.common_from).select(F.pmod("h", F.lit(lots)).cast("int").alias("lot"), F.lit(-1).cast("long").alias("block"), "h", "n", null("binary").alias("data"))
    sums = known.union(asked).repartition(parts, "lot").sortWithinPartitions("lot", "block").mapInArrow(lambda b: _shares(b, words), "block long, data binary")
    of_block = scored.select("block", F.lit(-1).alias("lot"), "ids", "ns", "lps", null("binary").alias("data"))
    of_lots = sums.select("block", F.lit(0).alias("lot"), null(f"array<{id_type}>").alias("ids"), null("array<bigint>").alias("ns"), null("array<double>").alias("lps"), "data")
    out = of_block.union(of_lots).repartition(parts, "block").sortWithinPartitions("block", "lot").mapInArrow(_with_shares, f"id {id_type}, n_tokens long, log_likelihood double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", (F.col("log_likelihood") / F.when(F.col("n_tokens") > 0, F.col("n_tokens"))).alias("mean_log_likelihood"))
