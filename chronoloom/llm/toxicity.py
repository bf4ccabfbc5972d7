"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins a learned vector of the word and the sum of learned vectors of its character
4-grams, so unseen words are read by their characters. Every whole text is cut into all windows of WINDOW
words that overlap by half; the network reads each in both directions, attention pools the states, and a
text's score is that of its most toxic window (multiple-instance learning: in training, too, a text
speaks through its highest window).

Training uses at most MOST_TOXIC and MOST_CLEAN labelled rows, the first in the order of a hash of their
ids, of each kind those that hold at most MOST_BYTES together, whole texts of at most LONGEST bytes; the
output is corrected to the share of toxic rows in all training labels. Rows with crc32(id as
text) mod 5 = 0 are held out. Labels, language, source and id never enter a score. The fitted network (a
few MB, bounded by MOST_WORDS and MOST_GRAMS) travels with the scoring tasks.

Defined cases: null counts as empty; a text without words is one empty window; null labels are ignored;
without labels of both kinds every score is 0; repeated rows are scored each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import blocks, buffers, id_text, spaced
from chronoloom.llm.hashing import LOWER, NOT_ALNUM, words_at
from chronoloom.llm.quality import held_out

WINDOW, STEP = 24, 12
WORD_DIM, GRAM_DIM, HIDDEN = 6, 8, 8
MOST_TOXIC, MOST_CLEAN = 1500, 3000
#: Bytes of the texts of each kind that are learned from, and of one of them: the driver's memory is bounded.
MOST_BYTES, LONGEST = 16 << 20, 1 << 20
MOST_WORDS, MOST_GRAMS = 60_000, 40_000
EPOCHS, BATCH, RATE = 8, 128, 0.01
#: Passes over few rows are repeated until so many steps are made.
LEAST_STEPS = 190
#: Share of words read without their own vector in training; weight decay of the vectors.
DROPPED, DECAY = 0.3, 1e-3
THRESHOLD = 0.5
_ROWS = 4096


def _lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Position + 1 of each value in the sorted keys; 0 where it is not there."""
    if not len(keys):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at + 1, 0)


class Words:
    """The distinct words of a block of texts, the words' character 4-grams, and all windows."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        h, lo, hi = words_at(data, NOT_ALNUM)
        self.keys, first, self.of = np.unique(h, return_index=True, return_inverse=True)
        low = np.full(len(data) + 4, 32, np.uint8)
        low[1:-3] = np.where(NOT_ALNUM[data], 32, LOWER[data])  # position p of data is p + 1 here
        n = np.maximum(hi - lo - 1, 1)[first]
        self.ptr = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(lo[first] - self.ptr[:-1], n) + np.arange(self.ptr[-1])
        self.grams = np.zeros(len(at), np.uint32)
        for k in range(4):
            self.grams = self.grams << np.uint32(8) | low[at + k]
        del h, low, at
        cut = np.searchsorted(lo, starts)
        self.cut, words = cut, np.diff(cut)
        per = np.maximum(1, -(-(words - WINDOW) // STEP) + 1)
        self.first = np.concatenate(([0], np.cumsum(per)))
        owner = np.repeat(np.arange(len(words)), per)
        begin = cut[owner] + (np.arange(self.first[-1]) - self.first[owner]) * STEP
        at = (begin[:, None] + np.arange(WINDOW)).astype(np.int32)
        self.real = at < cut[owner + 1][:, None]
        at[~self.real] = len(self.of)
        self.windows = np.append(self.of, len(self.keys)).astype(np.int32)[at]

    def cut_out(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of some windows, and which places are within the text."""
        return self.windows[chosen], self.real[chosen]


class JoinedWords:
    """The distinct words, their 4-grams and the windows of many texts, as ``Words`` has them. Texts are read a
    block at a time and windows are cut when they are asked for, so little more than a number a word is held."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        of, keys, grams, size, words, windows = [], [], [], [], [], []
        for i, j in blocks(sizes):
            part = Words(*spaced(np.concatenate(([0], np.cumsum(sizes[i:j]))), np.frombuffer(b"".join(texts[i:j]), np.uint8)))
            of.append(part.of.astype(np.int32))
            keys.append(part.keys)
            grams.append(part.grams)
            size.append(np.diff(part.ptr))
            words.append(np.diff(part.cut))
            windows.append(np.diff(part.first))
        n_keys = [len(k) for k in keys]
        self.keys, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        self.of = np.concatenate([p.astype(np.int32)[o] for p, o in zip(np.split(place, np.cumsum(n_keys)[:-1]), of)])
        size = np.concatenate(size)
        before, n = (np.cumsum(size) - size)[first], size[first]
        self.ptr = np.concatenate(([0], np.cumsum(n)))
        self.grams = np.concatenate(grams)[np.repeat(before - self.ptr[:-1], n) + np.arange(self.ptr[-1])]
        self.cut, self.first = (np.concatenate(([0], np.cumsum(np.concatenate(x)))) for x in (words, windows))

    def cut_out(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.searchsorted(self.first, chosen, "right") - 1
        at = (self.cut[owner] + (chosen - self.first[owner]) * STEP)[:, None] + np.arange(WINDOW)
        real = at < self.cut[owner + 1][:, None]
        windows = np.full(at.shape, len(self.keys), np.int32)
        windows[real] = self.of[at[real]]
        return windows, real


class Network:
    """Parameters, forward and backward passes."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, rng: np.random.Generator):
        self.words, self.grams = words, grams
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        normal = lambda *s: rng.normal(0, 1, s).astype(np.float32)
        self.p = {"word": normal(len(words) + 1, WORD_DIM) * 0.1, "gram": normal(len(grams) + 1, GRAM_DIM) * 0.1, "va": normal(2 * h) * 0.3, "wo": normal(2 * h) * 0.5, "bo": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"W{k}": normal(d, 3 * h) / np.sqrt(d).astype(np.float32), f"U{k}": normal(h, 3 * h) / np.sqrt(h).astype(np.float32), f"c{k}": np.zeros(3 * h, np.float32)}
        self.p["word"][0] = self.p["gram"][0] = 0
        self.shift = 0.0

    def rows(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        return _lookup(self.words, w.keys), _lookup(self.grams, w.grams)

    def inputs(self, w: Words, word_rows: np.ndarray, gram_rows: np.ndarray) -> np.ndarray:
        """One input vector per distinct word, and zeros for the place beyond a text's end."""
        x = np.zeros((len(w.keys) + 1, WORD_DIM + GRAM_DIM), np.float32)
        if len(w.keys):
            x[:-1, :WORD_DIM] = self.p["word"][word_rows]
            x[:-1, WORD_DIM:] = np.add.reduceat(self.p["gram"][gram_rows], w.ptr[:-1]) * np.float32(0.3)
        return x

    def some_inputs(self, w: Words | JoinedWords, used: np.ndarray, words: np.ndarray, known: np.ndarray, gram_rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Input vectors of ``used``: of its ``words`` (with their rows ``known``), and zeros for the place beyond
        a text's end; and the words' grams and how many each has."""
        n = w.ptr[words + 1] - w.ptr[words]
        first = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
        grams = gram_rows[np.repeat(w.ptr[words] - first, n) + np.arange(n.sum())]
        x = np.zeros((len(used), WORD_DIM + GRAM_DIM), np.float32)
        x[: len(words), :WORD_DIM] = self.p["word"][known]
        if len(words):
            x[: len(words), WORD_DIM:] = np.add.reduceat(self.p["gram"][grams], first) * np.float32(0.3)
        return x, grams, n

    def in_lots(self, w: JoinedWords, word_rows: np.ndarray, gram_rows: np.ndarray, of) -> np.ndarray:
        """``of`` (input vectors, windows, real) of all windows, some at a time with the vectors of their words alone."""
        out = []
        for i in range(0, int(w.first[-1]), _ROWS):
            windows, real = w.cut_out(np.arange(i, min(i + _ROWS, int(w.first[-1]))))
            used, windows = np.unique(windows, return_inverse=True)
            words = used[used < len(w.keys)]
            out.append(of(self.some_inputs(w, used, words, word_rows[words], gram_rows)[0], windows.reshape(-1, WINDOW), real))
        return np.concatenate(out)

    def run(self, gates: dict[str, np.ndarray], windows: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of the windows; with ``keep``, what the backward pass needs."""
        n, h = len(windows), HIDDEN
        states, trace = np.empty((WINDOW, n, 2 * h), np.float32), {}
        for k, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            state, U = np.zeros((n, h), np.float32), self.p[f"U{k}"]
            side = slice(0, h) if k == "f" else slice(h, 2 * h)
            for t in order:
                g, u = gates[k][windows[:, t]], state @ U
                rz = np.tanh((g[:, : 2 * h] + u[:, : 2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
                r, z = rz[:, :h], rz[:, h:]
                new = np.tanh(g[:, 2 * h :] + r * u[:, 2 * h :])
                if keep:
                    trace[k, t] = (state, r, z, new, u[:, 2 * h :])
                state = new + z * (state - new)
                states[t, :, side] = state
        energy = states @ self.p["va"]
        energy = np.where(real.T, energy, np.float32(-1e9))
        weight = np.exp(energy - energy.max(0)) * real.T
        weight /= np.maximum(weight.sum(0), np.float32(1e-9))
        pooled = (states * weight[:, :, None]).sum(0)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, states, weight, pooled, trace) if keep else logit

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {k: x @ self.p[f"W{k}"] + self.p[f"c{k}"] for k in "fb"}

    def logits(self, w: Words) -> np.ndarray:
        """Logit of every window."""
        gates = self.gates(self.inputs(w, *self.rows(w)))
        parts = [self.run(gates, w.windows[i : i + _ROWS], w.real[i : i + _ROWS]) for i in range(0, len(w.windows), _ROWS)]
        return np.concatenate(parts)

    def gradients(self, w: Words, word_rows: np.ndarray, gram_rows: np.ndarray, chosen: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss of some windows. Some words are read by their characters only."""
        windows, real = w.cut_out(chosen)
        used, windows = np.unique(windows, return_inverse=True)
        windows = windows.reshape(-1, WINDOW)
        words = used[used < len(w.keys)]
        known = np.where(rng.random(len(words)) < DROPPED, 0, word_rows[words])
        x, grams, n = self.some_inputs(w, used, words, known, gram_rows)
        gates = self.gates(x)
        logit, states, alpha, pooled, trace = self.run(gates, windows, real, keep=True)
        h, g = HIDDEN, {}
        dl = ((1 / (1 + np.exp(-logit)) - y) * weight / len(y)).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dpool = dl[:, None] * self.p["wo"]
        dalpha = (states * dpool).sum(2)
        denergy = alpha * (dalpha - (alpha * dalpha).sum(0))
        dstates = alpha[:, :, None] * dpool + denergy[:, :, None] * self.p["va"]
        g["va"] = np.einsum("tn,tnh->h", denergy, states)
        dx = np.zeros_like(x)
        by_word = np.argsort(windows.ravel(), kind="stable")
        starts = np.searchsorted(windows.ravel()[by_word], np.arange(len(used)))
        for k, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            side = slice(0, h) if k == "f" else slice(h, 2 * h)
            U, dU, steps = self.p[f"U{k}"], np.zeros_like(self.p[f"U{k}"]), np.empty((len(chosen), WINDOW, 3 * h), np.float32)
            carry = np.zeros((len(chosen), h), np.float32)
            for t in order:
                before, r, z, new, un = trace[k, t]
                ds = dstates[t, :, side] + carry
                dnew = ds * (1 - z) * (1 - new * new)
                dz = ds * (before - new) * z * (1 - z)
                dr = dnew * un * r * (1 - r)
                du = np.concatenate([dr, dz, dnew * r], axis=1)
                carry = ds * z + du @ U.T
                dU += before.T @ du
                steps[:, t] = np.concatenate([dr, dz, dnew], axis=1)
            dg = np.add.reduceat(steps.reshape(-1, 3 * h)[by_word], starts)
            g[f"U{k}"], g[f"W{k}"], g[f"c{k}"] = dU, x.T @ dg, dg.sum(0)
            dx += dg @ self.p[f"W{k}"].T
        g["word"], g["gram"] = self.p["word"] * np.float32(DECAY), self.p["gram"] * np.float32(DECAY)
        np.add.at(g["word"], known, dx[: len(words), :WORD_DIM])
        np.add.at(g["gram"], grams, np.repeat(dx[: len(words), WORD_DIM:] * np.float32(0.3), n, axis=0))
        g["word"][0] = g["gram"][0] = 0
        return g


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] += np.float32(0.1) * (x - self.m[k])
            self.v[k] += np.float32(0.01) * (x * x - self.v[k])
            p[k] -= np.float32(rate) * (self.m[k] / np.float32(1 - 0.9**self.t)) / (np.sqrt(self.v[k] / np.float32(1 - 0.99**self.t)) + np.float32(1e-6))


def _odds(rows_of, y: np.ndarray, n: int, step: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the smoothed log odds of toxic texts that have it, and how many texts do.
    ``rows_of(i, j)`` gives (rows, text numbers) of the texts i to j; a few are held at a time."""
    toxic, clean = np.zeros(n), np.zeros(n)
    for i in range(0, len(y), step):
        rows, text = rows_of(i, min(i + step, len(y)))
        seen = np.unique(rows.astype(np.int64) * len(y) + text)
        row, of = seen // len(y), seen % len(y)
        np.add.at(toxic, row, y[of])
        np.add.at(clean, row, 1 - y[of])
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((1 - y).sum() + 1))
    n_texts = toxic + clean
    return odds * n_texts / (n_texts + 10), n_texts


def train(texts: list[bytes], y: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """Fit on whole texts; ``share`` is the share of toxic rows to which the output is corrected."""
    rng = np.random.default_rng(seed)
    w = JoinedWords(texts)
    y = y.astype(np.float64)

    def words_of(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        return w.of[w.cut[i] : w.cut[j]], np.repeat(np.arange(i, j), np.diff(w.cut[i : j + 1]))

    odds, df = _odds(words_of, y, len(w.keys))
    keep = np.flatnonzero(df >= 3)
    keep = np.sort(keep[np.argsort(-df[keep], kind="stable")[:MOST_WORDS]])
    codes, gram_of = np.unique(w.grams, return_inverse=True)

    def grams_of(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        words, text = words_of(i, j)
        n = (w.ptr[words + 1] - w.ptr[words]).astype(np.int64)
        at = np.repeat(w.ptr[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return gram_of[at], np.repeat(text, n)

    gram_odds, gram_df = _odds(grams_of, y, len(codes))
    keep_grams = np.flatnonzero(gram_df >= 4)
    keep_grams = np.sort(keep_grams[np.argsort(-gram_df[keep_grams], kind="stable")[:MOST_GRAMS]])
    net = Network(w.keys[keep], codes[keep_grams], rng)
    # the first number of a vector starts at the log odds, which the passes then refine
    net.p["word"][1:, 0] = np.clip(odds[keep], -3, 3) / 2
    net.p["gram"][1:, 0] = np.clip(gram_odds[keep_grams], -3, 3) / 2
    word_rows, gram_rows = net.rows(w)
    hint = net.in_lots(w, word_rows, gram_rows, lambda x, windows, real: np.where(real, (x[:, 0] + x[:, WORD_DIM])[windows], -9).max(1))
    adam, positive = Adam(net.p), max(1.0, y.sum())
    weight = np.where(y == 1, (len(y) - y.sum()) / positive, 1.0)
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(y) // BATCH)))
    every = max(2, epochs // 4)
    for epoch in range(epochs):
        if epoch % every == 0:
            value = hint if epoch == 0 else net.in_lots(w, word_rows, gram_rows, lambda x, windows, real: net.run(net.gates(x), windows, real))
            top = w.first[:-1] + np.array([int(value[a:b].argmax()) for a, b in zip(w.first, w.first[1:])])
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            # a clean text also speaks through a random window
            clean = some[y[some] == 0]
            other = w.first[clean] + (rng.random(len(clean)) * np.diff(w.first)[clean]).astype(np.int64)
            chosen = np.concatenate([top[some], other])
            target = np.concatenate([y[some], np.zeros(len(clean))])
            adam.step(net.p, net.gradients(w, word_rows, gram_rows, chosen, target, np.concatenate([weight[some], np.ones(len(clean))]), rng), RATE * (1 - epoch / epochs))
    share = min(max(share, 1e-6), 1 - 1e-6)
    net.shift = float(np.log(share / (1 - share)))  # the classes weigh the same in training
    return net


def score_texts(net: Network, off: np.ndarray, data: np.ndarray) -> np.ndarray:
    w = Words(*spaced(off, data))
    top = np.maximum.reduceat(net.logits(w), w.first[:-1]).astype(np.float64) + net.shift
    return 1 / (1 + np.exp(-np.clip(top, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> Network | None:
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL").distinct().filter(~held_out(F.col("id")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return None
    order = (F.xxhash64("id"), F.col("id"))
    some = known.filter("y = 1").orderBy(*order).limit(MOST_TOXIC).union(known.filter("y = 0").orderBy(*order).limit(MOST_CLEAN))
    # at most MOST_TOXIC + MOST_CLEAN ids and labels are broadcast
    texts = id_text(docs, id_col, text_col).join(F.broadcast(some), "id").select("id", "y", "text").dropDuplicates(["id", "y"])
    texts = texts.withColumn("size", F.octet_length("text")).filter(F.col("size") <= LONGEST)
    so_far = F.sum("size").over(Window.partitionBy("y").orderBy(*order))
    rows = texts.withColumn("so_far", so_far).filter(F.col("so_far") <= MOST_BYTES).select("id", "y", "text").collect()
    rows = sorted(rows, key=lambda r: str(r["id"]))
    y = np.array([r["y"] for r in rows])
    if not len(rows) or y.min() == y.max():
        return None
    chosen = [bytes(r["text"]) for r in rows]
    del rows
    return train(chosen, y, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, training_docs: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted. Labels are joined to the texts of
    ``training_docs`` (``docs`` where not given)."""
    net = fit(docs if training_docs is None else training_docs, labels, label_col, id_col, text_col)
    texts = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = buffers(b.column("text"))
            if net is None:
                scores = [np.zeros(b.num_rows)]
            else:
                scores = [score_texts(net, off[i : j + 1], data) for i, j in blocks(np.diff(off), 1 << 19)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["id", "held_out", "score"])

    id_type = texts.schema["id"].dataType.simpleString()
    out = texts.select("id", held_out(F.col("id")).alias("held_out"), "text").mapInArrow(run, f"id {id_type}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; texts are not moved."""
    net = fit(docs, labels, label_col, id_col, text_col)
    if net is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(text_col).fill_null("").cast(pa.large_binary() if pa.types.is_large_string(b.column(text_col).type) else pa.binary())
            off, data = buffers(text)
            scores = np.concatenate([*(score_texts(net, off[i : j + 1], data) for i, j in blocks(np.diff(off), 1 << 19)), np.zeros(0)])
            yield b.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
