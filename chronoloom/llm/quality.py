"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

1. Statistics of every whole text, from its bytes: shares of byte classes over the text and in its most
   extreme stretch of 512 bytes, word lengths, repetition.
2. ``cos(x W + b)`` with Gaussian W approximates a Gaussian kernel. The normal equations of ridge
   regression are summed in each partition over all labelled training rows, then by groups of partitions,
   then on the driver (one matrix of FEATURES squared at any input size).
3. Isotonic regression over a fixed number of score bins (counts per bin, at any input size) makes the
   ridge score a probability. It is fitted on scores of unseen rows: the training rows are dealt into FOLDS
   by a hash of their ids, and each is scored by the ridge of the other folds (whose normal equations are the
   sums less its own). The final ridge is that of all folds.

Rows with crc32(id as text) mod 5 = 0 are held out. Labels, language, source and id never enter a score.

Defined cases: null counts as empty; an empty text has statistics of zeros and gets a score; null labels
are ignored; without training labels every score is 0.5; repeated rows are scored each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import SLICES, blocks, buffers, id_text, materialize, slices, spaced, tree_sum
from chronoloom.llm.hashing import word_hashes

FEATURES, RIDGE, WIDTH, BINS, THRESHOLD = 384, 1e-3, 0.35, 2000, 0.3
FOLDS = 4
#: How much of the score is the ridge score itself.
TILT = 1e-3
STRETCH = 512

_CLASSES = ("upper", "lower", "digit", "blank", "newline", "stop", "comma", "shout", "symbol", "pipe", "high", "other")


def _class_table() -> np.ndarray:
    t = np.full(256, _CLASSES.index("other"), np.uint8)
    groups = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9, 11, 12, 13), "newline": (10,), "stop": b".", "comma": b",;:", "shout": b"!?", "symbol": b"#$%&*@^~=+<>", "pipe": b"|", "high": range(128, 256)}
    for name, of in groups.items():
        t[list(of)] = _CLASSES.index(name)
    return t


_CLASS = _class_table()
N_STATS = 2 * len(_CLASSES) + 8


def _statistics(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Statistics (texts x N_STATS) of texts with a space after each."""
    n, k = len(starts) - 1, len(_CLASSES)
    out = np.zeros((n, N_STATS), np.float32)
    cls = _CLASS[data]
    size = np.diff(starts) - 1
    # cells: stretches of STRETCH bytes that start anew in each text
    per = np.maximum(1, -(-size // STRETCH))
    first = np.concatenate(([0], np.cumsum(per)))
    owner = np.repeat(np.arange(n), per)
    cell_lo = starts[owner] + (np.arange(first[-1]) - first[owner]) * STRETCH
    cell = np.repeat(np.arange(len(cell_lo)), np.diff(np.append(cell_lo, starts[-1])))
    counts = np.bincount(cell * k + cls, minlength=len(cell_lo) * k).reshape(-1, k).astype(np.float32)
    last = first[1:] - 1
    counts[last, _CLASSES.index("blank")] -= 1  # the space that was put after the text
    total = np.add.reduceat(counts, first[:-1], axis=0)
    length = np.maximum(size, 1)[:, None]
    out[:, :k] = total / length
    share = counts / np.maximum(counts.sum(1, keepdims=True), 64)
    out[:, k : 2 * k] = np.maximum.reduceat(share, first[:-1], axis=0)
    h, at = word_hashes(data)
    cut = np.searchsorted(at, starts)
    words = np.diff(cut)
    again = np.concatenate((h[1:] == h[:-1], [False])).astype(np.float64) if len(h) else np.zeros(0)
    sums = np.concatenate(([0], np.cumsum(again)))
    w = np.maximum(words, 1)
    s = 2 * k
    out[:, s] = np.log1p(size) / 10
    out[:, s + 1] = np.log1p(words) / 10
    out[:, s + 2] = np.minimum(size / w, 50) / 10
    out[:, s + 3] = (sums[cut[1:]] - sums[cut[:-1]]) / w
    for i in range(n):
        own = h[cut[i] : cut[i + 1]]
        if len(own):
            out[i, s + 4] = len(np.unique(own)) / len(own)
            rep = again[cut[i] : cut[i + 1]]
            out[i, s + 5] = np.convolve(rep, np.ones(min(32, len(rep))), "valid").max() / 32
    out[:, s + 6] = total[:, _CLASSES.index("newline")] / w
    out[:, s + 7] = np.sqrt(total[:, _CLASSES.index("stop")] / w)
    return out


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        off, data = buffers(batch.column("text"))
        found = [_statistics(*spaced(off[i : j + 1], data)) for i, j in blocks(np.diff(off))]
        x = np.concatenate(found) if found else np.zeros((0, N_STATS), np.float32)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATS).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "stats"])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    texts = id_text(docs, id_col, text_col)
    return texts.mapInArrow(_stat_rows, f"id {texts.schema['id'].dataType.simpleString()}, stats array<float>")


def held_out(id_col):
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, N_STATS))


class FourierRidge:
    """The fitted model; ``score`` is monotone in the ridge output, by interpolated isotonic steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, width / np.sqrt(len(mean)) * 2, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.theta = np.zeros(features + 1)
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.theta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(weights: np.ndarray, sums: np.ndarray) -> list[tuple[float, float, int, int]]:
    """Pool adjacent violators: (weight, mean, first, last) of each step."""
    steps: list[tuple[float, float, int, int]] = []
    for i, (w, s) in enumerate(zip(weights, sums)):
        if w <= 0:
            continue
        steps.append((w, s / w, i, i))
        while len(steps) > 1 and steps[-2][1] >= steps[-1][1]:
            b, a = steps.pop(), steps.pop()
            steps.append((a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2], b[3]))
    return steps


def fit(stats: DataFrame, labels: DataFrame) -> FourierRidge:
    """``stats``: id, stats; ``labels``: id, label (0 or 1); every row of ``labels`` is used."""
    rows = materialize(labels.join(stats, "id").select("stats", F.col("label").cast("double").alias("y"), F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold")), "quality-train")

    def moments(batches):
        total = np.zeros(1 + 2 * N_STATS)
        for b in batches:
            x = _matrix(b.column("stats"))
            total += np.concatenate(([len(x)], x.sum(0), (x * x).sum(0)))
        yield slices(total)

    m = tree_sum(rows.mapInArrow(moments, SLICES))
    if m is None or m[0] == 0:
        return FourierRidge(np.zeros(N_STATS), np.ones(N_STATS))
    mean = m[1 : 1 + N_STATS] / m[0]
    scale = np.sqrt(np.maximum(m[1 + N_STATS :] / m[0] - mean**2, 1e-6))
    model = FourierRidge(mean, scale)
    d = FEATURES + 1

    def normal(batches):
        total = np.zeros((FOLDS, d, d + 1))
        for b in batches:
            z = model.expand(_matrix(b.column("stats")))
            zy = np.concatenate([z, b.column("y").to_numpy(zero_copy_only=False)[:, None]], axis=1)
            fold = b.column("fold").to_numpy(zero_copy_only=False)
            for k in range(FOLDS):
                total[k] += z[fold == k].T @ zy[fold == k]
        yield slices(total)

    sums = tree_sum(rows.mapInArrow(normal, SLICES)).reshape(FOLDS, d, d + 1)
    solve = lambda a: np.linalg.solve(a[:, :d] + RIDGE * max(a[-1, d - 1], 1.0) * np.eye(d) / d, a[:, d])
    model.theta = solve(sums.sum(0))
    others = np.array([solve(sums.sum(0) - sums[k]) for k in range(FOLDS)])

    def bins(batches):
        total = np.zeros((2, BINS))
        for b in batches:
            theta = others[b.column("fold").to_numpy(zero_copy_only=False)]
            raw = (model.expand(_matrix(b.column("stats"))) * theta).sum(1)
            at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            total[0] += np.bincount(at, minlength=BINS)
            total[1] += np.bincount(at, b.column("y").to_numpy(zero_copy_only=False), minlength=BINS)
        yield slices(total)

    counts = tree_sum(rows.mapInArrow(bins, SLICES)).reshape(2, BINS)
    steps = isotonic(*counts)
    # a step is level from its first to its last bin, and the ridge score breaks ties
    place = lambda bin_: (bin_ + 0.5) / BINS * 2 - 0.5
    ends = [(place(x), (w * y + 0.5) / (w + 1)) for w, y, a, b in steps for x in sorted({a, b})]
    model.knots = np.array([min(-1.0, ends[0][0] - 1), *(x for x, _ in ends), max(2.0, ends[-1][0] + 1)])
    model.values = np.array([ends[0][1], *(y for _, y in ends), ends[-1][1]])
    model.values = (1 - TILT) * np.maximum.accumulate(model.values) + TILT * np.clip((model.knots + 1) / 3, 0, 1)
    return model


def score(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    stats = materialize(statistics(docs, id_col, text_col), "quality-stats")
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).filter("label IS NOT NULL AND id IS NOT NULL").distinct()
    model = fit(stats, known.filter(~held_out(F.col("id"))))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(model.score(_matrix(b.column("stats"))))], ["id", "held_out", "score"])

    id_type = stats.schema["id"].dataType.simpleString()
    out = stats.select("id", held_out(F.col("id")).alias("held_out"), "stats").mapInArrow(run, f"id {id_type}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
