"""Best-fit packing by a configuration linear program over the length histogram.

1. ``token_pieces`` encodes every whole text in the tasks and cuts what is longer than a sequence. Only
   (id, piece, start, length, crc) travels on.
2. The driver gets the histogram of lengths: at most ``capacity`` numbers at any input size. The
   configuration LP (as few sequences as possible, every length covered) is solved by multiplicative
   weights. A length's weight starts at its size, with LONGER more for long ones; each step multiplies it by
   exp(-ETA) to the share of its demand that the step covers, and a length that is covered leaves the system. An
   unbounded-knapsack dynamic program prices the configuration of the greatest weight, and up to MANY within
   SLACK of it that share no length; each is taken as often as covers no length beyond its demand and adds at
   most STEP to the share of the longest one in it.
3. The fractional counts are rounded down, what they leave over goes best-fit into the room of these
   sequences and into new ones, again on the histogram. Best-fit alone is kept where that needs fewer.
4. The plan says for each length which ranks go to which sequences. Ranks are row numbers within (length,
   salt) plus the rows of smaller salts. A length of n rows has about the square root of n salts, so that neither the
   rows of a salt nor the salts of a length grow faster than that, and a common length is dealt over many tasks.

Defined cases: null text counts as empty; an empty text is the end id alone; repeated rows are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import blocks, id_text, materialize

CAPACITY = 2048
#: Words whose ids a worker keeps; longer words are encoded each time.
KNOWN_WORDS, LONG_WORD = 500_000, 64
#: Most rounds of the program; the rate of its weights; most of a length's demand that one step covers; how much
#: more a token of the longest length weighs at first.
ROUNDS, ETA, STEP, LONGER = 800, 0.5, 1.0, 0.05
#: Configurations of one round, and how much less than the best they may weigh.
MANY, SLACK = 32, 0.002


def _bytes(ids: Iterable[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Known(dict):
    """Values by key, made at first use; short keys are kept, and all are dropped when too many are."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONG_WORD:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """Ids of a text as little-endian uint32 bytes.

    The vocabulary's pattern drops white space and never matches across it, so a text's ids are those of
    its words in order. Words are looked up; an unknown one is cut into the pattern's pieces, which are
    looked up in turn, and only a new piece goes through the merges.
    """

    #: The pattern of the vocabulary file's pre-tokenizer.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.cut = regex.compile(self.PATTERN).findall
        # byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ... in order
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.letters = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
        self.pieces = Known(self._piece)
        self.words = Known(self._word)

    def whole(self, text: str) -> bytes:
        """The tokenizer's own ids, without any shortcut."""
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return _bytes([t.id for t in self.merge(mapped)])

    def _word(self, word: str) -> bytes:
        if "<|" in word:
            return self.whole(word)
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        low = word.lower() if "\u03a3" not in word else "".join(c.lower() for c in word)
        if low.isalpha():
            return self.pieces[low]
        return b"".join([self.pieces[p] for p in self.cut(low)])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece; ``vocabulary`` is the path of a tokenizer file."""
    texts = id_text(docs, id_col, text_col, binary=False)
    id_type = texts.schema["id"].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary)
        for batch in batches:
            texts = batch.column("text")
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
            for i, j in blocks(sizes):
                rows, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(map(encoder.encode, texts.slice(i, j - i).to_pylist())):
                    ids += end
                    for p, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[lo : lo + 4 * capacity]
                        rows.append(i + k)
                        piece.append(p)
                        start.append(lo // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    return texts.mapInArrow(pieces, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


def price(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: of each room up to ``capacity`` the largest weight that fits, and the length that is
    taken first there (of equal ones the longest, so that short ones are kept to fill with), or 0."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    # by falling lengths, so that the first of the largest is the longest
    tail = weights[:0:-1]
    for c in range(1, capacity + 1):
        value = tail[capacity - c :] + best[:c]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], choice[c] = value[k], c - k
        else:
            best[c] = best[c - 1]
    return best, choice


def priced(weights: np.ndarray, capacity: int, many: int = MANY, slack: float = SLACK) -> Iterator[np.ndarray]:
    """The configuration (counts by length) of the largest weight, and up to ``many`` that have no length of
    another of them, each the best that holds some length and within ``slack`` of the largest weight: they are
    what the next rounds would find, since a round only lowers the weights of the lengths it takes."""
    best, choice = price(weights, capacity)
    value = weights[1:] + best[capacity - 1 :: -1]
    good = np.flatnonzero((weights[1:] > 0) & (value >= (1 - slack) * best[capacity]))
    taken, found = np.zeros(capacity + 1, bool), 0
    for first in (good[np.lexsort((-good, -value[good]))] + 1).tolist():
        if taken[first]:
            continue
        held, c = [first], capacity - first
        while c > 0:
            if choice[c]:
                held.append(int(choice[c]))
            c -= max(1, int(choice[c]))
        if not taken[held].any():
            taken[held] = True
            found += 1
            yield np.bincount(held, minlength=capacity + 1)
        if found == many:
            return


def configurations(demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Fractional solution of the configuration LP: (counts by length, sequences) of each priced configuration.
    It may end before all is covered, where the rounds do."""
    size = np.arange(capacity + 1) / capacity
    least = float((demand * size).sum()) / (rounds * MANY)
    left, steps = demand.astype(np.float64), []
    need = np.maximum(demand, 1)
    # weights per item: the share of all tokens over the demand is the size; long ones a little more a token
    weights = size * (1 + LONGER * size)
    for _ in range(rounds):
        if not left.any():
            break
        for counts in priced(np.where(left > 0, weights, -1.0), capacity):
            use = np.flatnonzero(counts)
            most = float((left[use] / counts[use]).min())
            longest = use[-1]
            take = min(most, max(least, STEP * float(demand[longest] / counts[longest])))
            left[use] -= take * counts[use]
            left[left < 1e-9 * need] = 0
            weights = weights * np.exp(-ETA * take * counts / need)
            steps.append((counts, take))
    return steps


def rounded(steps: list[tuple[np.ndarray, float]], demand: np.ndarray) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """The configurations of the fractional solution in whole numbers, and the demand that is left. Equal
    configurations count together; what rounding down leaves of one is carried on to the next."""
    left, out, carried = demand.astype(np.int64).copy(), [], 0.0
    total: dict[bytes, list] = {}
    for counts, take in steps:
        total.setdefault(counts.tobytes(), [counts, 0.0])[1] += take
    for counts, x in total.values():
        use = np.flatnonzero(counts)
        k = min(int(x + carried + 1e-9), int((left[use] // counts[use]).min()))
        carried = min(max(x + carried - k, 0.0), 1.0)
        if k > 0:
            left[use] -= k * counts[use]
            out.append(({int(s): int(counts[s]) for s in use}, k))
    return out, left


def plan(demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Whole configurations ({length: times}, sequences) that hold exactly ``demand`` items of each length, and
    the share of the sequences that the program's configurations make up."""
    size = lambda configs: sum(k for _, k in configs)
    whole, left = rounded(configurations(demand, capacity, rounds), demand)
    found, plain = best_fit(left, capacity, whole), best_fit(demand, capacity)
    if size(found) <= size(plain):
        return found, size(whole) / max(1, size(found))
    return plain, 0.0


def best_fit(left: np.ndarray, capacity: int, begun: Iterable[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram, into the room of the sequences that are begun and into new ones:
    equal open sequences are kept as one group."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(room: int, held: dict[int, int], k: int) -> None:
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((held, k))

    for held, k in begun:
        put(capacity - sum(s * n for s, n in held.items()), held, k)
    for s in range(capacity, 0, -1):
        n = int(left[s])
        while n:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                most = capacity // s
                if n >= most:
                    put(capacity - most * s, {s: most}, n // most)
                if n % most:
                    put(capacity - n % most * s, {s: n % most}, 1)
                break
            room = rooms[at]
            held, k = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            use, each = min(k, n), 1
            if n >= k:
                each = min(room // s, n // k)
            put(room - each * s, held | {s: held.get(s, 0) + each}, use)
            if k > use:
                put(room, held, k - use)
            n -= use * each
    return [g for room in rooms for g in groups[room]]


def slots(configs: list[tuple[dict[int, int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For ranks from ``lo`` of each length: first sequence, places a sequence has for it, first offset there."""
    rows, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for held, k in configs:
        off = 0
        for s in sorted(held, reverse=True):
            rows.append((s, int(used[s]), base, held[s], off))
            used[s] += held[s] * k
            off += held[s] * s
        base += k
    rows.sort()
    return tuple(np.asarray(x, np.int64) for x in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` has id, piece and length (1 to capacity), and may have more."""
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    demand = np.zeros(capacity + 1, np.int64)
    for s, n in hist.items():
        demand[s] = n
    size, lo, base, times, off = slots(plan(demand, capacity)[0], capacity)
    key = size * (1 << 40) + lo
    salts = F.ceil(F.sqrt(F.element_at(F.lit([max(1, int(n)) for n in demand[1:]]), F.col("length").cast("int"))))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "start"), salts).cast("int"))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.join(before.hint("merge"), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1)

    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 40) + rank, "right") - 1
            within = rank - lo[at]
            seq, offset = base[at] + within // times[at], off[at] + within % times[at] * length
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*columns, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(token_pieces(docs, vocabulary, id_col, text_col, capacity), "pack-pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
