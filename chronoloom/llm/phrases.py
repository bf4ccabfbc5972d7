"""Phrase collocations from truncated suffix trees, built group by group as ERA does.

Words are keys of 64 bits (of the word and its language), checked over the whole vocabulary to stand for one
word each. Vertical partitioning: the suffixes of the texts, cut after five words, at the end of a piece and
before a word that is too rare, are told apart by their first word; a first word with more suffixes than the
memory budget of a group is extended by the second one, and so on. What is left are prefixes that fit, hashed
to slots; neighbouring slots make a group. Each group is built on its own (``_subtrees``): its suffixes are
sorted, which is the order of the subtree's leaves, and the totals of the leaves below a node are the counts of
its phrase. A node above the prefix of its group gets a part of its count from each group below it; the parts
are summed.

Suffixes travel as blocks of codes, one for each group and block of texts, summed before they are sent. A code
of two bytes stands for one of the 65,534 most frequent words; other words travel as their keys. Sizes that
are bounded at any input: those codes, 2 ** 24 bits that tell rare words from others, at most 2 ** 20 slots for
each length of prefixes. Beyond 2 ** 36 suffixes the budget rises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import BLOCK, SLICES, blocks, buffers, materialize, mix64, signed, slices, tree_sum
from chronoloom.llm.hashing import BASE, LOWER, powers_for, words_at

MIN_COUNT, TOP, MOST = 100, 2000, 5
#: Suffixes of a group at most (but for a slot more), and words that are summed at once before they travel.
BUDGET, AT_ONCE = 1 << 20, 1 << 20
_CODES, _BITS = (1 << 16) - 2, 24
_ESCAPE = np.uint16(_CODES + 1)
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _PIECE.copy()
_GAP[[32, 9]] = True
_SECOND = mix64(np.arange(1, 257, dtype=np.uint64) * BASE)
_SALT = np.uint64(0xD6E8FEB86659FD93)

Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _row(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of ``off`` with a line end after each, and where each starts."""
    at = off - off[0] + np.arange(len(off))
    out = np.full(int(at[-1]), 10, np.uint8)
    for k in range(len(off) - 1):
        out[at[k] : at[k + 1] - 1] = data[off[k] : off[k + 1]]
    return out, at


def _second_hashes(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Other hashes of the same words, to tell apart words that share a key."""
    out, i = np.zeros(len(lo), np.uint64), 0
    while i < len(lo):
        start = int(lo[i])
        j = max(i + 1, int(np.searchsorted(hi, start + BLOCK)))
        part = LOWER[row[start : hi[j - 1]]]
        up, down = powers_for(len(part))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_SECOND[part] * up[: len(part)])))
        out[i:j] = (sums[hi[i:j] - start] - sums[lo[i:j] - start]) * down[lo[i:j] - start]
        i = j
    return out


def _tokens(row: np.ndarray, at: np.ndarray, langs: np.ndarray, seed: int) -> Tokens:
    """Keys, starts, ends, texts of the words of ``row``, and whether the next word is in the same piece."""
    h, lo, hi = words_at(row, _GAP)
    owner = np.searchsorted(at, lo, "right") - 1
    keys = mix64(h + langs[owner] + np.uint64(seed) * _SALT) if len(h) else h
    keys[keys == 0] = 1
    breaks = np.concatenate(([0], np.cumsum(_PIECE[row], dtype=np.int64)))
    joined = np.zeros(len(lo), bool)
    joined[:-1] = breaks[lo[1:]] == breaks[hi[:-1]]
    return keys, h, lo, hi, owner, joined


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _texts(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[np.ndarray, list[str], Tokens]]:
    """Blocks of texts: their bytes, the languages of the texts, their words."""
    for batch in batches:
        off, data = buffers(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        known = {x: _lang_hash(x) for x in set(langs)}
        hashes = np.array([known[x] for x in langs], np.uint64)
        for i, j in blocks(np.diff(off)):
            row, at = _row(off[i : j + 1], data)
            yield row, langs[i:j], _tokens(row, at, hashes[i:j], seed)


_VOCABULARY = "key long, lang string, word binary, n long, low long, high long"


def _vocabulary(seed: int) -> Callable:
    """Different words of each block with their counts and the least and largest of their second hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, langs, (keys, _, lo, hi, owner, _) in _texts(batches, seed):
            if not len(keys):
                continue
            second = _second_hashes(row, lo, hi) + np.array([_lang_hash(x) for x in langs], np.uint64)[owner] * _SALT
            order = np.argsort(keys, kind="stable")
            k, second = keys[order], signed(second)[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            one = order[first]
            size = hi[one] - lo[one]
            ends = np.cumsum(size)
            take = np.arange(int(ends[-1])) + np.repeat(lo[one] - (ends - size), size)
            words = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(LOWER[row[take]])])
            n = np.diff(np.concatenate((first, [len(k)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(k[first])), pa.array([langs[o] for o in owner[one]]), words, pa.array(n, pa.int64()), pa.array(np.minimum.reduceat(second, first)), pa.array(np.maximum.reduceat(second, first))],
                ["key", "lang", "word", "n", "low", "high"],
            )

    return run


def vocabulary(texts: DataFrame, attempts: int = 4, hasher: Callable = _vocabulary) -> tuple[DataFrame, int]:
    """key, lang, word, n of all words, and the seed of the keys. Where two words share a key the next seed is
    taken."""
    for seed in range(attempts):
        rows = texts.mapInArrow(hasher(seed), _VOCABULARY).groupBy("key")
        words = materialize(rows.agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("n").alias("n"), (F.min("low") != F.max("high")).alias("clash")), "phrase-words")
        if words.filter("clash").isEmpty():
            return words.drop("clash"), seed
    raise ValueError(f"words share their keys with each of {attempts} seeds")


def _known(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are in ``of`` (sorted)."""
    at = np.minimum(np.searchsorted(of, keys), max(len(of) - 1, 0))
    return of[at] == keys if len(of) else np.zeros(len(keys), bool)


def _suffixes(keys: np.ndarray, joined: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Suffixes of at least two words, cut as the module says; 0 stands behind their last word."""
    ok = (bits[(keys >> np.uint64(3)) & np.uint64((1 << (_BITS - 3)) - 1)] >> (keys & np.uint64(7)).astype(np.uint8)) & 1 > 0
    link = joined & ok
    link[:-1] &= ok[1:]
    at = np.flatnonzero(link)
    out = np.zeros((len(at), MOST), np.uint64)
    out[:, 0] = keys[at]
    on = np.ones(len(at), bool)
    for d in range(1, MOST):
        reach = np.minimum(at + d - 1, len(link) - 1)
        on &= link[reach]
        out[on, d] = keys[at[on] + d]
    return out


def _slot(p: np.ndarray, n_slots: int) -> np.ndarray:
    return (p >> np.uint64(65 - n_slots.bit_length())).astype(np.int64)


def _routed(suffixes: np.ndarray, heavy: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each suffix's first prefix whose slot isn't heavy (``heavy``: of each length, which slots
    are), and its length; a suffix of such prefixes alone has its own hash, and its length and one more."""
    p, r = suffixes[:, 0].copy(), np.ones(len(suffixes), np.uint8)
    on = np.arange(len(p))
    for d, of in enumerate(heavy, 1):
        on = on[of[_slot(p[on], len(of))]]
        if not len(on):
            break
        r[on] = d + 1
        on = on[suffixes[on, d] != 0]
        p[on] = mix64(p[on] * BASE + suffixes[on, d])
    return p, r


def _gathered(batches: Iterator[pa.RecordBatch], seed: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Suffixes of blocks of texts of about AT_ONCE words."""
    held: list[np.ndarray] = []
    for _, _, (keys, _, _, _, _, joined) in _texts(batches, seed):
        held.append(_suffixes(keys, joined, bits) if len(keys) else np.zeros((0, MOST), np.uint64))
        if sum(map(len, held)) >= AT_ONCE:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _extended(seed: int, bits: np.ndarray, heavy: list[np.ndarray]) -> Callable:
    """How often the extensions of heavy prefixes occur, by slot, summed over a task's texts, as slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n_slots = len(heavy) + 1, len(heavy[0])
        total = np.zeros(n_slots, np.int64)
        for s in _gathered(batches, seed, bits):
            p, r = _routed(s, heavy)
            total += np.bincount(_slot(p[(r == d) & (s[:, d - 1] != 0)], n_slots), minlength=n_slots)
        if total.any():
            yield slices(total)

    return run


_BLOCKS = "g int, m int, codes binary, more binary, counts binary, depths binary"


def _summed(s: np.ndarray, p: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different suffixes, by group, and how often each occurs."""
    whole = p
    for d in range(MOST):
        whole = mix64(whole * BASE + s[:, d])
    order = np.lexsort((whole, g))
    same = (s[order[1:]] == s[order[:-1]]).all(axis=1)
    if (whole[order[1:]] == whole[order[:-1]])[~same].any():
        # two suffixes share a hash, so equal ones may lie apart
        order = np.lexsort((*(s[:, d] for d in reversed(range(MOST))), g))
        same = (s[order[1:]] == s[order[:-1]]).all(axis=1)
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    return order[first], np.diff(np.concatenate((first, [len(order)])))


def _dealt(seed: int, bits: np.ndarray, heavy: list[np.ndarray], groups: np.ndarray, hot: np.ndarray) -> Callable:
    """Suffixes by group, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _gathered(batches, seed, bits):
            if not len(s):
                continue
            p, r = _routed(s, heavy)
            g = groups[_slot(p, len(groups))]
            at, n = _summed(s, p, g)
            s, r, g, n = s[at], r[at], g[at], n.astype(np.uint32)
            codes = np.zeros(s.shape, np.uint16)
            for d in range(MOST):
                known = _known(s[:, d], hot)
                codes[known, d] = np.searchsorted(hot, s[known, d]) + 1
                codes[~known & (s[:, d] != 0), d] = _ESCAPE
            cut = np.concatenate((np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))), [len(g)]))
            parts = [(int(g[a]), int(b - a), codes[a:b].T.tobytes(), s[a:b][codes[a:b] == _ESCAPE].tobytes(), n[a:b].tobytes(), r[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
            for k in range(0, len(parts), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts[k : k + 1000]), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], ["g", "m", "codes", "more", "counts", "depths"])

    return run


def _nodes(s: np.ndarray, n: np.ndarray, r: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases (as rows of keys) and counts of the nodes of one subtree, from its leaves: whole counts that
    reach ``least``, and parts of the counts of nodes above the group's prefix."""
    order = np.lexsort(tuple(s[:, d] for d in reversed(range(MOST))))
    s, n, r = s[order], n[order], r[order]
    new = np.zeros(len(s), bool)
    new[0] = True
    new[1:] = s[1:, 0] != s[:-1, 0]
    for d in range(1, MOST):
        new[1:] |= s[1:, d] != s[:-1, d]
        at = np.flatnonzero(new)
        total = np.add.reduceat(n, at)
        good = (s[at, d] != 0) & ((total >= least) | (r[at] > d + 1))
        yield s[at[good], : d + 1], total[good]


def _subtrees(hot: np.ndarray, least: int) -> Callable:
    table = np.zeros(1 << 16, np.uint64)
    table[1 : len(hot) + 1] = hot

    def built(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        s, n, r = (np.concatenate(x) for x in zip(*held))
        for keys, total in _nodes(s, n, r, least):
            if len(total):
                wide = np.ascontiguousarray(keys.astype(">u8"))
                ends = np.arange(len(keys) + 1, dtype=np.int32) * (8 * keys.shape[1])
                p = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(wide)])
                yield pa.RecordBatch.from_arrays([p, pa.array(total, pa.int64())], ["p", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for g, m, codes, more, counts, depths in zip(*(batch.column(c).to_pylist() for c in ("g", "m", "codes", "more", "counts", "depths"))):
                if g != now and held:
                    yield from built(held)
                    held = []
                now = g
                c = np.frombuffer(codes, np.uint16).reshape(MOST, m).T
                s = table[c]
                s[c == _ESCAPE] = np.frombuffer(more, np.uint64)
                held.append((s, np.frombuffer(counts, np.uint32).astype(np.int64), np.frombuffer(depths, np.uint8)))
        if held:
            yield from built(held)

    return run


def _collected(sums: DataFrame, n: int, kind: type = np.int64) -> np.ndarray:
    """An array of ``n`` from rows (place, value)."""
    rows, out = sums.toArrow(), np.zeros(n, kind)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def phrase_counts(texts: DataFrame, words: DataFrame, seed: int, least: int = MIN_COUNT, budget: int = BUDGET) -> DataFrame:
    """p, f: phrases of 2 to 5 words (their keys, eight bytes each) that occur at least ``least`` times."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = words.filter(F.col("n") >= least).select("key", "n")
    total = frequent.agg(F.sum("n")).first()[0] or 0
    n_slots = 1 << min(20, max(8, int(16 * max(total // budget, 4 * parts)).bit_length()))
    budget = max(min(budget, total // (4 * parts) + 1), total // n_slots + 1)
    hot = np.sort(frequent.orderBy(F.desc("n"), "key").limit(_CODES).select("key").toArrow().column(0).to_numpy().view(np.uint64))
    place = F.shiftright(F.col("key").bitwiseAND((1 << _BITS) - 1), 5).alias("i")
    bits = _collected(frequent.groupBy(place).agg(F.expr("bit_or(shiftleft(1L, cast(key & 31 as int)))").alias("b")), 1 << (_BITS - 5)).astype(np.uint32).view(np.uint8)
    slot = F.shiftrightunsigned(F.col("key"), 65 - n_slots.bit_length()).alias("slot")
    totals = [_collected(frequent.groupBy(slot).agg(F.sum("n")), n_slots)]
    heavy: list[np.ndarray] = []
    while (totals[-1] > budget).any() and len(totals) < MOST:
        heavy.append(totals[-1] > budget)
        more = tree_sum(texts.mapInArrow(_extended(seed, bits, list(heavy)), SLICES))
        totals.append(np.zeros(n_slots, np.int64) if more is None else more.astype(np.int64))
    light = sum(t * (t <= budget) for t in totals)
    groups = ((np.cumsum(light) - light) // budget).astype(np.int32)
    dealt = texts.mapInArrow(_dealt(seed, bits, heavy, groups, hot), _BLOCKS)
    nodes = dealt.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_subtrees(hot, least), "p binary, f long")
    return materialize(nodes.groupBy("p").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrase-counts")


def _parts() -> F.Column:
    """Both sides of every cut of a phrase, and its inner words."""
    m = F.expr("cast(length(p) / 8 as int)")
    part = lambda first, n: F.substring("p", first * 8 + 1, n * 8)
    one = lambda side, k, p: F.struct(F.lit(side).alias("side"), k.alias("k"), p.alias("part"))
    inner = F.when(m > 2, F.sequence(F.lit(2), m - 1)).otherwise(F.array().cast("array<int>"))
    cuts = F.sequence(F.lit(1), m - 1)
    return F.concat(
        F.transform(cuts, lambda k: one("l", k, part(F.lit(0), k))), F.transform(cuts, lambda k: one("r", k, part(k, m - k))), F.transform(inner, lambda k: one("w", k, part(k - 1, F.lit(1)))),
    )


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    Null texts are empty, a null language is ``und``; other columns are not looked at. A phrase of two to five
    words that occurs ``least`` times is a candidate; it is dropped where a candidate of one word more around
    it occurs as often (what holds it in longer ones occurs as often at each length between). Of its cuts the
    one with the lowest score counts, then the one after fewer words. Repeated rows count each. Equal scores
    are ranked by count, then by phrase. No row comes from texts without candidates.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(text.cast("binary").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    words, seed = vocabulary(texts)
    found = phrase_counts(texts, words, seed, least, budget)
    key = F.unhex(F.lpad(F.hex("key"), 16, "0"))
    known = found.select("p", "f", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("string").alias("lang"))
    known = known.unionByName(words.filter(F.col("n") >= least).select(key.alias("p"), F.col("n").alias("f"), "word", "lang")).withColumnRenamed("p", "part")
    parts = found.select("p", F.col("f").alias("a"), F.inline(_parts()))
    joined = materialize(parts.join(known.hint("merge"), "part"), "phrase-parts")
    m = F.expr("cast(length(p) / 8 as int)")
    around = ((F.col("side") == "l") & (F.col("k") == m - 1)) | ((F.col("side") == "r") & (F.col("k") == 1))
    inside = joined.filter(around & (F.length("part") > 8) & (F.col("a") >= F.col("f"))).select(F.col("part").alias("p")).distinct()
    of = lambda side, k, c: F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col(c)))
    ends = F.length("part") == 8
    word = [of("l", 1, "word").alias("w1"), *(of("w", k, "word").alias(f"w{k}") for k in range(2, MOST)), F.max(F.when((F.col("side") == "r") & ends, F.col("word"))).alias("last")]
    sides = [of(s, k, "f").alias(f"{s}{k}") for s in "lr" for k in range(1, MOST)]
    phrases = joined.groupBy("p").agg(F.max("a").alias("a"), F.max("lang").alias("lang"), *sides, *word).join(inside.hint("merge"), "p", "left_anti")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = lambda k: F.expr(f"(cast(1000 * n as decimal(19,0)) * {wide('a')}) div ({wide(f'l{k}')} * {wide(f'r{k}')})")
    cut = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    scored = phrases.join(totals, "lang").withColumn("cut", F.array_min(F.array(*(cut(k) for k in range(1, MOST)))))
    phrase = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("w1", "w2", "w3", "w4", "last")))
    rows = scored.select("lang", phrase.alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language's best are the best of the best of its shares
    for shares in (1024, 32):
        best = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).drop("rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
