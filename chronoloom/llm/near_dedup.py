"""Near-duplicate documents: MinHash with banding, verification, and connected components.

1. Each whole text gives its set of distinct five-word shingles (64-bit hashes), 128 minima under
   universal (multiply-add) hashes, and 32 band keys of 4 minima each. Two sets at similarity 0.75 share
   no band with probability (1 - 0.75**4)**32 = 5e-6.
2. Documents with equal sets form one class at once, and its smallest id stands for it, so copies cost
   nothing further.
3. In every band bucket the representatives are compared with a centre: first the smallest id, then
   random members. A comparison needs like set sizes and a sketch (one bit of each minimum) whose
   Hamming distance is within FAR of 128, more than five standard deviations above that of similarity
   0.75; what passes is verified on the full sets. Links are joined to components by alternating
   large-star and small-star.
4. Only members of different components are compared further, so a bucket of near copies costs some rows
   a member, not all pairs. When the pairs still open are few against the rows (``OPEN_PAIRS``), or a
   round has left most of them open, the rest of the buckets' pairs across components is compared without
   any cap. There a parity sketch of PARITY bits rejects first: it differs in at most as many bits as the
   sets do in members, so what it rejects is certainly below the similarity.
5. A bucket of more than CELL rows is dealt out to cells by a hash of the id: every cell is compared with
   the bucket's centres, or in the last round with all of its members, in a task of its own.

Defined cases: null and empty texts and texts without words have an empty set, a component of their own,
and no links; fewer than five words are one shingle; null ids are linked with nothing and have a null
component; repeated rows share their id's component, and an id stands for one text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import blocks, buffers, id_text, materialize, mix64, one_row_each, signed, spaced
from chronoloom.llm.components import components
from chronoloom.llm.hashing import shingle_set, word_hashes

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
#: Most differing bits (of BANDS * ROWS) of a pair whose full sets are compared.
FAR = 36
#: Rounds with CENTRES random centres a bucket go on while more pairs than this times the bucket rows are open.
OPEN_PAIRS, STAR_ROUNDS, CENTRES = 1.0, 4, 6
#: Bits of the parity sketch.
PARITY = 1024
#: Rows of a bucket that a task compares with its centres; a larger bucket is dealt out by salts.
CELL = 512

_rng = np.random.default_rng(2024)
_MULT = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def text_sets(off: np.ndarray, data: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Shingle sets of neighbouring texts."""
    out: list[np.ndarray] = []
    for i, j in blocks(np.diff(off)):
        row, starts = spaced(off[i : j + 1], data)
        h, at = word_hashes(row)
        cut = np.searchsorted(at, starts)
        out += [shingle_set(h[a:b], words) for a, b in zip(cut, cut[1:])]
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minima (texts x hashes) of non-empty sets."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    all_of = np.concatenate(sets)
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    v = np.empty_like(all_of)
    for k in range(BANDS * ROWS):
        np.multiply(all_of, _MULT[k], out=v)
        np.add(v, _PLUS[k], out=v)
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Parity sketches (texts x PARITY / 64)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bit = (np.concatenate([*sets, np.zeros(0, np.uint64)]) % np.uint64(PARITY)).astype(np.int64)
    odd = np.bincount(owner * PARITY + bit, minlength=len(sets) * PARITY).reshape(len(sets), PARITY) & 1
    return np.packbits(odd.astype(bool), axis=1).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        off, data = buffers(batch.column("text"))
        more = [c for c in batch.schema.names if c == "text_sha256"]
        for i, j in blocks(np.diff(off)):
            sets = text_sets(off[i : j + 1], data)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            bands: list = [None] * len(sets)
            low, high = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if full:
                m = minima([sets[k] for k in full])
                banded = signed(_band_keys(m))
                bits = np.packbits((mix64(m) & np.uint64(1)).astype(bool), axis=1).view(np.uint64) if m.size else np.zeros((0, 2), np.uint64)
                low[full], high[full] = bits[:, 0], bits[:, 1]
                for r, k in enumerate(full):
                    bands[k] = banded[r]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signed(low)), pa.array(signed(high)), pa.array(list(parities(sets)), pa.list_(pa.int64())), *(batch.column(c).slice(i, j - i) for c in more)],
                ["id", "n", "key", "bands", "low", "high", "odd", *more],
            )


def _band_keys(m: np.ndarray) -> np.ndarray:
    by_band = m.reshape(len(m), BANDS, ROWS)
    out = np.zeros((len(m), BANDS), np.uint64)
    for r in range(ROWS):
        out = mix64(out + by_band[:, :, r])
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (u, v and the texts of both) whose full sets are alike enough."""
    last: tuple = (None, None)
    for batch in batches:
        (off_u, data_u), (off_v, data_v) = (buffers(batch.column(c)) for c in ("text_u", "text_v"))
        ids, good = batch.column("v"), []
        for k in range(batch.num_rows):
            v = ids[k].as_py()
            if last[0] != v:
                last = (v, shingle_set(word_hashes(data_v[off_v[k] : off_v[k + 1]])[0], WORDS))
            x, y = shingle_set(word_hashes(data_u[off_u[k] : off_u[k + 1]])[0], WORDS), last[1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                good.append(k)
        take = pa.array(good, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("u").take(take), batch.column("v").take(take)], ["u", "v"])


def _links(pairs: DataFrame, texts: DataFrame, id_type: str) -> DataFrame:
    u, v = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "uv")
    full = pairs.join(u.hint("merge"), "u").join(v.hint("merge"), "v")
    return full.select("u", "v", "text_u", "text_v").mapInArrow(_verified, f"u {id_type}, v {id_type}")


_MEMBER = ("id", "component", "n", "low", "high")


def _cells():
    """The cells of a bucket."""
    return F.sequence(F.lit(0), F.floor((F.col("held") - 1) / CELL).cast("int"))


def _celled(rows: DataFrame) -> DataFrame:
    """Bucket rows with the cell that each is in."""
    return rows.withColumn("cell", F.pmod(F.xxhash64("id"), F.size(_cells())).cast("int"))


def _pairs(a: DataFrame, b: DataFrame, once: bool) -> DataFrame:
    """Distinct (u, v) of one bucket, of different components, with like sizes and sketches; with ``once``
    u < v, and parity sketches are compared as well. The rows of ``a`` stay in their cells, those of ``b``
    go to all cells of the bucket."""
    columns = (*_MEMBER, "odd") if once else _MEMBER
    u = _celled(a).select("band", "h", "cell", *(F.col(c).alias(f"{c}_u") for c in columns))
    v = b.select("band", "h", F.explode(_cells()).alias("cell"), *(F.col(c).alias(f"{c}_v") for c in columns))
    bits = F.bit_count(F.col("low_u").bitwiseXOR(F.col("low_v"))) + F.bit_count(F.col("high_u").bitwiseXOR(F.col("high_v")))
    sizes = (100 * F.col("n_u") >= PERCENT * F.col("n_v")) & (100 * F.col("n_v") >= PERCENT * F.col("n_u"))
    alike = (u["band"] == v["band"]) & (u["h"] == v["h"]) & (u["cell"] == v["cell"]) & (F.col("component_u") != F.col("component_v")) & sizes & (bits <= FAR)
    if once:
        odd = sum((F.bit_count(F.get("odd_u", F.lit(i)).bitwiseXOR(F.get("odd_v", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
        alike = alike & (F.col("id_u") < F.col("id_v")) & ((100 + PERCENT) * odd <= (100 - PERCENT) * (F.col("n_u") + F.col("n_v")))
    return u.join(v.hint("merge"), alike).select(F.col("id_u").alias("u"), F.col("id_v").alias("v")).distinct()


def _centres(rows: DataFrame, turn: int) -> DataFrame:
    """The bucket's smallest member, or random ones."""
    keys = [F.col("id")] if turn == 0 else [F.xxhash64("id", F.lit(turn * CENTRES + k)) for k in range(CENTRES)]
    one = lambda k, key: F.struct(*(F.col(f"{c}{k}").alias(c) for c in _MEMBER))
    found = rows.groupBy("band", "h").agg(F.max("held").alias("held"), *(F.min_by(c, key).alias(f"{c}{k}") for k, key in enumerate(keys) for c in _MEMBER))
    return found.select("band", "h", "held", F.inline(F.array_distinct(F.array(*(one(k, key) for k, key in enumerate(keys))))))


def _mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The bucket rows with their components now, of buckets that hold several components."""
    now = rows.drop("component").join(found.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = now.groupBy("band", "h").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("held").alias("held")).filter("a <> b").select("band", "h", F.explode(_cells()).alias("cell"))
    return materialize(_celled(now).join(several.hint("merge"), ["band", "h", "cell"], "left_semi").drop("cell"), "near-mixed")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable), kept; with
    ``digest`` also text_sha256."""
    texts = id_text(docs, id_col, text_col)
    id_type = texts.schema["id"].dataType.simpleString()
    signed_texts, more_type = (texts.withColumn("text_sha256", F.sha2("text", 256)), ", text_sha256 string") if digest else (texts, "")
    signs = materialize(signed_texts.mapInArrow(_signatures, f"id {id_type}, n long, key binary, bands array<long>, low long, high long, odd array<long>{more_type}"), "near-signatures")
    named = signs.filter("n > 0 AND id IS NOT NULL")
    classes = materialize(named.groupBy("key").agg(F.min("id").alias("rep")), "near-classes")
    heads = named.join(classes.hint("merge"), (named["key"] == classes["key"]) & (named["id"] == classes["rep"]), "left_semi")
    rows = heads.select("id", F.col("id").alias("component"), "n", "low", "high", F.posexplode("bands").alias("band", "h"))
    shared = rows.groupBy("band", "h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("held")).filter("a <> b").select("band", "h", "held")
    rows = materialize(rows.join(shared.hint("merge"), ["band", "h"]), "near-buckets")
    members = rows.select("id").distinct()
    candidates = materialize(texts.join(members.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "near-texts")

    links = materialize(_links(_pairs(rows, _centres(rows, 0), once=False), candidates, id_type), "near-links")
    found = materialize(components(links), "near-components")
    before = None
    for turn in range(1, STAR_ROUNDS + 2):
        rows = _mixed(rows, found)
        parts = rows.groupBy("band", "h", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("band", "h").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"))
        size, open_pairs = parts.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("sq")) / 2)).first()
        if not size:
            break
        last = turn > STAR_ROUNDS or open_pairs <= OPEN_PAIRS * size or (before is not None and open_pairs > before / 2)
        before = open_pairs
        if last:
            odd = heads.select("id", "odd").dropDuplicates(["id"])
            full = rows.join(odd.hint("merge"), "id")
            pairs = _pairs(full, full, once=True)
        else:
            pairs = _pairs(rows, _centres(rows, turn), once=False)
        more = materialize(_links(pairs, candidates, id_type), "near-links")
        if not more.isEmpty():
            links = links.union(more)
            found = materialize(components(links), "near-components")
        if last:
            break
    of_class = classes.join(found.hint("merge"), classes["rep"] == found["id"], "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = signs.join(of_class.hint("merge"), "key", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), *(["text_sha256"] if digest else []))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns; one of rows that repeat an
    id and text."""
    return one_row_each(docs, near_groups(docs, id_col, text_col, digest=True).filter("kept"), id_col, text_col)
