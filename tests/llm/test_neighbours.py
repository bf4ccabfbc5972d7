"""Approximate nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from chronoloom.llm import neighbours, registry

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<double>, label int, rep long, score double, ids string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows, every, k):
    """query_id -> [(vec_id, score)] of all rows; of rows that repeat an id the least vector counts."""
    held = {}
    for i, v in rows:
        if i is not None and usable(v):
            held[i] = min(held[i], v) if i in held else v
    ids = sorted(held)
    m = np.array([held[i] for i in ids], np.float64)
    out = {}
    for q, i in enumerate(ids):
        if i % every == 0:
            score = neighbours.cosines(m[q], m)
            out[i] = [(ids[j], score[j]) for j in np.lexsort((ids, -score)) if j != q][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        at = out.setdefault(r["query_id"], [])
        at.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(at)
    return out


def test_recall_over_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = brute(rows, 50, 5), found(registry.op12_nearest_neighbours(spark, SF))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {q: dict(x) for q, x in brute(rows, 50, len(rows)).items()}
    assert all(abs(exact[q][i] - s) < 1e-12 for q in got for i, s in got[q])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3.0, "x") for i, v in rows], SCHEMA)


ODD = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("inf"), 0.0, 0.0]), (8, []), (9, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0]), (50, [0.0, 3.0, 1.0])]


def test_defined_cases(spark):
    usual = [(i, v) for i, v in ODD if v is None or len(v) == 3]
    got, want = found(neighbours.nearest(frame(spark, ODD))), brute(usual, 50, 5)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()} and set(got) == {0, 50}
    assert neighbours.nearest(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(0, [1.0, 2.0])])).count() == 0


@pytest.mark.parametrize("cell", [16, neighbours.CELL])
def test_a_third_of_the_rows_alike(spark, cell):
    rng = np.random.default_rng(3)
    same = [0.25, -0.5, 1.0, 0.125]
    rows = [(i, same if i % 3 == 0 else rng.standard_normal(4).tolist()) for i in range(900)]
    got = found(neighbours.nearest(frame(spark, rows), every=10, leaf_rows=900, cell=cell))
    assert got == brute(rows, 10, 5)
    assert got[0] == [(i, got[0][0][1]) for i in (3, 6, 9, 12, 15)] and got[30][:5] == [(i, got[0][0][1]) for i in (0, 3, 6, 9, 12)]


def test_the_queue_visits_near_leaves_first():
    rng = np.random.default_rng(5)
    data = rng.standard_normal((4000, 16))
    forest = neighbours.Forest(data, 6, trees=3)
    leaves, others = forest.leaves(data), rng.standard_normal((50, 16))
    assert all(forest.search(x, 3) == list(enumerate(forest.leaves(x[None])[0])) for x in others)
    assert sorted(forest.search(data[0], 10**6)) == [(t, leaf) for t in range(3) for leaf in range(64)]
    assert np.bincount(leaves[:, 0]).max() <= 2 * 4000 / 64
