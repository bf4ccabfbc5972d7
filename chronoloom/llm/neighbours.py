"""Approximate nearest neighbours by cosine: a forest of random-projection trees, one shared priority queue.

A tree splits at each level by one random direction, at the median of each node's rows, so it is its
directions and its thresholds. Directions and thresholds come from a bounded sample (``SAMPLE`` rows, fewer
where vectors are long: 64 MB); all rows are indexed. A query walks down all trees at once: one queue holds the
branches not taken, by how far the query is from them, and gives the next leaf until enough are found. The
leaves' rows are ranked by the exact cosine.

How many leaves are enough is measured: a bounded sample of the queries is compared with all rows, and the
queue is followed until it has reached the leaves of ``RECALL`` of their true neighbours. On vectors without
any structure that is a fixed share of all leaves, so the work grows faster than the rows there.

Equal vectors are one row of the index with its smallest ids, since only those can be among the nearest. A leaf of
more than ``CELL`` rows is dealt out to cells, each of which sees all of the leaf's queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize

TREES, RECALL, NEAREST, EVERY = 4, 0.95, 5, 50
#: Rows and bytes of vectors that a forest is fitted on, at most; rows of a cell.
SAMPLE, SAMPLE_BYTES, CELL = 1 << 17, 64 << 20, 4096
#: Queries that are compared with all rows, and ranked rows that a task holds.
MEASURED, HELD = 100, 1 << 18
_DEEPEST = 20


class Forest:
    """``directions`` (trees x depth x dimensions) and ``cuts`` (trees x nodes, root first, level by level)."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        self.directions = rng.standard_normal((trees, depth, sample.shape[1])) if len(sample) else np.zeros((trees, depth, 1))
        self.cuts = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for d in range(depth):
                x = sample @ self.directions[t, d]
                order = np.lexsort((x, node))
                size = np.bincount(node, minlength=1 << d)
                first = np.cumsum(size) - size
                middle = order[np.minimum(first + size // 2, len(order) - 1)] if len(order) else np.zeros(1 << d, np.int64)
                self.cuts[t, (1 << d) - 1 : (2 << d) - 1] = np.where(size > 0, x[middle], 0.0) if len(order) else 0.0
                node = 2 * node + (x >= self.cuts[t, (1 << d) - 1 + node])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(vectors), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for d in range(self.depth):
                node = 2 * node + (vectors @ self.directions[t, d] >= self.cuts[t, (1 << d) - 1 + node])
            out[:, t] = node
        return out

    def search(self, vector: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The (tree, leaf) that the shared queue gives first."""
        x = (self.directions @ vector).tolist()
        queue: list[tuple] = [(0.0, t, 0, 0) for t in range(self.trees)]
        found, cuts, depth = [], self.cuts, self.depth
        while queue and len(found) < most:
            far, t, d, node = heapq.heappop(queue)
            while d < depth:
                gap = x[t][d] - cuts[t, (1 << d) - 1 + node]
                right = gap >= 0
                heapq.heappush(queue, (far + gap * gap, t, d + 1, 2 * node + (not right)))
                node, d = 2 * node + int(right), d + 1
            found.append((t, node))
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


_PLACED = "tree int, leaf int, cell int, query boolean, rep long, embedding {kind}"


def _indexed(forest: Forest, cells: dict[tuple[int, int], int], chunk: int = 2048) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, chunk):
                batch = whole.slice(i, chunk)
                rep = batch.column("rep").to_numpy()
                leaves = forest.leaves(_units(_matrix(batch.column("embedding"))))
                for t in range(forest.trees):
                    leaf = leaves[:, t]
                    n = np.array([cells.get((t, x), 1) for x in leaf.tolist()], np.int64)
                    cell = (rep * np.int64(0x9E3779B1) >> 7) % n
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rep), t, np.int32)), pa.array(leaf), pa.array(cell, pa.int32()), pa.array(np.zeros(len(rep), bool)), batch.column("rep"), batch.column("embedding")], ["tree", "leaf", "cell", "query", "rep", "embedding"])

    return run


def _visits(forest: Forest, cells: dict[tuple[int, int], int], most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                at, rows = [], []
                for k, vector in enumerate(_units(_matrix(batch.column("embedding")))):
                    for t, leaf in forest.search(vector, most):
                        for cell in range(cells.get((t, leaf), 1)):
                            at.append(k)
                            rows.append((t, leaf, cell))
                tree, leaf, cell = (pa.array(c, pa.int32()) for c in (zip(*rows) if rows else ((), (), ())))
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([tree, leaf, cell, pa.array([True] * len(rows), pa.bool_()), batch.column("rep").take(take), batch.column("embedding").take(take)], ["tree", "leaf", "cell", "query", "rep", "embedding"])

    return run


def cosines(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines in double precision; a pair's value doesn't depend on what stands beside it."""
    dots = (others * query).sum(axis=1)
    return dots / (np.sqrt((others * others).sum(axis=1)) * np.sqrt((query * query).sum()))


def _nearest(queries: np.ndarray, reps: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query the k nearest rows of a cell and what ties with the last: by a product of matrices, then
    exactly."""
    rough = _units(queries) @ _units(vectors).T
    k = min(k, len(vectors))
    for q in range(len(queries)):
        least = np.partition(rough[q], len(vectors) - k)[len(vectors) - k]
        near = np.flatnonzero(rough[q] >= least - 1e-9)
        exact = cosines(queries[q], vectors[near])
        best = np.lexsort((reps[near], -exact))[:k]
        yield q, near[best], exact[best]


def _best(held: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (query, rep, score) each query's k best different reps."""
    query, rep, score = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((rep, -score, query))
    query, rep, score = query[order], rep[order], score[order]
    # a row found in several trees has the same score in each
    new = np.concatenate(([True], (query[1:] != query[:-1]) | (rep[1:] != rep[:-1])))
    query, rep, score = query[new], rep[new], score[new]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate((first, [len(query)]))))
    return query[place < k], rep[place < k], score[place < k]


_FOUND = "query long, rep long, score double"


def _ranked(k: int) -> Callable:
    """Partitions sorted by cell, rows of the index before queries; queries are read as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out, n = None, [], [], 0
        record = lambda held: pa.RecordBatch.from_arrays([pa.array(c) for c in _best(held, k)], ["query", "rep", "score"])
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("tree", "leaf", "cell")]).astype(np.int64)
            query = batch.column("query").to_numpy(zero_copy_only=False)
            reps, vectors = batch.column("rep").to_numpy(), _matrix(batch.column("embedding"))
            cut = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0) | (query[1:] != query[:-1]), [True]))) if len(reps) else []
            for a, b in zip(cut, cut[1:]):
                if tuple(key[:, a]) != now:
                    now, rows = tuple(key[:, a]), []
                if not query[a]:
                    rows.append((reps[a:b], vectors[a:b]))
                elif rows:
                    rows = [tuple(np.concatenate(x) for x in zip(*rows))] if len(rows) > 1 else rows
                    for i in range(a, b, 256):
                        for q, near, score in _nearest(vectors[i : min(b, i + 256)], *rows[0], k):
                            out.append((np.full(len(near), reps[i + q]), rows[0][0][near], score))
                            n += len(near)
                    if n > HELD:
                        yield record(out)
                        out, n = [], 0
        if out:
            yield record(out)

    return run


def _compared(asked: np.ndarray, own: np.ndarray, forest: Forest, k: int) -> Callable:
    """Each task's k nearest rows of some queries, with the leaves that they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in own]
        for batch in batches:
            reps, vectors = batch.column("rep").to_numpy(), _units(_matrix(batch.column("embedding")))
            scores = asked @ vectors.T
            for q in range(len(own)):
                scores[q, reps == own[q]] = -2
                best = np.argsort(-scores[q])[:k]
                leaves = forest.leaves(vectors[best])
                held[q] = sorted(held[q] + list(zip(scores[q, best].tolist(), reps[best].tolist(), leaves.tolist())), key=lambda x: (-x[0], x[1]))[:k]
        rows = [(q, *x) for q, of in enumerate(held) for x in of if x[0] > -2]
        columns = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int32())))], ["q", "score", "rep", "leaves"])

    return run


def _reached(forest: Forest) -> Callable:
    """At which leaf of the queue each true neighbour is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[int] = []
            for vector, near in zip(batch.column("vector").to_pylist(), batch.column("near").to_pylist()):
                place = {leaf: i for i, leaf in enumerate(forest.search(np.array(vector), forest.trees << forest.depth), 1)}
                out += [min(place[t, leaf] for t, leaf in enumerate(leaves)) for leaves in near]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], ["at"])

    return run


def leaves_for(recall: float, vectors: DataFrame, queries: DataFrame, forest: Forest, k: int) -> int:
    """How many leaves a query has to visit, measured on at most ``MEASURED`` of the queries."""
    spark = vectors.sparkSession
    drawn = queries.orderBy(F.xxhash64("rep", F.lit(2)), "rep").limit(MEASURED).toArrow()
    if not drawn.num_rows:
        return 1
    own, asked = drawn.column("rep").to_numpy(), _units(_matrix(drawn.column("embedding").combine_chunks()))
    near = vectors.select("rep", "embedding").mapInArrow(_compared(asked, own, forest, k), "q int, score double, rep long, leaves array<int>")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    by: dict[int, list] = {}
    for r in near.withColumn("at", best).filter(F.col("at") <= k).collect():
        by.setdefault(r["q"], []).append(list(r["leaves"]))
    if not by:
        return 1
    rows = spark.createDataFrame([(asked[q].tolist(), x) for q, x in by.items()], "vector array<double>, near array<array<int>>")
    at = sorted(r["at"] for r in rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_reached(forest), "at int").collect())
    return at[min(len(at) - 1, int(recall * len(at)))]


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """rep, embedding, ids: each different vector with its k + 1 smallest ids, the first of which is ``rep``."""
    smallest = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = vectors.withColumn("at", smallest).filter(F.col("at") <= k + 1)
    ids = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialize(ids.select(F.get("ids", F.lit(0)).alias("rep"), "embedding", "ids"), "ann-vectors")


def nearest(table: DataFrame, every: int = EVERY, k: int = NEAREST, trees: int = TREES, recall: float = RECALL, leaf_rows: int | None = None, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose vec_id is divisible by ``every``, the ``k`` nearest other
    rows found by cosine, ties to the smaller vec_id; all others where they are fewer.

    Rows with a null vec_id, or a vector that is null, empty, zero or holds null or non-finite components, take no
    part, nor do vectors whose length isn't the most usual one (the smaller of equally usual ones). Of rows that
    repeat a vec_id the one with the least vector counts. Other columns are not looked at.
    """
    spark = table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    kind = usable.schema["embedding"].dataType.simpleString()
    schema = "query_id long, rank int, vec_id long, score double"
    size = usable.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not size:
        return spark.createDataFrame([], schema)
    rows = usable.filter(F.size("embedding") == size[0]["size"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = materialize(rows, "ann-rows")
    vectors = distinct_vectors(rows, k)
    n = vectors.count()
    asked = rows.filter(F.col("vec_id") % every == 0)
    queries = materialize(asked.join(vectors.select("embedding", "rep").hint("merge"), "embedding").select(F.col("vec_id").alias("query_id"), "rep"), "ann-queries")
    most = max(1, min(sample, SAMPLE_BYTES // (8 * size[0]["size"])))
    drawn = vectors.filter(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, 0.97 * most / max(n, 1)) * (1 << 30)) + 1).select("embedding").limit(most).toArrow()
    seen = _units(_matrix(drawn.column("embedding").combine_chunks())) if drawn.num_rows else np.zeros((0, size[0]["size"]))
    # leaves of about the square root of all rows: as many to choose from as rows to look at in each
    leaf_rows = leaf_rows or max(64, math.isqrt(n))
    depth = min(_DEEPEST, max(0, (n // leaf_rows).bit_length() - 1), max(0, (len(seen) // 4).bit_length() - 1))
    forest = Forest(seen, depth, trees)
    placed = _PLACED.format(kind=kind)
    held = vectors.select("rep", "embedding").mapInArrow(_indexed(forest, {}), placed).groupBy("tree", "leaf").count().filter(F.col("count") > cell)
    # at most trees x 2 ** depth leaves
    cells = {(r["tree"], r["leaf"]): -(-r["count"] // cell) for r in held.collect()}
    index = vectors.select("rep", "embedding").mapInArrow(_indexed(forest, cells), placed)
    one_each = materialize(queries.select("rep").distinct().join(vectors.select("rep", "embedding").hint("merge"), "rep"), "ann-asked")
    visits = one_each.mapInArrow(_visits(forest, cells, leaves_for(recall, vectors, one_each, forest, k)), placed)
    key = ("tree", "leaf", "cell")
    ordered = index.unionByName(visits).repartition(parts, *key).sortWithinPartitions(*key, "query")
    found = ordered.mapInArrow(_ranked(k + 1), _FOUND).groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    few = found.withColumn("at", best).filter(F.col("at") <= k + 1)
    ids = few.join(vectors.select("rep", "ids").hint("merge"), "rep")
    one = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id")))
    lists = ids.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list(one))), 1, k + 1).alias("near"))
    own = queries.join(lists.withColumnRenamed("query", "rep").hint("merge"), "rep")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
