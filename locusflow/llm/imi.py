"""Approximate nearest neighbours by an inverted multi-index.

A vector is cut into two halves, and each half is quantised by a codebook of
its own, fitted by k-means on at most ``FIT_ROWS`` vectors (a stated bound); a
pair of centroids is a cell, and every vector is in the cell of its two nearest
centroids. A query scores a centroid by the inner product of its half with it,
so a cell's score is the sum of two; negated, that is the summed distance by
which a heap visits pairs of centroids, best first, until the visited cells
hold a share of all vectors. These are reranked by the exact inner product in
double precision.

The share is measured, not set: of the fit vectors, some are searched by brute
force among the others, and the share is what would have held ``RECALL`` of
their true neighbours. Among more vectors true neighbours are nearer, so the
recall on the whole table is rather higher.

The postings of one first centroid are cut into chunks of about ``CHUNK``
vectors, and each query goes to every chunk with the cells it visits there, so
equal vectors, however many, are spread over tasks. A chunk gives each query's
best few only.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, as queries or candidates; rows
of equal vec_id are candidates each, but never for a query of that id; ties go
to the smaller vec_id; a query gets all candidates if there are fewer than
``top``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

TOP = 20
FIT_ROWS = 8192
CENTROIDS = 64
RECALL = 0.95
#: Fit vectors searched by brute force to measure the share.
TRIALS = 256
CHUNK = 2048


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = np.unique(x, axis=0)
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * (x @ centroids.T), axis=1)


def traverse(query: np.ndarray, books: list[np.ndarray], sizes: dict[int, int], candidates: int) -> list[int]:
    """Cells in order of falling summed score until they hold enough vectors: the multi-sequence walk."""
    half = books[0].shape[1]
    scores = [books[0] @ query[:half], books[1] @ query[half:]]
    order = [np.argsort(-s, kind="stable") for s in scores]
    score = lambda i, j: -(scores[0][order[0][i]] + scores[1][order[1][j]])
    width, heap, pushed, out, held = len(books[1]), [(score(0, 0), 0, 0)], {(0, 0)}, [], 0
    while heap and held < candidates:
        _, i, j = heapq.heappop(heap)
        cell = int(order[0][i]) * width + int(order[1][j])
        if n := sizes.get(cell, 0):
            out.append(cell)
            held += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(books[0]) and y < width and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (score(x, y), x, y))
    return out


def share_for(x: np.ndarray, books: list[np.ndarray], recall: float, top: int) -> float:
    """The share of vectors that the cells visited first must hold to include ``recall`` of the true neighbours."""
    half, n = books[0].shape[1], len(x)
    own = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
    ranks = []
    for i in range(0, n, max(1, n // TRIALS)):
        true = x @ x[i]
        by_cell = (books[0] @ x[i, :half])[own[0]] + (books[1] @ x[i, half:])[own[1]]
        true[i] = by_cell[i] = -np.inf
        place = np.empty(n)
        place[np.argsort(-by_cell, kind="stable")] = np.arange(n)
        ranks.append(place[np.argsort(-true, kind="stable")[: min(top, n - 1)]])
    return float(np.quantile(np.concatenate(ranks), recall) + 1) / n if ranks and n > 1 else 1.0


def fit(rows: DataFrame, fit_rows: int, centroids: int, recall: float = RECALL, top: int = TOP) -> tuple[list[np.ndarray], float] | None:
    """The two codebooks and the share to visit, fitted in one task on the vectors of smallest hash."""

    def run(batches):
        import pyarrow as pa

        parts = [_matrix(b.column(0)) for b in batches if b.num_rows]
        if parts:
            x = np.concatenate(parts)
            half = x.shape[1] // 2
            books = [kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids, seed=6)]
            share = share_for(x, books, recall, top)
            yield pa.RecordBatch.from_pydict({"half": [0, 1], "k": [len(b) for b in books], "book": [np.ascontiguousarray(b).tobytes() for b in books], "share": [share] * 2})

    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(29)), "vec_id").limit(fit_rows).repartition(1).sortWithinPartitions("vec_id")
    got = {r["half"]: r for r in sample.select("v").mapInArrow(run, "half long, k long, book binary, share double").collect()}
    if not got:
        return None
    return [np.frombuffer(got[h]["book"]).reshape(got[h]["k"], -1) for h in (0, 1)], got[0]["share"]


def search(vectors: DataFrame, is_query: Column, top: int = TOP, centroids: int = CENTROIDS, recall: float = RECALL, fit_rows: int = FIT_ROWS, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest found."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "imi")
    rows = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    fitted = fit(rows, fit_rows, centroids, recall, top)
    if fitted is None:
        return spark.createDataFrame([], schema)
    books, share = fitted
    width = len(books[1])
    shared_books = spark.sparkContext.broadcast(books)

    def assign(batches):
        import pyarrow as pa

        b = shared_books.value
        half = b[0].shape[1]
        for batch in batches:
            x = _matrix(batch.column(1))
            cell = nearest(x[:, :half], b[0]) * width + nearest(x[:, half:], b[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

    index = scratch.save(rows.mapInArrow(assign, "vec_id long, v array<double>, cell int"), "index")
    # centroids ** 2 counts at most
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}
    rows_of = [0] * len(books[0])
    for c, n in sizes.items():
        rows_of[c // width] += n
    shared = spark.sparkContext.broadcast((sizes, [-(-n // chunk) for n in rows_of]))
    enough = round(share * sum(sizes.values())) + top

    def visits(batches):
        """A query's cells, together for each first centroid, for every chunk of its postings."""
        import pyarrow as pa

        (n, parts), b = shared.value, shared_books.value
        for batch in batches:
            x, out = _matrix(batch.column(1)), []
            for q, query in enumerate(x):
                by_first: dict[int, list[int]] = {}
                for c in traverse(query, b, n, enough):
                    by_first.setdefault(c // width, []).append(c)
                out += [(q, first, k, cells) for first, cells in by_first.items() for k in range(parts[first])]
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.list_(pa.int32()))], names=["query_id", "v", "first", "part", "cells"])

    wanted = index.where(is_query).select("vec_id", "v").repartition(max(32, spark.sparkContext.defaultParallelism), "vec_id").mapInArrow(visits, "query_id long, v array<double>, first int, part int, cells array<int>")
    first = F.expr(f"cell div {width}").cast("int")
    n_parts = F.element_at(F.array(*[F.lit(max(1, -(-n // chunk))) for n in rows_of]), first + 1)
    entries = index.select("vec_id", "v", "cell", first.alias("first"), F.pmod(F.xxhash64("vec_id", F.lit(31)), n_parts).cast("int").alias("part"))

    def rerank(left, right):
        import pyarrow as pa

        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, cell = left.column("vec_id").to_numpy(), left.column("cell").to_numpy()
            queries, cells = right.column("query_id").to_numpy(), right.column("cells").to_pylist()
            x, y = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
            asking: dict[int, list[int]] = {}
            for i, cs in enumerate(cells):
                for c in cs:
                    asking.setdefault(c, []).append(i)
            products = np.full((len(queries), len(ids)), -np.inf, np.float64)
            for c, who in asking.items():
                here = np.flatnonzero(cell == c)
                # one product after another in a fixed order of components: equal vectors score equally
                products[np.ix_(who, here)] = y[who] @ x[here].T
            products[queries[:, None] == ids[None, :]] = -np.inf
            for i, p in enumerate(products):
                n = min(top, len(p))
                cut = np.partition(p, len(p) - n)[len(p) - n]
                near = np.flatnonzero((p >= cut - 1e-9) & (p > -np.inf))
                exact = np.array([float(np.sum(y[i] * x[k])) for k in near])
                order = np.lexsort((ids[near], -exact))[:n]
                out[0] += [int(queries[i])] * len(order)
                out[1] += ids[near[order]].tolist()
                out[2] += exact[order].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    best = entries.groupBy("first", "part").cogroup(wanted.groupBy("first", "part")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    # a query has at most ``top`` rows from each chunk it visits
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", order).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
