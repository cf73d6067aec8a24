"""Approximate search by greatest inner product: inverted lists scanned with adaptive dimensions.

Vectors get one more coordinate that gives all the same norm, so that the greatest inner product is the
least distance; a random rotation then spreads distance evenly over the coordinates. Vectors fall into the
lists of their nearest centroids. A query visits the nearest lists; there, candidates lie in column blocks,
and after each block a hypothesis test on the partial distance abandons those that can hardly come within
the query's bound, its k-th nearest in a sample. What is left is scored exactly, in double precision, on the
original vectors.

Fitted on bounded samples: the centroids, the bounds, and the share of lists to visit, which is the least
that holds RECALL of the sample's own nearest neighbours. All vectors are indexed. Lists are cut into cells
of about CELL_ROWS vectors and QUERY_ROWS queries, by hashes of the ids, so no list or crowd of queries
meets in one task, however many copies of a vector there are.

Cases: vectors that are null, zero, of another than the commonest length, or hold null or non-finite
components take no part; equal scores go to the smaller vec_id; with fewer candidates, all are returned;
rows that repeat a vec_id are one vector, the greatest of them by its components in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelode.llm._common import table, written

K = 20
#: Vectors that centroids, bounds and the share of lists are fitted on, at most, and queries among them for the share.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 300
LIST_ROWS, MOST_LISTS = 128, 4096
CELL_ROWS, QUERY_ROWS = 1024, 4096
RECALL, CERTAINTY, BLOCK = 0.93, 3.0, 8
#: Nearest of the sample beyond the k-th that a query's bound leaves room for, as tests may wrongly abandon some.
SPARE = 5
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass
class Index:
    """What all tasks share; sizes are bounded by the sample and MOST_LISTS."""

    norm2: float
    rotation: np.ndarray
    centroids: np.ndarray
    visits: int
    sample: np.ndarray
    sample_ids: np.ndarray
    sample_list: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rotated vectors with the coordinate that makes their norms equal."""
        rest = np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest]) @ self.rotation

    def query(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))]) @ self.rotation


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The row of b nearest to each of a, some rows of a at a time."""
    return np.concatenate([_distances(a[i : i + 1024], b).argmin(axis=1) for i in range(0, len(a), 1024)]) if len(a) else np.zeros(0, np.int64)


def build(ids: np.ndarray, x: np.ndarray, norm2: float, total: int, k: int = K) -> Index:
    """Fit the index on a sample x of total vectors whose greatest squared norm is norm2."""
    rng = np.random.default_rng(11)
    rotation, _ = np.linalg.qr(rng.normal(size=(x.shape[1] + 1, x.shape[1] + 1)))
    own = Index(norm2, rotation, np.zeros((0, 0)), 1, np.zeros((0, 0)), ids, np.zeros(0, int))
    y = own.lifted(x)
    lists = int(max(1, min(MOST_LISTS, total // LIST_ROWS, len(np.unique(y.round(9), axis=0)))))
    centers = np.unique(y.round(9), axis=0)
    centers = centers[rng.permutation(len(centers))[:lists]]
    for _ in range(8):
        near = _nearest(y, centers)
        size = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, y)
        centers = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centers)
    near = _nearest(y, centers)
    some = rng.permutation(len(x))[:SAMPLE_QUERIES]
    q = own.query(x[some])
    d = _distances(q, y)
    d[np.arange(len(some)), some] = np.inf
    top = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(np.argsort(_distances(q, centers), axis=1), axis=1)
    ranks = np.sort(order[np.arange(len(some))[:, None], near[top]].ravel())
    visits = int(ranks[min(len(ranks) - 1, int(RECALL * len(ranks)))]) + 1 if len(ranks) else lists
    own.centroids, own.visits, own.sample, own.sample_list = centers, min(lists, visits), y, near
    return own


def scan_cell(index: Index, q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, vector rows, scores) of each query's k nearest within its bound among the vectors of a cell."""
    y, p = index.lifted(x), index.query(q)
    dims = y.shape[1]
    blocks = [slice(a, min(dims, a + BLOCK)) for a in range(0, dims, BLOCK)]
    columns = [(np.ascontiguousarray(y[:, b]), np.ascontiguousarray(p[:, b])) for b in blocks]
    found_q, found_x = [], []
    for a in range(0, len(q), 256):
        rows = slice(a, a + 256)
        # The first two blocks are taken for all candidates; later ones for those that the tests leave.
        partial = sum(_distances(pb[rows], yb) for yb, pb in columns[:2])
        d = blocks[min(1, len(blocks) - 1)].stop
        limit = bound[rows] * (1 + 1e-9) + 1e-12
        qi, xi = np.nonzero(partial <= limit[:, None] * min(1.0, d / dims * (1 + CERTAINTY / np.sqrt(d)) ** 2))
        part = partial[qi, xi]
        for (yb, pb), b in zip(columns[2:], blocks[2:], strict=True):
            part = part + ((yb[xi] - pb[rows][qi]) ** 2).sum(axis=1)
            keep = part <= limit[qi] * min(1.0, b.stop / dims * (1 + CERTAINTY / np.sqrt(b.stop)) ** 2)
            qi, xi, part = qi[keep], xi[keep], part[keep]
        found_q.append(qi + a)
        found_x.append(xi)
    qi, xi = np.concatenate(found_q), np.concatenate(found_x)
    other = q_ids[qi] != ids[xi]
    qi, xi = qi[other], xi[other]
    score = np.concatenate([(q[qi[i : i + 65536]] * x[xi[i : i + 65536]]).sum(axis=1) for i in range(0, len(qi), 65536)]) if len(qi) else np.zeros(0)
    order = np.lexsort([ids[xi], -score, qi])
    qi, xi, score = qi[order], xi[order], score[order]
    nth = np.arange(len(qi)) - np.searchsorted(qi, qi)
    return qi[nth < k], xi[nth < k], score[nth < k]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten()).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding"))


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row of vectors (vec_id, embedding) that meets is_query."""
    spark = vectors.sparkSession
    good = usable(vectors)
    common = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    good = good.filter(F.size("embedding") == common.d)
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    total, most = good.agg(F.count(F.lit(1)), F.max(norm2)).first()
    ids = good.agg(F.count_distinct("vec_id")).first()[0]
    if ids < total:
        good, total = written(good.groupBy("vec_id").agg(F.max("embedding").alias("embedding")), "distinct-vectors"), ids
    some = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    index = spark.sparkContext.broadcast(build(np.asarray(some["vec_id"]), _matrix(some["embedding"]), float(most), total, k))
    lists = len(index.value.centroids)

    def assign(batches):
        own = index.value
        for batch in batches:
            if batch.num_rows:
                near = np.concatenate([_nearest(own.lifted(_matrix(batch.column(1).slice(i, 1024))), own.centroids) for i in range(0, batch.num_rows, 1024)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], ["vec_id", "embedding", "list"])

    def visit(batches):
        own = index.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                q_ids = np.asarray(part.column(0))
                q = own.query(_matrix(part.column(1)))
                near = np.argsort(_distances(q, own.centroids), axis=1)[:, : own.visits]
                there = np.zeros((len(q), len(own.centroids)), bool)
                there[np.arange(len(q))[:, None], near] = True
                d = _distances(q, own.sample)
                d[~there[:, own.sample_list] | (q_ids[:, None] == own.sample_ids[None, :])] = np.inf
                # Of the lists visited, the sample's (k + SPARE)-th nearest is no nearer than the k-th of all.
                bound = np.partition(d, k + SPARE - 1, axis=1)[:, k + SPARE - 1] if d.shape[1] >= k + SPARE else np.full(len(q), np.inf)
                row = pa.array(np.repeat(np.arange(len(q)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(np.repeat(bound, near.shape[1])), pa.array(near.ravel(), pa.int32())], ["query_id", "q", "bound", "list"])

    placed = written(good.mapInArrow(assign, "vec_id long, embedding array<double>, list int"), "vectors")
    visits = written(good.filter(is_query).mapInArrow(visit, "query_id long, q array<double>, bound double, list int"), "visits")
    # One row for each list.
    rows = {r.list: r.n for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
        q_ids, ids = np.asarray(left["query_id"]), np.asarray(right["vec_id"])
        qi, xi, score = scan_cell(index.value, _matrix(left["q"]), q_ids, np.asarray(left["bound"]), _matrix(right["embedding"]), ids, k)
        return pa.table([pa.array(q_ids[qi]), pa.array(ids[xi]), pa.array(score)], names)

    def found(asked: DataFrame) -> DataFrame:
        asks = {r.list: r.n for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        cells = spark.createDataFrame([(c, -(-rows.get(c, 0) // CELL_ROWS) or 1, -(-asks.get(c, 0) // QUERY_ROWS) or 1) for c in range(lists)], "list int, cells int, crowds int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x = placed.join(F.broadcast(cells), "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int").alias("cell"), spread("crowds").alias("crowd"), "vec_id", "embedding")
        q = asked.join(F.broadcast(cells), "list").select("list", spread("cells").alias("cell"), F.pmod(F.xxhash64("query_id"), F.col("crowds")).cast("int").alias("crowd"), "query_id", "q", "bound")
        key = ["list", "cell", "crowd"]
        pairs = q.groupBy(*key).cogroup(x.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")
        nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = written(found(visits), "nearest")
    enough = first.filter(F.col("rank") == min(k, total - 1)).select("query_id")
    short = written(visits.select("query_id", "q").dropDuplicates(["query_id"]).join(enough, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return first
    # Queries that the tests left with too few go to all lists without a bound.
    every = short.select("query_id", "q", F.lit(float("inf")).alias("bound"), F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"))
    return first.join(short, "query_id", "left_anti").unionByName(found(every))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op6_ann": op6_ann}
ORACLES: dict[str, str] = {}
