"""Lloyd's centroid clustering by differences, in exact integers.

Every vector's cluster and distance are kept in a table, and every cluster's sum and count with the driver.
A round looks at what changed only: a vector whose own centroid stayed is compared with the centroids that
moved, as the others are no nearer than before; a vector whose own centroid moved is compared with all. Vectors
that go over to another cluster are written apart, and the sums follow from them alone: each adds its integers
to one cluster and takes them from another. Where no centroid moves the rest of the rounds change nothing
and are left out. All of it is integer arithmetic, so the outcome doesn't depend on the order of tasks.

A round writes the vectors anew in the shared folder and drops the table of the round before, so a lost
executor costs its tasks only. What reaches the driver is one sum a cluster and component.

Cases: vectors that are null, of another length, or hold null or non-finite components (or some beyond 2^48)
are left out; repeated rows are vectors of their own; a null vec_id is clustered, but begins a cluster only
where there are too few others; of starts with equal hashes the vector that is smaller component by component
comes first; with fewer vectors than clusters, each begins one; equal centroids leave all to the smaller
number, and the empty ones stay where they are; distances or sums beyond a long are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm._common import discard, lean, small_batches, table, written
from timelode.llm._vectors import LONG, column_sums, finite, lists, longs, matrix, scaled, square_sums

DIMENSIONS, CLUSTERS, ROUNDS, SALT = 64, 8, 10, 3
#: A distance goes as a decimal, so that it is exact for any vectors.
STATE = "vec_id long, x array<long>, cluster int, was int, distance decimal(38,0), moved boolean"


def usable(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    e = F.col("embedding")
    return vectors.filter(finite(e) & (F.size(e) == dimensions)).select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding"))


def starts(good: DataFrame, clusters: int, key: Column) -> np.ndarray:
    """The vectors of the least keys, as integers."""
    first = good.orderBy(F.asc_nulls_last(key), "embedding").limit(clusters).select("embedding").toArrow()["embedding"].combine_chunks()
    return scaled(matrix(first))


def apart(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from a centroid."""
    return square_sums(x - centroid)


def nearest(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, distance: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of the rows of x after the centroids in changed have moved; cluster is -1 where a row has none yet."""
    cluster, distance = cluster.copy(), distance.copy()
    lost = (cluster < 0) | changed[cluster]
    for rows, rivals in ((np.flatnonzero(lost), range(len(centroids))), (np.flatnonzero(~lost), np.flatnonzero(changed).tolist())):
        if not len(rows) or not len(rivals):
            continue
        own, at = (np.full(len(rows), -1), None) if len(rivals) == len(centroids) else (cluster[rows], distance[rows])
        for k in rivals:
            d = apart(x[rows], centroids[k])
            nearer = np.ones(len(rows), bool) if at is None else (d < at) | ((d == at) & (k < own))
            at, own = d if at is None else np.where(nearer, d, at), np.where(nearer, k, own)
        distance = distance.astype(object) if at.dtype == object else distance
        cluster[rows], distance[rows] = own, at
    return cluster, distance


def _decimals(values: np.ndarray) -> pa.Array:
    return pa.array(values).cast(pa.decimal128(38, 0)) if values.dtype != object else pa.array(values.tolist(), pa.decimal128(38, 0))


def _integers(column: pa.Array) -> np.ndarray:
    """The values of a decimal column, as int64 where they all fit."""
    try:
        return np.asarray(column.cast(pa.int64()))
    except pa.ArrowInvalid:
        return np.array([int(v) for v in column.to_pylist()], object)


def _assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The vectors with their clusters after a move of centroids; those that went over are written apart."""
    shared = state.sparkSession.sparkContext.broadcast((centroids, changed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, moved = shared.value
        for batch in small_batches(batches):
            if not batch.num_rows:
                continue
            if batch.num_columns == 2:
                x, before, d = scaled(matrix(batch.column(1))), np.full(batch.num_rows, -1), np.zeros(batch.num_rows, np.int64)
            else:
                x, before, d = matrix(batch.column(1)), np.asarray(batch.column(2)), _integers(batch.column(3))
            cluster, d = nearest(x, own, before, d, moved)
            columns = [batch.column(0), lists(x), pa.array(cluster, pa.int32()), pa.array(before, pa.int32()), _decimals(d), pa.array(cluster != before)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in STATE.split(", ")])

    known = [c for c in ("embedding", "x", "cluster", "distance") if c in state.columns]
    return written(state.select("vec_id", *known).mapInArrow(lean(run), STATE), "clusters", by=("moved",))


def _transfers(state: DataFrame, clusters: int) -> list[list[int]]:
    """What the vectors that went over add to each cluster, or take from it: a count and a sum for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                x = np.column_stack([np.ones(len(x), np.int64), x])
                for sign, column in ((1, 1), (-1, 2)):
                    of = np.asarray(batch.column(column))
                    for k in np.unique(of[of >= 0]).tolist():
                        own[k] = own.get(k, 0) + sign * column_sums(x[of == k])
        rows = [(k, i, v) for k, sums in own.items() for i, v in enumerate(sums.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.decimal128(38, 0))], ["cluster", "i", "v"])

    parts = state.filter("moved").select("x", "cluster", "was").mapInArrow(lean(run), "cluster int, i int, v decimal(38,0)")
    out = [[0] * (DIMENSIONS + 1) for _ in range(clusters)]
    # One row for each cluster and component.
    for r in parts.groupBy("cluster", "i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect():
        out[r.cluster].extend([0] * (r.i + 1 - len(out[r.cluster])))
        out[r.cluster][r.i] = int(r.v)
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, key: Column | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, cluster, was, distance, moved of every usable vector; the centroids). Starts are the vectors with the least keys."""
    good = usable(vectors, dimensions)
    key = F.sha2(F.concat(F.lit(f"{SALT}:"), F.col("vec_id").cast("string")), 256) if key is None else key
    centroids = starts(good, clusters, key)
    state = _assigned(good, centroids, np.ones(len(centroids), bool))
    sums = np.zeros((len(centroids), dimensions + 1), object)
    for _ in range(rounds if len(centroids) else 0):
        sums = sums + np.array(_transfers(state, len(centroids)), object)
        fresh = np.array([[int(v) // int(s[0]) for v in s[1:]] if s[0] else c.tolist() for s, c in zip(sums, centroids, strict=True)], np.int64)
        changed = (fresh != centroids).any(axis=1)
        if not changed.any():
            break
        centroids, before = fresh, state
        state = _assigned(before, centroids, changed)
        discard(before)
    return state, centroids


def clustered(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    spark = vectors.sparkSession
    state, centroids = cluster(vectors)
    inertia = {r.cluster: LONG if r.d is None else int(r.d) for r in state.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}
    fits = lambda v: v if v < LONG else None
    rows = [(k, fits(inertia.get(k, 0)), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    # One row for each cluster.
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", F.expr("try_cast(distance AS BIGINT)").alias("distance")).join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds one after another, each over all vectors and centroids."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS k, x AS c FROM v ORDER BY sha256('{SALT}:' || vec_id) LIMIT {CLUSTERS})",
    ]
    square = "list_sum(list_transform(list_zip(v.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(d := CAST(d AS BIGINT), k := k)) AS best FROM (SELECT v.rid, v.vec_id, v.x, c.k, {square} AS d FROM v, c{r} AS c) GROUP BY rid)")
        if r < ROUNDS:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT k, list(m ORDER BY i) AS c FROM (SELECT best.k AS k, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
                FROM a{r}, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i) GROUP BY best.k, i) GROUP BY k)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))")
    last = f"a{ROUNDS}"
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM {last} JOIN c{ROUNDS} AS c ON c.k = {last}.best.k"
    )


QUERIES = {"op13_centroids": op13_centroids}
ORACLES = {"op13_centroids": _oracle()}
