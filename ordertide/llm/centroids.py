"""k-means over integer vectors by Elkan's bounds: most distances are ruled out by the triangle inequality and not computed.

Each vector keeps an upper bound of the distance to its centroid and a lower bound of that to each. When centroids move, bounds
widen by how far they moved. A centroid is ruled out only where its bound, or half its distance from the vector's own, is
*strictly* beyond the upper bound; bounds are rounded away from each other, so a tie is never ruled out. Distances that are
computed are exact, in integers, and they alone decide. Vectors and bounds are one table, written anew in each round; sums of
the clusters come out of the same pass, a row for each cluster and batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertide.llm.common import read
from ordertide.session import discard, fresh_path

#: Components beyond this would leave 64 bits when squared and added up.
MOST = 1 << 27
_UP, _DOWN = np.float32(np.inf), np.float32(-np.inf)


def _above(x: np.ndarray) -> np.ndarray:
    """The doubles, as singles that aren't less."""
    y = x.astype(np.float32)
    return np.where(y.astype(np.float64) < x, np.nextafter(y, _UP), y)


def _below(x: np.ndarray) -> np.ndarray:
    y = np.maximum(x, 0).astype(np.float32)
    return np.maximum(np.where(y.astype(np.float64) > x, np.nextafter(y, _DOWN), y), np.float32(0))


def _root_above(d2: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(d2.astype(np.float64)), np.inf), np.inf)  # the integer and the root are each rounded once


def _root_below(d2: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(d2.astype(np.float64)), -np.inf), -np.inf), 0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row, the bounds, and how many distances were computed. ``own`` -1: nothing is known yet.

    ``moved``: how far each centroid moved since the bounds were taken, rounded up. Arrays of bounds are changed in place.
    """
    k = len(centroids)
    fresh = own < 0
    own = np.where(fresh, 0, own)
    upper[:] = np.where(fresh, _UP, _above(upper.astype(np.float64) + moved[own]))
    lower[:] = _below(np.nextafter(lower.astype(np.float64) - moved, -np.inf))
    apart = np.array([[0 if a == b else _root_below(squared(centroids[a : a + 1], centroids[b : b + 1]))[0] / 2 for b in range(k)] for a in range(k)])
    near = apart + np.where(np.eye(k, dtype=bool), np.inf, 0)
    rows = np.flatnonzero(~(upper < near[own].min(axis=1))) if k > 1 else np.flatnonzero(fresh)
    of = np.arange(k)

    def open_(r: np.ndarray, c: int) -> np.ndarray:
        return (own[r] != c) & ~(upper[r] < lower[r, c]) & ~(upper[r] < apart[own[r], c])

    maybe = (own[rows][:, None] != of) & ~(upper[rows][:, None] < lower[rows]) & ~(upper[rows][:, None] < apart[own[rows]])
    rows = rows[maybe.any(axis=1) | fresh[rows]]
    best = squared(x[rows], centroids[own[rows]])
    done = len(rows)
    upper[rows] = _above(_root_above(best))
    lower[rows, own[rows]] = _below(_root_below(best))
    for c in range(k):
        m = np.flatnonzero(open_(rows, c))
        r = rows[m]
        d2 = squared(x[r], centroids[c : c + 1])
        done += len(r)
        lower[r, c] = _below(_root_below(d2))
        less = (d2 < best[m]) | ((d2 == best[m]) & (c < own[r]))
        own[r[less]], best[m[less]] = c, d2[less]
        upper[r[less]] = _above(_root_above(d2[less]))
    return own, upper, lower, done


def _state_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("vec_id", id_type), T.StructField("x", T.BinaryType()), T.StructField("own", T.IntegerType()), T.StructField("bounds", T.BinaryType()),
            T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("computed", T.LongType()), T.StructField("part", T.IntegerType()),
        ]
    )


def _pass(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, dims: int) -> DataFrame:
    """The state after an assignment (part 0), and with it the clusters' counts and sums of each batch (part 1)."""
    k = len(centroids)
    schema = state.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<i4").reshape(n, dims).astype(np.int64)
            own = np.array(b.column("own"), np.int64)
            bounds = np.frombuffer(b"".join(b.column("bounds").to_pylist()), "<f4").reshape(n, k + 1).copy()
            own, upper, lower, done = assign(x, own, bounds[:, 0].copy(), bounds[:, 1:].copy(), centroids, moved)
            kept = np.concatenate([upper[:, None], lower], axis=1).astype("<f4")
            wide = (k + 1) * 4
            raw = kept.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("x"), pa.array(own, pa.int32()), pa.array([raw[i : i + wide] for i in range(0, len(raw), wide)], pa.binary()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.array(np.zeros(n), pa.int32())],
                names=schema.names,
            )
            there = np.unique(own)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(there), b.column("vec_id").type), pa.nulls(len(there), pa.binary()), pa.array(there, pa.int32()), pa.nulls(len(there), pa.binary()),
                 pa.array([int((own == c).sum()) for c in there], pa.int64()), pa.array([x[own == c].sum(axis=0).tolist() for c in there], pa.list_(pa.int64())),
                 pa.array([done] + [0] * (len(there) - 1), pa.int64()), pa.array(np.ones(len(there)), pa.int32())],
                names=schema.names,
            )

    return state.mapInArrow(run, schema)


def _put(df: DataFrame) -> DataFrame:
    """Written with a folder for the vectors and one for the sums, so that reading one leaves the other's files closed."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "clusters")
    df.write.option("compression", "zstd").partitionBy("part").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def vectors(embeddings: DataFrame, dims: int, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and x, the integers floor(scale * component), of vectors with ``dims`` components, none null or non-finite."""
    e = F.col(embedding)
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform(e, lambda v: F.floor(v.cast("double") * scale))
    far = F.exists(e, lambda v: F.abs(v.cast("double")) >= MOST / scale)
    checked = F.when(far, F.raise_error(F.lit(f"a component of {MOST // scale} or more: squared distances would leave 64 bits")).cast("array<bigint>")).otherwise(whole)
    return embeddings.where((F.size(e) == dims) & finite).select(F.col(vec_id).alias("vec_id"), checked.alias("x"))


def cluster(rows: DataFrame, *, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, progress: list | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of ``rows`` (vec_id and x, of ``vectors``).

    Centroids start as the ``k`` vectors with the least sha256 of ``seed:vec_id``, ties by components; null ids come last there. With
    fewer vectors than ``k`` there are as many centroids as vectors. An empty cluster's centroid stays. Vectors and ids that
    repeat are each a row. No rows give none. A component beyond 2^27 raises an error, since distances wouldn't fit a long.
    The driver holds centroids and one sum a cluster; ``progress`` takes the number of distances that each assignment computed.
    """
    spark: SparkSession = rows.sparkSession
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(order.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()  # k vectors
    centroids = np.array([r.x for r in first], np.int64).reshape(len(first), dims)
    k = len(first)
    schema = _state_schema(rows.schema["vec_id"].dataType)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = np.array(b.column("x").flatten(), np.int64).astype("<i4").tobytes()
            blank = np.concatenate([[np.inf], np.zeros(k)]).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([x[i * dims * 4 : (i + 1) * dims * 4] for i in range(n)], pa.binary()), pa.array(np.full(n, -1), pa.int32()), pa.array([blank] * n, pa.binary()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.array(np.zeros(n), pa.int32())],
                names=schema.names,
            )

    state, moved = rows.mapInArrow(begin, schema), np.zeros(k)
    for i in range(rounds + 1 if k else 0):
        before, state = state, _put(_pass(state, centroids, moved, dims))
        if i:
            discard(before.whole)
        whole = state
        if i < rounds:
            # k sums of ``dims`` numbers
            wide = F.posexplode("sums").alias("d", "s")
            cells = whole.where("part = 1").select("own", wide).groupBy("own", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
            counts = {r.own: (r.n, r.c) for r in whole.where("part = 1").groupBy("own").agg(F.sum("n").alias("n"), F.sum("computed").alias("c")).collect()}
            after = centroids.copy()
            for r in cells:
                after[r.own, r.d] = int(r.s) // counts[r.own][0]
            if progress is not None:
                progress.append(sum(c for _, c in counts.values()))
            moved, centroids = _root_above(squared(centroids, after)), after
        state = whole.where("part = 0")
        state.whole = whole

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<i4").reshape(n, dims).astype(np.int64)
            own = np.array(b.column("own"), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own, pa.int32()), pa.array(squared(x, centroids[own]), pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    near = (state if k else state.limit(0)).mapInArrow(finish, f"vec_id {kind}, cluster int, distance bigint")
    names = [(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    sums = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    of = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    small = of.join(F.broadcast(sums), "cluster").join(F.broadcast(total))  # k rows and one
    return near.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(vectors(read(spark, sf_dir, "embeddings"), 64))


def sql(rounds: int = 10, k: int = 8) -> str:
    """The same rounds as one query: all distances, and sums by component."""
    d = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = f"""WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), x) - 1 AS INTEGER) AS cluster, x FROM v ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), x LIMIT {k})"""
    for i in range(rounds + 1):
        out += f",\na{i} AS (SELECT v.i, v.vec_id, v.x, arg_min(c.cluster, ({d}, c.cluster)) AS cluster, CAST(min({d}) AS BIGINT) AS distance FROM v, c{i} c GROUP BY v.i, v.vec_id, v.x)"
        if i < rounds:
            out += f""",
s{i} AS (SELECT cluster, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(j) GROUP BY ALL),
m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM s{i} GROUP BY cluster),
c{i + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster))"""
    return out + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c USING (cluster)"""


OP12_SQL = sql()
