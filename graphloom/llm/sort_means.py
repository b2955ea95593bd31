"""Centroid clustering by sort-means on exact integers.

A vector starts from the centroid it was last assigned to and looks at the others in the order of their distance from
that one; beyond twice its own distance none can be as near, so the scan stops (strictly beyond: ties go to the smaller
number). Each round is one pass: tasks write the vectors with their cluster and, in the same files, their sums by
cluster, so that a task that is run again counts once. The driver sees k sums of a fixed width a round, no vectors.

Edge cases: vectors that are null, of another length, or hold a null or a value that is not finite are left out; null
ids count as the empty text in the hash; repeated rows are vectors of their own; equal hashes (repeated ids) are ordered by
their components; with fewer than k vectors there are as many centroids as vectors; an empty table gives no rows;
components saturate at the bounds of a long; a distance or inertia that no long holds is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import discard, stored

#: Vectors that are compared together.
BLOCK = 4096
_LONG = 2**63 - 1


def integer_vectors(embeddings: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>): the whole vectors, each component floor(scale * x)."""
    kept = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).filter(
        (F.size("x") == dims) & F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    )
    top, low = float(2**63), F.lit(-_LONG - 1)
    whole = lambda y: F.when(y >= top, F.lit(_LONG)).when(y < -top, low).otherwise(F.floor(y))
    return kept.select("vec_id", F.transform("x", lambda c: whole(c * F.lit(float(scale)))).alias("v"))


def nearest(x: np.ndarray, centroids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every row of x, each scanned from its cluster ``start``; ties to the smaller number."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    best, dist = start.copy(), np.empty(len(x), dtype=x.dtype)
    for c in np.unique(start):
        rows = np.flatnonzero(start == c)
        own = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
        far = np.argsort(-own, kind="stable")
        rows, own = rows[far], own[far]
        y, least, at = x[rows], own.copy(), np.full(len(rows), c)
        # rows in falling distance: those that still look at a centroid (its distance from c, squared, is at most 4 times theirs) come first
        for o in sorted((o for o in range(len(centroids)) if o != c), key=lambda o: (between[c, o], o)):  # noqa: B023
            n = int(np.searchsorted(-own, -((between[c, o] + 3) // 4), side="right"))
            if not n:
                break
            d = ((y[:n] - centroids[o]) ** 2).sum(axis=1)
            nearer = (d < least[:n]) | ((d == least[:n]) & (o < at[:n]))
            least[:n][nearer], at[:n][nearer] = d[nearer], o
        best[rows], dist[rows] = at, least
    return best, dist


def _exact(x: np.ndarray, centroids: list[list[int]], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`nearest` in 64 bits where they suffice, else in Python's integers."""
    # below this bound of all components squared distances stay below 2**62
    bound = math.isqrt(2**60 // x.shape[1])
    wide = np.abs(x.astype(np.float64)).max(axis=1, initial=0) >= bound
    small = np.array([i for i, c in enumerate(centroids) if max(map(abs, c)) < bound], np.int64)
    cluster, dist = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    if not len(small):
        wide[:] = True
    rows = np.flatnonzero(~wide)
    if len(rows):
        # a scan may start anywhere: from the first small centroid where the last one was not small
        place = np.maximum(np.searchsorted(small, start[rows]), 0)
        place = np.where(small[np.minimum(place, len(small) - 1)] == start[rows], place, 0)
        got, d = nearest(x[rows], np.array([centroids[i] for i in small], np.int64), place)
        cluster[rows], dist[rows] = small[got], d
        for i in set(range(len(centroids))).difference(small.tolist()):
            # a rough distance tells whether a large centroid can be meant
            rough = ((x[rows].astype(np.float64) - np.array(centroids[i], np.float64)) ** 2).sum(axis=1)
            wide[rows[rough * (1 - 1e-9) <= d.astype(np.float64)]] = True
    rows = np.flatnonzero(wide)
    if len(rows):
        cluster[rows], dist[rows] = nearest(x[rows].astype(object), np.array(centroids, dtype=object), start[rows])
    return cluster, dist


def _assigned(state: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """The vectors with cluster and distance; and, in rows with n, a task's sums by cluster of components and of distances (``spent``)."""
    k = len(centroids)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, spent, id_type = [0] * k, [[0] * dims for _ in range(k)], [0] * k, None
        for batch in it:
            id_type = batch.schema.field("vec_id").type
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                m = part.num_rows
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                cluster, dist = _exact(x, centroids, part.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64))
                x = x if np.abs(x.astype(np.float64)).max(initial=0) < 2**50 else x.astype(object)
                for i in np.unique(cluster):
                    at = cluster == i
                    n[i] += int(at.sum())
                    sums[i] = [a + int(b) for a, b in zip(sums[i], x[at].sum(axis=0), strict=True)]
                    spent[i] += int(dist[at].sum())
                held = pa.array([d if d <= _LONG else None for d in map(int, dist)], pa.int64())
                yield _rows(id_type, m, vec_id=part.column("vec_id"), v=part.column("v"), cluster=cluster, distance=held)
        if used := [i for i in range(k) if n[i]]:
            yield _rows(
                id_type, len(used), cluster=used, n=[n[i] for i in used], sums=[[str(s) for s in sums[i]] for i in used],
                spent=[str(spent[i]) if spent[i] <= _LONG else None for i in used],
            )

    return state.mapInArrow(run, f"vec_id {dict(state.dtypes)['vec_id']}, v array<bigint>, cluster int, distance bigint, n bigint, sums array<string>, spent string")


_FIELDS = {"v": pa.list_(pa.int64()), "cluster": pa.int32(), "distance": pa.int64(), "n": pa.int64(), "sums": pa.list_(pa.string()), "spent": pa.string()}


def _rows(id_type: pa.DataType, m: int, **cols) -> pa.RecordBatch:
    """A batch of m rows; columns that are not given are null."""
    types = {"vec_id": id_type, **_FIELDS}
    full = [pa.nulls(m, t) if c not in cols else cols[c] if isinstance(cols[c], pa.Array) else pa.array(cols[c], t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(full, names=list(types))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [list(r[0]) for r in vectors.select("v", F.sha2(text, 256).alias("h")).orderBy("h", "v").limit(k).select("v").collect()]


def cluster_vectors(
    embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of every kept vector, and (cluster, size, cluster_inertia, inertia, centroid array<bigint>) of every centroid with vectors."""
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings, dims, scale, id_col, vec_col)
    centroids = first_centroids(vectors, k, seed)
    state, before = vectors.withColumn("cluster", F.lit(0)), None
    for r in range(rounds + 1):
        done, path = stored(_assigned(state, centroids, dims))
        if before:
            discard(spark, before)
        before, told = path, done.filter("n IS NOT NULL")
        state = done.filter("n IS NULL").select("vec_id", "v", "cluster")
        if r < rounds:
            each = told.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
            # k sums of fixed width
            for c, i, n, s in each.collect():
                centroids[c][i] = int(s) // n
    total = F.when(F.max(F.col("spent").isNull()), F.lit(None)).otherwise(F.sum(F.col("spent").cast("decimal(20,0)")))
    per = told.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("s")).collect()
    fits = lambda s: int(s) if s is not None and s <= _LONG else None
    inertia = None if any(s is None for _, _, s in per) else fits(sum(int(s) for _, _, s in per))
    info = [(c, n, fits(s), inertia, centroids[c]) for c, n, s in per]
    return done.filter("n IS NULL").select("vec_id", "cluster", "distance"), spark.createDataFrame(info, "cluster int, size long, cluster_inertia long, inertia long, centroid array<bigint>")


def cluster_digest(embeddings: DataFrame, **params) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): the centroid as decimal integers joined by commas."""
    assigned, centroids = cluster_vectors(embeddings, **params)
    said = centroids.select("cluster", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    # k rows
    return assigned.join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
