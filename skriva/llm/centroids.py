"""Centroid clustering by annulus search: exact Lloyd rounds on integer vectors.

Centroids are sorted by norm. A vector's distance to one centroid bounds that to its nearest: by the triangle inequality the nearest one's
norm differs from the vector's by no more than the bound, so it lies in an annulus, whose ends two binary searches find among the sorted
norms. Only the centroids in there are compared, in integers; the annulus is widened by more than the rounding of its ends, so
centroids that tie with the nearest are always compared and the smallest number wins. The bound comes from the centroid of the round before, or,
in the first one, from the centroid with the nearest norm.

The number of centroids and of components are parameters, so what goes to the driver and back has a fixed size. Vectors stay in written tables;
a round reads one, assigns in Arrow batches, and writes the next with each vector's cluster, from which Spark adds up the components per
cluster with map-side combining: a cluster with most of the vectors is no hot key.

Edge cases: vectors that are null, of another length, or with a null or non-finite component are left out; vectors without an id are clustered like others but never
seed; rows that share an id are vectors each (as seeds ordered by their components); with fewer vectors than centroids there are as many centroids as vectors with an id; with none the result is
empty. Components saturate at +-2**27, so that each squared distance fits a long; sums of distances beyond a long are null. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

N_CENTROIDS = 40
DIMENSION = 64
ROUNDS = 5
SCALE = 256
SALT = "2:"
LARGEST = 1 << 27
_ASSIGNED = "id long, v array<int>, cluster int, distance long, compared int"


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors with exactly ``dimension`` finite components, each as floor(scale * x)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    kept = vectors.where((F.size(vector) == dimension) & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"))


def seeds(points: DataFrame, n: int = N_CENTROIDS, salt: str = SALT) -> np.ndarray:
    """The first n points by the hash of their salted id."""
    named = points.where("id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    return np.array([r["v"] for r in named.orderBy("h", "v").limit(n).collect()], np.int64)


def nearest(points: np.ndarray, before: np.ndarray | None, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, centroids compared) of each point; ``before`` is where each was in the round before."""
    norms = np.sqrt((centroids.astype(float) ** 2).sum(1))
    order = np.lexsort((np.arange(len(norms)), norms))
    rising = norms[order]
    own = np.sqrt((points.astype(float) ** 2).sum(1))
    if before is None:
        above = np.searchsorted(rising, own).clip(0, len(rising) - 1)
        below = (above - 1).clip(0)
        before = order[np.where(own - rising[below] < rising[above] - own, below, above)]
    cluster = before.copy()
    distance = ((points - centroids[before]) ** 2).sum(1)
    # Norms and bound are off by far less than one part in 10**9.
    slack = 1e-9 * (own + rising[-1] + 1)
    bound = np.sqrt(distance.astype(float)) + slack
    first, end = np.searchsorted(rising, own - bound, "left"), np.searchsorted(rising, own + bound, "right")
    for place, c in enumerate(order):
        at = np.flatnonzero((first <= place) & (place < end) & (before != c))
        d = ((points[at] - centroids[c]) ** 2).sum(1)
        better = (d < distance[at]) | ((d == distance[at]) & (c < cluster[at]))
        at, d = at[better], d[better]
        cluster[at], distance[at] = c, d
    return cluster, distance, end - first


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """points with cluster, distance and the number of centroids compared; a column ``cluster`` of points gives the first bounds."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
            known = "cluster" in batch.schema.names
            found = nearest(v, batch.column("cluster").to_numpy(zero_copy_only=False) if known else None, centroids)
            columns = [pa.array(c.astype(t)) for c, t in zip(found, (np.int32, np.int64, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), *columns], names=["id", "v", "cluster", "distance", "compared"])

    return points.mapInArrow(assign, _ASSIGNED)


def moved(members: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; centroids without members stay."""
    sums = [F.sum(F.get("v", F.lit(j)).cast("long")).alias(f"s{j}") for j in range(centroids.shape[1])]
    after = centroids.copy()
    for row in members.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # at most one row per centroid
        after[row["cluster"]] = [s // row["n"] for s in row[2:]]
    return after


def clustered(points: DataFrame, scratch: Scratch, n: int = N_CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """(id, v, cluster, distance, compared) after the given number of rounds, and the final centroids. points: (id, v)."""
    points = scratch.keep(points, "points")
    centroids = seeds(points, n, salt)
    if not len(centroids):
        return points.where("false").selectExpr("*", "0 AS cluster", "0L AS distance", "0 AS compared"), centroids
    last = points
    for r in range(rounds + 1):
        now = scratch.keep(assigned(last.select("id", "v", *(["cluster"] if r else [])), centroids), f"round-{r}")
        scratch.drop(f"round-{r - 1}" if r else "points")
        last = now
        if r < rounds:
            centroids = moved(last, centroids)
    return last, centroids


def inertias(points: DataFrame, n: int) -> list[int | None]:
    """The summed distances of each cluster and, last, of all; None where the sum does not fit a long."""
    per = {r["cluster"]: int(r["s"]) for r in points.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    return [s if s < 1 << 63 else None for s in [*(per.get(c, 0) for c in range(n)), sum(per.values())]]


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    points, centroids = clustered(usable(table(spark, sf_dir, "embeddings")), Scratch(spark, "op11"))
    sums = inertias(points, len(centroids))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    listed = lambda values, kind: F.get(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return points.select(
        F.col("id").alias("vec_id"), "cluster", "distance", listed(sums[:-1], "bigint").alias("cluster_inertia"), F.lit(sums[-1]).cast("long").alias("inertia"),
        listed(digests, "string").alias("centroid_sha256"))
