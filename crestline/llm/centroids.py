"""Centroid clustering of integer vectors with column expressions only.

Vectors are rounded down to integers, so that distances, sums and centroids are
exact and the result does not depend on how rows are spread over tasks. A round
is one scan: ``zip_with`` and ``aggregate`` give the squared distance to every
centroid of a literal array, ``array_min`` of (distance, number) structs picks
one, and one sum per component, combined map-side, moves the centroids. What
reaches the driver is k rows of component sums, whatever the number of vectors.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.session import materialize

# Beyond this a squared distance over 64 components may leave 64 bits.
LARGEST = 1 << 27


def integer_vectors(vectors: DataFrame, size: int = 64, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) with ``v`` = floor(scale * component) of the vectors to keep.

    Kept are rows whose vector has exactly ``size`` components, none of them
    null, NaN or infinite.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where((F.size("e") == size) & finite)

    def whole(x: Column) -> Column:
        y = F.floor(x * F.lit(float(scale)))
        return F.when(F.abs(y) <= LARGEST, y).otherwise(F.raise_error(F.lit(f"a vector component times {scale} is beyond {LARGEST}")).cast("long"))

    return kept.select("vec_id", F.transform("e", whole).alias("v"))


def first_centroids(points: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest hex sha256 of ``<seed>:<vec_id>``; equal hashes go by components, rows without an id come last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in points.orderBy(name.asc_nulls_last(), "v").limit(k).select("v").collect()]


def nearest(centroids: list[list[int]], vector: str = "v") -> Column:
    """(d, k): squared distance to the nearest centroid and its number, the smaller one among equals.

    The centroids are one literal, an array of (components, number, squared
    length). |v - c|^2 is |v|^2 + |c|^2 - 2 v c, and |v|^2 does not matter for
    the choice, so that a component costs one product.
    """
    known = json.dumps([{"at": c, "k": i, "cc": sum(x * x for x in c)} for i, c in enumerate(centroids)])
    # Folded to a literal array before the plan runs; thousands of single literals would take the driver seconds.
    literal = F.from_json(F.lit(known), F.lit("array<struct<at:array<bigint>,k:int,cc:bigint>>"))

    def dot(x, y) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("long"), lambda total, p: total + p)

    best = F.array_min(F.transform(literal, lambda c: F.struct((c["cc"] - 2 * dot(vector, c["at"])).alias("d"), c["k"].alias("k"))))
    return F.struct((best["d"] + dot(vector, vector)).alias("d"), best["k"].alias("k"))


def moved(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: the floor of the mean of their vectors; one without vectors stays."""
    size = len(centroids[0])
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(size)]
    out = list(centroids)
    for r in points.select("v", nearest(centroids)["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[r["k"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: str = "2", vec_id: str = "vec_id", embedding: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every kept vector, final centroids).

    Vectors of another size, or with a null, NaN or infinite component, are
    left out (see ``integer_vectors``). Rows without an id are clustered like
    others; repeated rows count as often as they occur; with fewer than ``k``
    vectors there are as many centroids as vectors, and none give an empty
    result. Other columns are ignored. A component beyond ``LARGEST`` stops the
    query, since distances would no longer fit 64 bits.
    """
    points = integer_vectors(vectors, size, scale, vec_id, embedding)
    centroids = first_centroids(points, k, seed)
    if not centroids:
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    for _ in range(rounds):
        centroids = moved(points, centroids)
    best = points.select("vec_id", nearest(centroids).alias("best"))
    return best.select("vec_id", F.col("best.k").alias("cluster"), F.col("best.d").alias("distance")), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia (sums of squared distances) and the digest of the cluster's centroid.

    The assignment is stored once; the sums of at most k clusters come back as
    literals, so that adding them needs no shuffle.
    """
    assigned = materialize(assigned, "assigned")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    numbers = range(len(centroids))

    def pick(values: list[Column]) -> Column:
        return F.get(F.array(*values), F.col("cluster")) if values else F.lit(None)

    digests = [F.sha2(F.lit(",".join(map(str, c))).cast("binary"), 256) for c in centroids]
    return assigned.select(
        "vec_id", "cluster", "distance",
        pick([F.lit(sums.get(i, 0)).cast("long") for i in numbers]).cast("long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        pick(digests).cast("string").alias("centroid_sha256"),
    )
