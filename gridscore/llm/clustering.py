"""Centroid clustering of integer vectors with PCA-rotated filtering.

The vectors are rotated once onto their principal axes; stored are the leading coordinates and the norm of the rest. For a
vector and a centroid the distance of the leading coordinates plus the squared difference of the two norms never exceeds
their squared distance. Per vector the centroid of the smallest bound is measured first; only centroids whose bound
does not exceed that distance are measured too. Distances and means are computed in integers, so the rotation, which is in
floating point, decides how much is measured but never the result.

Per round the driver sees one sum per centroid and component, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm.components import discard, stored
from gridscore.session import small_table

#: Components must stay below this, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Vectors whose distances are worked on together.
BLOCK = 4096
#: Leading coordinates that are stored.
LEADING = 12


@dataclass(frozen=True)
class Settings:
    dimensions: int = 64
    scale: int = 64
    clusters: int = 16
    rounds: int = 3
    leading: int = LEADING
    seed: str = "1"


_longs = T.ArrayType(T.LongType(), False)


def whole_vectors(vectors: DataFrame, key: str, vector: str, settings: Settings) -> DataFrame:
    """``key`` and ``v``: floor(scale * component) of the vectors that have all their components, none null or not finite."""
    value = F.col(f"`{vector}`")
    number = F.transform(value, lambda x: x.cast("double"))
    finite = F.forall(number, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    fit = F.transform(number, lambda x: F.when(
        F.abs(settings.scale * x) < LARGEST, F.floor(settings.scale * x).cast("bigint")
    ).otherwise(F.raise_error(F.concat(F.lit("component too large for exact distances: "), x.cast("string"))).cast("bigint")))
    whole = F.when((F.size(value) == settings.dimensions) & finite, fit)
    return vectors.select(F.col(f"`{key}`").alias("key"), whole.alias("v")).where("v is not null")


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def moments(width: int):
    """Number, sums and products of the components of a task's vectors, for the rotation alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            rows = matrix(batch.column("v"), width, np.float64)
            n, total, products = n + len(rows), total + rows.sum(0), products + rows.T @ rows
        flat = np.concatenate([[n], total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "value"])

    return run


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The principal axes as columns, strongest first."""
    flat = np.zeros(1 + width + width * width)
    for row in rows.select("v").mapInArrow(moments(width), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        flat[row.at] = row.value
    if not flat[0]:
        return np.eye(width)
    mean = flat[1 : 1 + width] / flat[0]
    spread = flat[1 + width :].reshape(width, width) / flat[0] - np.outer(mean, mean)
    return np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1]


def rotated(axes: np.ndarray, leading: int):
    """Adds the leading rotated coordinates and the norm of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = matrix(batch.column("v"), len(axes), np.float64) @ axes
            lead = turned[:, :leading]
            lists = pa.ListArray.from_arrays(np.arange(0, lead.size + 1, lead.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(lead).ravel()))
            rest = np.linalg.norm(turned[:, leading:], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), lists, pa.array(rest)], ["key", "v", "lead", "rest"])

    return run


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each vector (ties: the smaller number), and the distances measured."""
    turned = centroids.astype(np.float64) @ axes
    leading = lead.shape[1]
    middle, other = turned[:, :leading], np.linalg.norm(turned[:, leading:], axis=1)
    own, theirs = (lead * lead).sum(1) + rest * rest, (middle * middle).sum(1) + other * other
    bound = (lead * lead).sum(1)[:, None] + (middle * middle).sum(1) - 2 * (lead @ middle.T) + (rest[:, None] - other) ** 2
    bound -= 1e-9 * (own[:, None] + theirs) + 1e-6  # more than rounding can add
    measure = lambda i, c: ((v[i] - centroids[c]) ** 2).sum(1)
    everyone = np.arange(len(v))
    cluster = bound.argmin(1)
    distance = measure(everyone, cluster)
    measured = len(v)
    survives = bound <= distance[:, None]
    survives[everyone, cluster] = False
    for c in np.flatnonzero(survives.any(0)):
        i = np.flatnonzero(survives[:, c])
        d = measure(i, np.full(len(i), c))
        better = (d < distance[i]) | ((d == distance[i]) & (c < cluster[i]))
        cluster[i[better]], distance[i[better]] = c, d[better]
        measured += len(i)
    return cluster, distance, measured


def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, axes: np.ndarray, leading: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(start, BLOCK)
            v = matrix(batch.column("v"), len(axes), np.int64)
            cluster, distance, _ = nearest(v, matrix(batch.column("lead"), leading, np.float64), batch.column("rest").to_numpy(), centroids, axes)
            yield batch, v, cluster, distance


def cluster_sums(centroids: np.ndarray, axes: np.ndarray, leading: int):
    """Per task, for each centroid with vectors: their number (``at`` -1) and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, v, cluster, _ in assigned(batches, centroids, axes, leading):
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, v)
        full = np.flatnonzero(n)
        values = np.column_stack([n[full], total[full]])
        at = np.tile(np.arange(-1, width, dtype=np.int32), len(full))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, width + 1).astype(np.int32)), pa.array(at), pa.array(values.ravel())], ["cluster", "at", "value"])

    return run


def moved(rows: DataFrame, centroids: np.ndarray, axes: np.ndarray, leading: int) -> np.ndarray:
    """The centroids after one round: floor of the exact mean, or as they were without vectors."""
    parts = rows.select("v", "lead", "rest").mapInArrow(cluster_sums(centroids, axes, leading), "cluster int, at int, value bigint")
    sums = {(r.cluster, r.at): int(r.value) for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    after = centroids.copy()
    for c in range(len(centroids)):
        if (c, -1) in sums:
            after[c] = [sums[c, j] // sums[c, -1] for j in range(centroids.shape[1])]
    return after


def distances(centroids: np.ndarray, axes: np.ndarray, leading: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance in assigned(batches, centroids, axes, leading):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["key", "cluster", "distance"])

    return run


def spelled(centroid: Sequence[int]) -> str:
    return ",".join(str(int(x)) for x in centroid)


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """``key``, ``cluster``, ``distance`` (squared) of every whole vector; and ``cluster``, ``centroid`` (components), ``inertia``.

    A vector without the wanted number of components, or with one that is null or not finite, is left out; one of 2^27 or more
    after scaling is an error, because its distances would not fit. The first centroids are the vectors with the smallest
    hexadecimal SHA-256 of ``seed:key``, equal keys by their components; vectors with a null key are assigned but start no
    centroid. Repeated rows count again. Fewer vectors than clusters give fewer centroids, no vectors no rows.
    """
    width = settings.dimensions
    whole = stored(whole_vectors(vectors, key, vector, settings), "vectors")
    name = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("key").cast("string")), 256).alias("name")
    first = whole.where("key is not null").select(name, "v").orderBy("name", "v").limit(settings.clusters).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, width)
    axes, leading = rotation(whole, width), min(settings.leading, width)
    if len(centroids):
        schema = T.StructType([*whole.schema.fields, T.StructField("lead", T.ArrayType(T.DoubleType(), False)), T.StructField("rest", T.DoubleType())])
        rows = stored(whole.mapInArrow(rotated(axes, leading), schema), "rotated")
        for _ in range(settings.rounds):
            centroids = moved(rows, centroids, axes, leading)
        schema = T.StructType([whole.schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        result = stored(rows.mapInArrow(distances(centroids, axes, leading), schema), "assigned")
        discard(rows)
    else:
        result = whole.select("key", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance"))
    inertia = {r.cluster: int(r.inertia) for r in result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect() if r.cluster is not None}
    shape = pa.schema([("cluster", pa.int32()), ("centroid", pa.list_(pa.int64())), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])
    about = [(c, [int(x) for x in v], inertia.get(c, 0), hashlib.sha256(spelled(v).encode()).hexdigest()) for c, v in enumerate(centroids)]
    if len(centroids):
        discard(whole)
    return result.withColumnRenamed("key", key), small_table(vectors.sparkSession, shape, about)
