"""Centroid clustering with exact integer distances from bit planes.

A component x of a vector becomes the integer floor(256 * x). Shifted by the table's least component these are
numbers of P bits. Bit plane j of a vector packs bit j of its 64 components into one unsigned 64-bit number,
so a vector is P such numbers. The dot product of a vector and a centroid is the sum over all pairs of
planes of 2**(i + j) times the number of ones in the AND of plane i and plane j; with the squared lengths this
gives the squared distance, which the shift does not change.

Planes are written once. A round reads them, assigns each vector, and sums members by cluster within the
task; the driver sees a row of sums a cluster and gives the next centroids to the tasks. Groups are never
gathered, so a cluster may hold any share of the vectors.

Rows: vectors that are null, have not exactly 64 components, or have a null or non-finite one take no part and
are not in the result. Repeated rows are separate vectors. Of equal distances the smaller cluster number
wins; of equal hashes (repeated ids) the smaller components start first. A null vec_id takes part, but starts a
centroid only if too few vectors have an id. With fewer vectors than centroids there are as many
centroids as vectors; an empty table gives no rows. Components that need more than 28 bits after the shift
are refused with an error, as distances would not fit in a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import map_batches, written

COMPONENTS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
#: So that 64 * 4**MAX_BITS fits in a long.
MAX_BITS = 28
#: Vectors compared with all centroids at a time.
TOGETHER = 2048

_WEIGHTS = np.uint64(1) << np.arange(COMPONENTS - 1, -1, -1, dtype=np.uint64)


def whole_components(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors that take part: vec_id, parts (the integer components)."""
    parts = F.col(column).cast("array<double>")
    sound = (F.size(parts) == COMPONENTS) & F.forall(
        parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    bound = float(1 << 53)
    whole = F.transform(parts, lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-bound)), F.lit(bound))))
    return vectors.select(F.col("vec_id").cast("long"), F.when(F.coalesce(sound, F.lit(False)), whole).alias("parts")).filter(
        "parts is not null"
    )


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """(n, 64) numbers of ``bits`` bits as (n, bits) planes; component 0 is the highest bit of a plane."""
    out = np.empty((len(values), bits), np.uint64)
    for j in range(bits):
        ones = ((values >> np.int64(j)) & np.int64(1)).astype(np.uint8)
        out[:, j] = np.packbits(ones, axis=1).view(">u8")[:, 0]
    return out


def values_of(planes: np.ndarray) -> np.ndarray:
    """The (n, 64) numbers of planes."""
    out = np.zeros((len(planes), COMPONENTS), np.int64)
    for j in range(planes.shape[1]):
        column = np.ascontiguousarray(planes[:, j]).astype(">u8").view(np.uint8).reshape(-1, 8)
        out |= np.unpackbits(column, axis=1).astype(np.int64) << np.int64(j)
    return out


def distances(planes: np.ndarray, lengths: np.ndarray, centre_planes: np.ndarray, centre_lengths: np.ndarray) -> np.ndarray:
    """Squared distances (vectors, centroids); ``lengths`` are squared lengths."""
    dots = np.zeros((len(planes), len(centre_planes)), np.int64)
    for i in range(planes.shape[1]):
        column = planes[:, i, None]
        for j in range(centre_planes.shape[1]):
            dots += np.bitwise_count(column & centre_planes[None, :, j]).astype(np.int64) << np.int64(i + j)
    return lengths[:, None] + centre_lengths[None, :] - 2 * dots


class Centroids:
    """Centroids as shifted numbers, with their planes and squared lengths."""

    def __init__(self, values: np.ndarray, bits: int):
        self.values, self.planes = values, planes_of(values, bits)
        self.lengths = (values * values).sum(axis=1)

    def nearest(self, planes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, the first of equals, and its distance."""
        cluster, distance = np.empty(len(planes), np.int64), np.empty(len(planes), np.int64)
        for start in range(0, len(planes), TOGETHER):
            part = slice(start, start + TOGETHER)
            found = distances(planes[part], lengths[part], self.planes, self.lengths)
            cluster[part] = found.argmin(axis=1)
            distance[part] = found.min(axis=1)
        return cluster, distance


def _read(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    planes = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, bits)
    return planes, batch.column(2).to_numpy(zero_copy_only=False)


def packed(whole: DataFrame, shift: int, bits: int) -> DataFrame:
    """Per vector: vec_id, planes, length (the squared length of the shifted vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS) - shift
            planes = pa.array(planes_of(values, bits).ravel().view(np.int64))
            offsets = pa.array(np.arange(0, bits * len(values) + 1, bits, dtype=np.int32))
            columns = [batch.column(0), pa.ListArray.from_arrays(offsets, planes), pa.array((values * values).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "planes", "length"])

    return map_batches(whole.select("vec_id", "parts"), run, "vec_id long, planes array<long>, length long")


def member_sums(vectors: DataFrame, centres: Centroids, bits: int) -> list:
    """Rows (cluster, n, sums of the shifted components), one for each cluster with members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centres.values), np.int64)
        sums = np.zeros(centres.values.shape, np.int64)
        for batch in batches:
            planes, lengths = _read(batch, bits)
            cluster, _ = centres.nearest(planes, lengths)
            order = np.argsort(cluster, kind="stable")
            met, starts = np.unique(cluster[order], return_index=True)
            if len(met):
                sums[met] += np.add.reduceat(values_of(planes)[order], starts, axis=0)
                count[met] += np.diff([*starts, len(order)])
        met = np.flatnonzero(count)
        columns = [pa.array(met), pa.array(count[met]), *(pa.array(x) for x in sums[met].T)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", *names])

    names = [f"s{d}" for d in range(COMPONENTS)]
    schema = "cluster long, n long, " + ", ".join(f"{x} long" for x in names)
    parts = map_batches(vectors, run, schema)
    wide = "decimal(38,0)"  # sums over very many vectors
    total = parts.groupBy("cluster").agg(*(F.sum(F.col(x).cast(wide)).alias(x) for x in ("n", *names)))
    return total.collect()


def assigned(vectors: DataFrame, centres: Centroids, bits: int) -> DataFrame:
    """Per vector: vec_id, cluster, distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = centres.nearest(*_read(batch, bits))
            columns = [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return map_batches(vectors, run, "vec_id long, cluster int, distance long")


def first_centroids(whole: DataFrame, count: int, seed: int) -> list[list[int]]:
    """The components of the vectors with the smallest hash of ``seed:vec_id``."""
    hashed = whole.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "parts")
    return [row.parts for row in hashed.orderBy(F.col("hash").asc_nulls_last(), "parts").limit(count).collect()]


def digest(parts: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, parts)).encode()).hexdigest()


def cluster_vectors(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, column: str = "embedding"
) -> DataFrame:
    """Per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``centroids`` bounds what the driver holds: that many centroids and their sums.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    whole = written(whole_components(vectors, column))
    least, most = whole.agg(F.min(F.array_min("parts")), F.max(F.array_max("parts"))).first()
    if least is None:
        return spark.createDataFrame([], schema)
    bits = max(1, int(most - least).bit_length())
    if bits > MAX_BITS:
        raise ValueError(f"components from {least} to {most} need {bits} bits, {MAX_BITS} are allowed")
    planes = written(packed(whole, least, bits))
    centres = Centroids(np.array(first_centroids(whole, centroids, seed), np.int64) - least, bits)
    for _ in range(rounds):
        values = centres.values.copy()
        for row in member_sums(planes, centres, bits):
            values[row.cluster] = [int(row[f"s{d}"]) // int(row.n) for d in range(COMPONENTS)]
        if (values == centres.values).all():
            break
        centres = Centroids(values, bits)
    final = written(assigned(planes, centres, bits))
    inertia = {r.cluster: int(r.total) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    total = sum(inertia.values())
    rows = [(k, x, total, digest((centres.values[k] + least).tolist())) for k, x in sorted(inertia.items())]
    summary = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(summary), "cluster").select(*(part.split()[0] for part in schema.split(", ")))
