"""Hard negatives by Kronecker-packed products.

A component x becomes the integer floor(256 * x). For a block of candidates, component d of all of them, shifted by
the table's least component so that none is negative, is packed into one wide integer with a field a candidate.
An anchor multiplies each of these integers by its own shifted component, once, and adds up: the fields then
hold the shifted inner products of all candidates of the block, wide enough that none overflows into
the next. Taking off the shift's share (from the two component sums) leaves the exact scores.

Anchors are the stated query set and meet all rows, in blocks. Blocks follow (label, vec_id), so that a
label of any size is many blocks. Positives come from the pairs of blocks whose label ranges meet, negatives from
all pairs but those of one and the same label: every pair of rows is multiplied once if labels are few.
A task keeps the best rows of an anchor only, and hands on at most a few for each.

Rows: null labels, null vectors and vectors with a null or non-finite component take no part. A null vec_id
is no anchor, keeps its label, and comes last among equal scores. "Other rows" of an anchor are rows with another
vec_id; repeated rows each count, as anchors and as candidates. A shorter vector counts as if zeros followed it.
Anchors without a positive, or positives without a negative in reach, give no rows; nor does an empty
table. Scores must fit in 56 bits (their hundredfold in a long); larger components are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtally.llm.common import map_batches, written

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
CANDIDATES = 2048
ANCHORS = 256
NO_ID = (1 << 63) - 1
#: Best rows a task holds before it hands them on.
HELD = 200_000
BLOCK = "block long, low long, high long, ids array<long>, labels array<long>, parts binary"


def whole_rows(vectors: DataFrame, relabel: bool = True) -> DataFrame:
    """Rows that take part: vec_id (``NO_ID`` if null), label, parts (integer components)."""
    parts = F.col("embedding").cast("array<double>")
    sound = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bound = float(1 << 53)
    whole = F.transform(parts, lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-bound)), F.lit(bound))))
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    if relabel:
        label = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return vectors.select(
        F.coalesce(vec_id, F.lit(NO_ID)).alias("vec_id"),
        label.alias("label"),
        F.when(F.coalesce(sound, F.lit(False)), whole).alias("parts"),
    ).filter("label is not null and parts is not null")


class Shape:
    """Length of the vectors, shift that makes components non-negative, bytes of a packed field."""

    def __init__(self, length: int, least: int, most: int):
        self.length, self.shift = length, max(0, -least)
        size = max(abs(least), abs(most))
        if length * size * size >= 1 << 56:
            raise ValueError(f"{length} components from {least} to {most}: scores may need more than 56 bits")
        largest = length * (most + self.shift) ** 2
        self.field = np.uint32 if largest < 1 << 32 else np.uint64
        if largest >= 1 << 64:
            raise ValueError(f"{length} components from {least} to {most} are too large for fields of 64 bits")


def blocks(rows: DataFrame, length: int, size: int, extra: str = "") -> DataFrame:
    """Runs of at most ``size`` rows of a partition as one row each; ``parts`` holds the components as int32.

    ``extra`` names an array<long> column of ``rows`` that goes along as an array of arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True))
            while len(held) >= size:
                yield _block(held[:size])
                del held[:size]
        if held:
            yield _block(held)

    def _block(held: list[tuple]) -> pa.RecordBatch:
        parts = np.zeros((len(held), length), "<i4")
        for i, row in enumerate(held):
            parts[i, : len(row[2])] = row[2]
        ids, labels = [row[0] for row in held], [row[1] for row in held]
        columns = [
            pa.array([min(labels)], pa.int64()),
            pa.array([max(labels)], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([labels], pa.list_(pa.int64())),
            pa.array([parts.tobytes()], pa.binary()),
        ]
        names = ["low", "high", "ids", "labels", "parts"]
        if extra:
            columns.append(pa.array([[row[3] for row in held]], pa.list_(pa.list_(pa.int64()))))
            columns.append(pa.array([[row[4] for row in held]], pa.list_(pa.int64())))
            names += [extra, "keys"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = BLOCK.split(", ", 1)[1] + (f", {extra} array<array<long>>, keys array<long>" if extra else "")
    columns = ["vec_id", "label", "parts", *([extra, "key"] if extra else [])]
    return map_batches(rows.select(*columns), run, schema)


class Packed:
    """The candidates of a block, packed by component."""

    def __init__(self, parts: bytes, count: int, shape: Shape):
        shifted = np.frombuffer(parts, "<i4").reshape(count, shape.length).astype(np.int64) + shape.shift
        fields = np.ascontiguousarray(shifted.T.astype(shape.field))
        self.shape, self.count = shape, count
        self.wide = [int.from_bytes(component.tobytes(), "little") for component in fields]
        self.off = shape.shift * shifted.sum(axis=1)

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """The inner products of all candidates with one anchor (its components as they are)."""
        shifted = (anchor.astype(np.int64) + self.shape.shift).tolist()
        total = sum(map(mul, shifted, self.wide))
        fields = np.frombuffer(total.to_bytes(self.count * np.dtype(self.shape.field).itemsize, "little"), self.shape.field)
        # (a + s)(c + s) summed is ac + s(a + s) + s(c + s) - s * s
        shift, length = self.shape.shift, self.shape.length
        return fields.astype(np.int64) - self.off - (shift * sum(shifted) - length * shift * shift)


def _pairs(batches: Iterator[pa.RecordBatch], shape: Shape):
    """For each pair of blocks and anchor: key, id, label, extra, candidates' ids, labels, scores.

    Rows of a pair of blocks: candidate block's number, ids, labels, parts, then the anchors' ids, labels, parts, extra, keys.
    """
    at, candidates, ids, labels = None, None, None, None
    for batch in batches:
        for i in range(batch.num_rows):
            number = batch.column(0)[i].as_py()
            if number != at:
                ids, labels = (np.array(batch.column(k)[i].as_py(), np.int64) for k in (1, 2))
                candidates, at = Packed(batch.column(3)[i].as_py(), len(ids), shape), number
            names, kinds = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
            anchors = np.frombuffer(batch.column(6)[i].as_py(), "<i4").reshape(len(names), shape.length)
            extra, keys = batch.column(7)[i].as_py(), batch.column(8)[i].as_py()
            for key, name, kind, more, anchor in zip(keys, names, kinds, extra, anchors, strict=True):
                yield key, name, kind, more, ids, labels, candidates.scores(anchor)


def _first(ids: np.ndarray, scores: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The first (-score, id) by score and id."""
    if len(ids) > 4 * count:  # ties at the border stay in
        border = np.partition(scores, len(scores) - count)[len(scores) - count]
        near = scores >= border
        ids, scores = ids[near], scores[near]
    return sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:count]


def _handed(best: dict, fields: list[str]) -> pa.RecordBatch:
    flat = [(*key, -score, name) for key, rows in best.items() for score, name in rows]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in range(len(fields))], fields)


def _merge(best: dict, key: tuple, rows: list, count: int) -> None:
    known = best.get(key)
    best[key] = rows if known is None else sorted(known + rows)[:count]


def positives(pairs: DataFrame, shape: Shape) -> DataFrame:
    """(key, score, vec_id): of each task and anchor the first rows of the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, fields = {}, ["key", "score", "vec_id"]
        for key, name, kind, _, ids, labels, scores in _pairs(batches, shape):
            mine = (labels == kind) & (ids != name)
            if mine.any():
                _merge(best, (key,), _first(ids[mine], scores[mine], POSITIVES), POSITIVES)
            if len(best) * POSITIVES > HELD:
                yield _handed(best, fields)
                best = {}
        yield _handed(best, fields)

    return map_batches(pairs, run, "key long, score long, vec_id long")


def negatives(pairs: DataFrame, shape: Shape) -> DataFrame:
    """(key, place, score, vec_id): of each task, anchor and positive the first rows in the score band.

    The anchors' extra holds the scores of their positives, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, fields = {}, ["key", "place", "score", "vec_id"]
        for key, _, kind, found, ids, labels, scores in _pairs(batches, shape):
            hundred = 100 * scores
            apart = labels != kind
            for place, positive in enumerate(found):
                band = apart & (hundred >= LOW * positive) & (hundred <= HIGH * positive)
                known = best.get((key, place))
                if known is not None and len(known) == NEGATIVES:
                    band &= scores >= -known[-1][0]
                if band.any():
                    _merge(best, (key, place), _first(ids[band], scores[band], NEGATIVES), NEGATIVES)
            if len(best) * NEGATIVES > HELD:
                yield _handed(best, fields)
                best = {}
        yield _handed(best, fields)

    return map_batches(pairs, run, "key long, place long, score long, vec_id long")


def _met(candidates: DataFrame, anchors: DataFrame, extra: str, condition: str) -> DataFrame:
    """Pairs of blocks: the query set against all rows, in blocks."""
    left = candidates.select("block", *(F.col(x).alias(f"c_{x}") for x in ("low", "high", "ids", "labels", "parts")))
    right = anchors.select(*(F.col(x).alias(f"a_{x}") for x in ("low", "high", "ids", "labels", "parts", extra, "keys")))
    return left.join(right, F.expr(condition)).select(
        "block", "c_ids", "c_labels", "c_parts", "a_ids", "a_labels", "a_parts", f"a_{extra}", "a_keys"
    )


def _numbered(rows: DataFrame, by: list[str], place: str) -> DataFrame:
    first = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn(place, F.row_number().over(first))


def mine(vectors: DataFrame, every: int = 100, relabel: bool = True) -> DataFrame:
    """Hard negatives of the rows (vec_id, embedding, label) whose vec_id is divisible by ``every``.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(whole_rows(vectors, relabel))
    count, length, least, most = rows.agg(
        F.count("*"), F.max(F.size("parts")), F.min(F.array_min("parts")), F.max(F.array_max("parts"))
    ).first()
    if not count:
        return spark.createDataFrame([], schema)
    length = max(1, length)
    shape = Shape(length, min(0, least or 0), max(0, most or 0))  # zeros may follow a vector

    def laid(of: DataFrame, n: int, size: int) -> DataFrame:
        # a partition a block, about; a hot label goes on in the next one
        return of.repartitionByRange(max(1, -(-n // size)), "label", "vec_id").sortWithinPartitions("label", "vec_id")

    number = F.monotonically_increasing_id()
    candidates = written(blocks(laid(rows, count, CANDIDATES), length, CANDIDATES).select(number.alias("block"), "*"))
    anchors = rows.filter((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID))
    anchors = written(anchors.select(number.alias("key"), "*", F.array().cast("array<long>").alias("scores")))
    n_anchors = anchors.count()
    first = written(blocks(laid(anchors, n_anchors, ANCHORS), length, ANCHORS, "scores"))
    meet = "c_low <= a_high and a_low <= c_high"
    found = _numbered(positives(_met(candidates, first, "scores", meet), shape), ["key"], "place")
    found = written(found.filter(F.col("place") <= POSITIVES))
    by_anchor = found.groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores")
    )
    second = written(blocks(laid(anchors.drop("scores").join(by_anchor, "key"), n_anchors, ANCHORS), length, ANCHORS, "scores"))
    apart = "not (c_low = c_high and a_low = a_high and c_low = a_low)"
    ranked = _numbered(negatives(_met(candidates, second, "scores", apart), shape), ["key", "place"], "rank")
    ranked = ranked.filter(F.col("rank") <= NEGATIVES).select(
        "key", (F.col("place") + 1).alias("place"), "rank", F.col("score").alias("negative_score"), F.col("vec_id").alias("negative")
    )
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (
        ranked.join(found.withColumnsRenamed({"score": "positive_score", "vec_id": "positive"}), ["key", "place"])
        .join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
        .select(
            "anchor_id", named("positive").alias("positive_id"), "rank", named("negative").alias("negative_id"),
            "positive_score", "negative_score",
        )
    )
