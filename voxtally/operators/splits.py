"""Exact stratified splits that never rank a whole class in one task.

Rows are ordered within their class by the MD5 of seed and key, and the first ``quota`` of a
class go to the test side. Only the row at the quota has to be found, not a rank for every row:

1. count rows per (class, first hash digits); running sums show in which bucket the quota ends;
2. while that bucket is large, count again inside it by three more digits;
3. rank the few rows of that one bucket and take its cut row.

Membership is then a comparison with the cut row of the class, so the data itself is neither
shuffled nor sorted; it is read once per step, and only its label and key columns in steps 1-3.
Rows that are costly to make should be written first (``voxtally.session.written``).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.operators.classes import class_summary
from voxtally.session import bounded_table, broadcast_table

_DIGITS = 3
_HASH_LENGTH = 32
BUCKET_ROWS = 1_000_000


def split_hash(seed: int | str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def class_quotas(counts: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """Rows of each class to draw for each fraction: ``stratum, cut, quota``.

    ``counts`` holds ``stratum, n``. ``ceil(fraction * rows)`` rows are drawn in all; a class
    gets the whole part of its share, and the rows then missing go to the largest remainders
    (of equal ones, to the smaller label).
    """
    cuts = F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(float(f)).alias("fraction")) for i, f in enumerate(fractions)])
    per_cut = Window.partitionBy("cut")
    by_remainder = per_cut.orderBy(F.desc("remainder"), F.asc_nulls_first("stratum"))
    return (
        counts.select("stratum", "n", F.inline(cuts))
        .withColumn("rows", F.sum("n").over(per_cut))
        .withColumn("draws", F.ceil(F.col("fraction") * F.col("rows")))
        .withColumn("share", F.col("n") / F.col("rows") * F.col("draws"))
        .withColumn("whole", F.floor("share"))
        .withColumn("remainder", F.col("share") - F.col("whole"))
        .withColumn("missing", F.col("draws") - F.sum("whole").over(per_cut))
        .withColumn("extra", (F.row_number().over(by_remainder) <= F.col("missing")).cast("int"))
        .select("stratum", "cut", (F.col("whole") + F.col("extra")).alias("quota"))
    )


def _running(buckets: DataFrame, *order: str) -> DataFrame:
    upto = (
        Window.partitionBy("stratum", "cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return buckets.withColumn("upto", F.sum("n").over(upto))


def _at_quota(buckets: DataFrame) -> DataFrame:
    before = F.col("upto") - F.col("n")
    return buckets.filter((before < F.col("quota")) & (F.col("upto") >= F.col("quota"))).withColumn(
        "quota", F.col("quota") - before
    )


def _inside(hashed: DataFrame, ends: DataFrame, digits: int) -> DataFrame:
    """The hashed rows that lie in the bucket where a quota ends."""
    ends = ends.select(F.col("stratum").alias("_stratum"), "cut", "bucket", "quota")
    same = F.col("stratum").eqNullSafe(F.col("_stratum")) & (F.substring("hash", 1, digits) == F.col("bucket"))
    return hashed.join(ends, same).drop("_stratum", "bucket")


def _fetch(df: DataFrame, largest: str) -> tuple[DataFrame, int]:
    """A small table, ready for broadcasting if its size allows, and the maximum of a column."""
    table = bounded_table(df)
    if table is None:
        return df, df.agg(F.max(largest)).first()[0] or 0
    return broadcast_table(df, table), pc.max(table[largest]).as_py() or 0


def fold_quotas(counts: DataFrame, folds: int) -> DataFrame:
    """Rows of each class in the first folds up to each one but the last: ``stratum, cut, quota``.

    Rows are dealt in turn to the folds, class after class, so that sizes differ by one row at most, within each
    class and in all.
    """
    before = Window.orderBy(F.asc_nulls_first("stratum")).rowsBetween(Window.unboundedPreceding, -1)
    dealt = lambda place: (  # noqa: E731  of the first rows of all classes, those in folds up to the cut's
        F.call_function("div", place, F.lit(folds)) * (F.col("cut") + 1) + F.least(place % folds, F.col("cut") + 1)
    )
    first = F.col("first")
    return (
        counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
        .select("stratum", "n", "first", F.explode(F.sequence(F.lit(0), F.lit(folds - 2))).alias("cut"))
        .select("stratum", "cut", (dealt(first + F.col("n")) - dealt(first)).alias("quota"))
    )


def cut_rows(
    df: DataFrame,
    key: str,
    stratum: Column,
    fractions: Sequence[float],
    seed: int | str,
    bucket_rows: int = BUCKET_ROWS,
    folds: int | None = None,
) -> DataFrame:
    """Per class the last row inside each fraction: ``stratum, cut_0, cut_1, ...``.

    A cut is a struct of hash and key, NULL if the class gives no row to that fraction. With ``folds`` the cuts are the
    last rows of the folds but the last one, instead of those of ``fractions``.
    """
    hashed = df.select(stratum.alias("stratum"), split_hash(seed, key).alias("hash"), F.col(key).alias("key"))

    digits = _DIGITS
    buckets = hashed.groupBy("stratum", F.substring("hash", 1, digits).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = buckets.groupBy("stratum").agg(F.sum("n").alias("n"))
    quotas = class_quotas(counts, fractions) if folds is None else fold_quotas(counts, folds)
    n_cuts = len(fractions) if folds is None else folds - 1
    named = quotas.withColumnRenamed("stratum", "_stratum")
    with_quota = buckets.join(named, F.col("stratum").eqNullSafe(F.col("_stratum"))).drop("_stratum")
    columns = ("stratum", "cut", "bucket", "n", "quota")
    ends, largest = _fetch(_at_quota(_running(with_quota, "bucket")).select(*columns), "n")

    while digits < _HASH_LENGTH and largest > bucket_rows:
        finer = F.substring("hash", 1, min(digits + _DIGITS, _HASH_LENGTH)).alias("bucket")
        inside = _inside(hashed, ends, digits).groupBy("stratum", "cut", "quota", finer)
        digits = min(digits + _DIGITS, _HASH_LENGTH)
        finer_ends = _at_quota(_running(inside.agg(F.count(F.lit(1)).alias("n")), "bucket"))
        ends, largest = _fetch(finer_ends.select(*columns), "n")

    candidates = _inside(hashed, ends, digits).groupBy("stratum", "cut", "quota", "hash", "key")
    last = _at_quota(_running(candidates.agg(F.count(F.lit(1)).alias("n")), "hash", "key"))
    wide = last.groupBy("stratum").agg(
        F.max("n").alias("copies"),
        *[F.max(F.when(F.col("cut") == i, F.struct("hash", "key"))).alias(f"cut_{i}") for i in range(n_cuts)],
    )
    cuts, copies = _fetch(wide, "copies")
    if copies > 1:
        raise ValueError(f"{key!r} is not unique, an exact split needs a unique key")
    return cuts.drop("copies")


def mark_fractions(
    df: DataFrame,
    key: str,
    label: str | None,
    fractions: Sequence[float],
    names: Sequence[str],
    seed: int | str = 42,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add one boolean column per fraction: whether the row is among the first of its class."""
    stratum = F.lit(0) if label is None else F.col(label)
    cuts = cut_rows(df, key, stratum, fractions, seed, bucket_rows).withColumnRenamed("stratum", "_stratum")
    position = F.struct(split_hash(seed, key).alias("hash"), F.col(key).alias("key"))
    tests = {
        name: F.coalesce(position <= F.col(f"cut_{i}"), F.lit(False)) for i, name in enumerate(names)
    }
    joined = df.join(cuts, stratum.eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumns(tests).drop("_stratum", *[f"cut_{i}" for i in range(len(names))])


def _stratum_label(df: DataFrame, label: str | None, stratify: bool | str) -> str | None:
    if stratify == "auto" and label is not None:
        smallest = class_summary(df, label).first()["min_class_count"]
        stratify = smallest is not None and smallest >= 2
    return label if stratify else None


def stratified_split(
    df: DataFrame,
    key: str,
    label: str | None,
    test_fraction: float = 0.2,
    seed: int | str = 42,
    stratify: bool | str = "auto",
    name: str = "split",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``split`` = train/test with exact sizes overall and per class.

    ``stratify="auto"`` splits without classes when one of them has fewer than two rows, at the
    price of one more pass over the label column.
    """
    used = _stratum_label(df, label, stratify)
    marked = mark_fractions(df, key, used, [test_fraction], ["_test"], seed, bucket_rows)
    return marked.withColumn(name, F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def three_way_split(
    df: DataFrame,
    key: str,
    label: str | None,
    held_fraction: float = 0.2,
    test_share: float = 0.5,
    seed: int | str = 42,
    name: str = "split",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``split`` = train/val/test: a part is held back, then shared between val and test."""
    held = mark_fractions(df, key, label, [held_fraction], ["_held"], seed, bucket_rows)
    second_seed = f"{seed}:2"
    stratum = F.lit(0) if label is None else F.col(label)
    cuts = cut_rows(held.filter("_held"), key, stratum, [test_share], second_seed, bucket_rows)
    cuts = cuts.withColumnRenamed("stratum", "_stratum")
    position = F.struct(split_hash(second_seed, key).alias("hash"), F.col(key).alias("key"))
    side = (
        F.when(~F.col("_held"), "train")
        .when(F.coalesce(position <= F.col("cut_0"), F.lit(False)), "test")
        .otherwise("val")
    )
    joined = held.join(cuts, stratum.eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn(name, side).drop("_held", "_stratum", "cut_0")


def stratified_folds(
    df: DataFrame,
    key: str,
    label: str | None,
    folds: int = 5,
    seed: int | str = 42,
    name: str = "fold",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add the number of the row's fold, 0 to ``folds - 1``, dealt by class.

    The last row of every fold and class is found in one descent; a row's fold then follows from comparisons.
    """
    if folds < 2:
        raise ValueError(f"{folds} fold(s), at least 2 needed")
    stratum = F.lit(0) if label is None else F.col(label)
    cuts = cut_rows(df, key, stratum, (), seed, bucket_rows, folds).withColumnRenamed("stratum", "_stratum")
    position = F.struct(split_hash(seed, key).alias("hash"), F.col(key).alias("key"))
    fold = F.lit(folds - 1)
    for i in reversed(range(folds - 1)):
        fold = F.when(F.coalesce(position <= F.col(f"cut_{i}"), F.lit(False)), i).otherwise(fold)
    joined = df.join(cuts, stratum.eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn(name, fold).drop("_stratum", *(f"cut_{i}" for i in range(folds - 1)))


SPLIT_RATIOS = {"60/40": 0.4, "70/30": 0.3, "80/20": 0.2}


def ratio_column(ratio: str) -> str:
    return "split_" + ratio.replace("/", "_")


def split_ratios(
    df: DataFrame,
    key: str,
    label: str | None,
    ratios: dict[str, float] | None = None,
    seed: int | str = 42,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One train/test column per ratio over one hash order, so smaller test sides are nested in
    larger ones. All cuts come from the same passes."""
    ratios = ratios or SPLIT_RATIOS
    marks = [f"_mark{i}" for i in range(len(ratios))]
    marked = mark_fractions(df, key, label, list(ratios.values()), marks, seed, bucket_rows)
    columns = {
        ratio_column(ratio): F.when(F.col(mark), "test").otherwise("train") for ratio, mark in zip(ratios, marks)
    }
    return marked.withColumns(columns).drop(*marks)


def split_distribution(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Rows per split and class, with the size of the split beside them."""
    counted = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("split_rows", F.sum("n").over(Window.partitionBy(split)))
