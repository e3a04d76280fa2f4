import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voxtally.operators import splits


def table(spark, counts):
    rows, i = [], 0
    for label, n in counts.items():
        for _ in range(n):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "id long, label string")


def by_hand(rows, fraction, seed="42"):
    """Quotas by largest remainder, filled in hash order."""
    sizes = Counter(label for _, label in rows)
    n, draws = len(rows), math.ceil(fraction * len(rows))
    shares = {c: k / n * draws for c, k in sizes.items()}
    quota = {c: math.floor(s) for c, s in shares.items()}
    missing = draws - sum(quota.values())
    order = sorted(sizes, key=lambda c: (-(shares[c] - quota[c]), (c is not None, c or "")))
    for c in order[:missing]:
        quota[c] += 1
    groups = defaultdict(list)
    for i, label in rows:
        groups[label].append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    return {i for label, members in groups.items() for _, i in sorted(members)[: quota[label]]}


@pytest.mark.parametrize("fraction", [0.2, 0.4, 0.37])
@pytest.mark.parametrize("counts", [{"a": 50, "b": 13, "c": 7}, {"a": 1000, "b": 2}, {"a": 5, None: 6}])
@pytest.mark.parametrize("bucket_rows", [1_000_000, 1])
def test_split_is_exact(spark, counts, fraction, bucket_rows):
    frame = table(spark, counts)
    got = splits.stratified_split(frame, "id", "label", fraction, stratify=True, bucket_rows=bucket_rows)
    test = {r.id for r in got.filter("split = 'test'").collect()}
    rows = [(r.id, r.label) for r in frame.collect()]
    assert test == by_hand(rows, fraction)
    assert len(test) == math.ceil(fraction * len(rows))
    assert got.count() == len(rows)


def test_a_class_of_one_turns_classes_off(spark):
    frame = table(spark, {"a": 30, "b": 1})
    got = splits.stratified_split(frame, "id", "label", 0.2)
    test = {r.id for r in got.filter("split = 'test'").collect()}
    assert test == by_hand([(r.id, 0) for r in frame.collect()], 0.2)


def test_three_ways(spark):
    frame = table(spark, {"a": 700, "b": 300})
    got = splits.three_way_split(frame, "id", "label", bucket_rows=10)
    sizes = Counter((r.split, r.label) for r in got.collect())
    assert sizes == {
        ("train", "a"): 560, ("train", "b"): 240, ("val", "a"): 70, ("val", "b"): 30, ("test", "a"): 70, ("test", "b"): 30,
    }
    distribution = splits.split_distribution(got, "label").filter("split = 'val' AND label = 'a'").first()
    assert (distribution.n, distribution.split_rows) == (70, 100)


def test_ratios_are_nested_and_exact(spark):
    frame = table(spark, {"a": 61, "b": 39})
    rows = [(r.id, r.label) for r in frame.collect()]
    got = splits.split_ratios(frame, "id", "label").collect()
    previous = set(range(100))
    for ratio, fraction in splits.SPLIT_RATIOS.items():
        test = {r.id for r in got if r[splits.ratio_column(ratio)] == "test"}
        assert test == by_hand(rows, fraction) and test <= previous
        previous = test


def test_seed_changes_the_rows_not_the_sizes(spark):
    frame = table(spark, {"a": 40, "b": 20})
    one, two = (
        {r.id for r in splits.stratified_split(frame, "id", "label", 0.2, seed=s).filter("split = 'test'").collect()}
        for s in (1, 2)
    )
    assert len(one) == len(two) == 12 and one != two


def test_a_repeated_key_is_refused(spark):
    frame = spark.range(100).select(F.lit(7).alias("id"), F.lit("a").alias("label"))
    with pytest.raises(ValueError, match="unique"):
        splits.stratified_split(frame, "id", "label", 0.2, bucket_rows=10)


def test_many_classes(spark):
    frame = spark.range(3000).select("id", (F.col("id") % 1000).alias("label"))
    got = splits.stratified_split(frame, "id", "label", 0.4)
    assert got.filter("split = 'test'").count() == 1200
    assert got.filter("split = 'test'").groupBy("label").count().filter("count > 2 OR count < 1").count() == 0


def test_split_neither_sorts_nor_shuffles_the_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    got = splits.stratified_split(rows, "o_orderkey", "o_orderstatus", 0.2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan and "Sort" not in plan


@pytest.mark.parametrize("folds", [2, 3, 10])
def test_folds_are_exact_by_class_and_in_all(spark, folds):
    rng = random.Random(folds)
    labels = ["a"] * 700 + ["b"] * 61 + [None] * 5 + ["c"] * 2 + ["d"]
    rng.shuffle(labels)
    df = spark.createDataFrame(list(enumerate(labels)), "id long, label string")
    got = splits.stratified_folds(df, "id", "label", folds, bucket_rows=20).collect()
    assert len(got) == len(labels) and {r.fold for r in got} == set(range(folds))
    for kind in {*labels, "all"}:
        sizes = [sum(r.fold == k and kind in (r.label, "all") for r in got) for k in range(folds)]
        assert max(sizes) - min(sizes) <= 1, (kind, sizes)
    again = splits.stratified_folds(df.repartition(3), "id", "label", folds).collect()
    assert sorted((r.id, r.fold) for r in again) == sorted((r.id, r.fold) for r in got)


def test_folds_need_two(spark):
    with pytest.raises(ValueError, match="at least 2"):
        splits.stratified_folds(spark.range(9), "id", None, 1)
    plain = splits.stratified_folds(spark.range(9), "id", None, 3).groupBy("fold").count().collect()
    assert [r["count"] for r in plain] == [3, 3, 3]
