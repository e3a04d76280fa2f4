"""Landmark features against the exact kernel and beside random Fourier features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from voxtally.plans import kernel_svm, nystrom


@pytest.fixture(scope="module")
def blobs(spark):
    """Three groups of very unequal size in eight dimensions, with copies."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 8)) * 3
    which = rng.choice(3, 300, p=[0.8, 0.15, 0.05])
    x = centres[which] + rng.normal(size=(300, 8)) * 0.5
    x[200:230] = x[0]
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, values array<double>")
    return frame, x


def mapped(stage, frame):
    return np.array([r.features.toArray() for r in stage.transform(frame).orderBy("i").collect()])


def test_landmarks_beat_random_features_and_the_bound_holds(blobs):
    frame, x = blobs
    gamma = 0.05
    exact = nystrom.kernel(x, x, gamma)
    errors = []
    for count in (8, 32, 96):
        points = nystrom.landmarks(frame, "i", "values", gamma, count)
        assert len(points) <= count and len({tuple(p) for p in points.tolist()} & {tuple(r) for r in x.tolist()}) == len(points)
        z = mapped(nystrom.NystromFeatures.by(points, "values", gamma), frame)
        error = exact - z @ z.T
        told = nystrom.error_bound(frame, "values", points, gamma).first()
        assert told.landmarks == len(points) and told.mean_residual == pytest.approx(np.trace(error) / len(x), abs=1e-6)
        assert told.largest_residual == pytest.approx(np.diag(error).max(), abs=1e-6)
        lacking = np.sqrt(np.clip(np.diag(error), 0, None) + 1e-6)
        assert (np.abs(error) <= np.outer(lacking, lacking) + 1e-5).all()
        fourier = mapped(kernel_svm.FourierFeatures(inputCol="values", gamma=gamma, dimension=count), frame)
        errors.append((np.abs(error).mean(), np.abs(exact - fourier @ fourier.T).mean()))
    assert all(ours < random for ours, random in errors) and errors[0][0] > errors[2][0]


def test_landmarks_do_not_depend_on_the_layout(blobs):
    frame, _ = blobs
    first, second = (nystrom.landmarks(df, "i", "values", 0.05, 24) for df in (frame.coalesce(1), frame.repartition(7)))
    assert first.tolist() == second.tolist()


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "i long, values array<double>")
    assert nystrom.landmarks(frame, "i", "values", 0.5, 8).tolist() == [[1.0, 2.0]]
    assert nystrom.landmarks(frame.limit(0), "i", "values", 0.5, 8).shape == (0, 0)


def test_the_machine_with_landmarks(spark, tmp_path):
    """Rings: the accuracy beside the Fourier map's at equal size, and a saved model answers alike."""
    rng = np.random.default_rng(1)
    angle, inner = rng.uniform(0, 2 * np.pi, 400), np.arange(400) % 2
    radius = np.where(inner, 1.0, 3.0) + rng.normal(0, 0.2, 400)
    rows = [(i, float(r * np.cos(a)), float(r * np.sin(a)), int(k)) for i, (a, r, k) in enumerate(zip(angle, radius, inner, strict=True))]
    frame = spark.createDataFrame(rows, "row_id long, x double, y double, Score int")
    data = kernel_svm.prepare(frame, "Score")
    options = {"C": 100.0, "gamma": 1.0, "dimension": 16, "iterations": 15}
    ours, random = (kernel_svm.fit(data, kernel_map=name, **options) for name in ("nystrom", "fourier"))
    ours_right, random_right = (run.accuracy().first()[0] for run in (ours, random))
    assert ours_right > 0.97 and ours_right >= random_right
    ours.model.write().overwrite().save(str(tmp_path / "m"))
    test = data.rows.filter(F.col("split") == "test")
    answers = [m.transform(test).select("row_id", "prediction") for m in (ours.model, PipelineModel.load(str(tmp_path / "m")))]
    assert answers[0].exceptAll(answers[1]).isEmpty()
    with pytest.raises(ValueError, match="no such map"):
        kernel_svm.fit(data, kernel_map="other")


def test_rows_are_mapped_in_blocks(spark):
    """Whatever Spark hands over at once, few rows are mapped at a time."""
    sizes = [3 * nystrom.BLOCK_ROWS + 7, 0, 1]
    blocks = list(nystrom.row_blocks(pd.Series([np.full(4, i) for i in range(n)], dtype=object) for n in sizes))
    assert [len(b) for b in blocks] == [nystrom.BLOCK_ROWS] * 3 + [7, 0, 1]
    rows = spark.range(1000).coalesce(1).selectExpr("id", "array(id / 1000, 1d) as scaled")
    mapping = kernel_svm.FourierFeatures(inputCol="scaled", gamma=0.5, dimension=8)
    got = {r.id: r.features.toArray() for r in mapping.transform(rows).collect()}
    generator = np.random.default_rng(kernel_svm.SEED)
    matrix, shift = generator.normal(0.0, 1.0, (2, 8)), generator.uniform(0.0, 2.0 * np.pi, 8)
    assert all(np.allclose(got[i], 0.5 * np.cos(np.array([i / 1000, 1.0]) @ matrix + shift)) for i in range(1000))
