"""Training by epochs against a dense restatement, and what is kept, resumed and logged."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxtally.operators import metrics, runs
from voxtally.plans import epochs

SMALL = {"features": 1 << 8, "steps": 2, "epochs": 6, "rate": 0.3, "patience": 6}


@pytest.fixture(scope="module")
def texts(spark):
    """Labels that words tell only in part; some rows without text or with unknown labels."""
    rng = random.Random(3)
    rows = []
    for i in range(260):
        good = rng.random() < 0.6
        words = [rng.choice("abcdefghij") * 2 for _ in range(rng.randint(0, 9))]
        words += [rng.choice(("good", "nice") if good != (rng.random() < 0.2) else ("bad", "poor"))]
        rows.append((i, " ".join(words), "Positive" if good else "negative"))
    rows += [(900, None, "Positive"), (901, "  ", "Positive"), (902, "good", "neutral"), (903, "bad", None)]
    return spark.createDataFrame(rows, "id long, ENGLISH string, Sentiment string")


@pytest.fixture(scope="module")
def trained(texts):
    return epochs.train(texts, **SMALL)


def dense(run, split):
    """The prepared rows of a side as matrix, labels, weights, steps."""
    rows = run.data.side(split).orderBy("_key").collect()
    x = np.zeros((len(rows), run.settings.features + 1))
    for i, row in enumerate(rows):
        for place, count in zip(row.places, row.counts, strict=True):
            x[i, place] = count * run.data.rarity[place]
        norm = np.linalg.norm(x[i])
        x[i] /= norm if norm else 1
    x[:, -1] = 1
    cells = [np.array([r[name] for r in rows], float) for name in ("label", "weight", "step")]
    return x, *cells


def plain_training(run):
    """Weights after each epoch and the figures, by dense matrices."""
    s, (x, y, w, step), (vx, vy, _, _) = run.settings, dense(run, "train"), dense(run, "val")
    theta, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    keeps, weights, figures, t = np.append(np.ones(x.shape[1] - 1), 0), [], [], 0
    for _ in range(s.epochs):
        losses = hits = 0
        for k in range(s.steps):
            a, b, c = x[step == k], y[step == k], w[step == k]
            p = 1 / (1 + np.exp(-a @ theta))
            losses += -(c * (b * np.log(p) + (1 - b) * np.log(1 - p))).sum()
            hits += ((p > 0.5) == b).sum()
            g, t = a.T @ (c * (p - b)) / c.sum(), t + 1
            m, v = s.beta1 * m + (1 - s.beta1) * g, s.beta2 * v + (1 - s.beta2) * g * g
            theta = theta - s.rate * s.decay * theta * keeps
            theta = theta - s.rate * (m / (1 - s.beta1**t)) / (np.sqrt(v / (1 - s.beta2**t)) + s.epsilon)
        p = 1 / (1 + np.exp(-vx @ theta))
        val_loss = -(vy * np.log(p) + (1 - vy) * np.log(1 - p)).mean()
        weights.append(theta)
        figures.append((losses / w.sum(), hits / len(y), val_loss, ((p > 0.5) == vy).mean()))
    return weights, figures


def test_epochs_equal_a_dense_restatement(trained):
    weights, figures = plain_training(trained)
    got = trained.epochs().orderBy("epoch").collect()
    assert [r.epoch for r in got] == list(range(1, 7))
    for row, want in zip(got, figures, strict=True):
        assert np.allclose((row.train_loss, row.train_acc, row.val_loss, row.val_acc), want, atol=1e-9)
    best = trained.best_epoch().first().best_epoch
    assert best == 1 + int(np.argmax([x[3] for x in figures]))
    assert np.allclose(trained.state.best, weights[best - 1], atol=1e-9)
    assert np.allclose(trained.state.weights, weights[-1], atol=1e-9)


def test_the_kept_model_is_the_best_epochs(trained):
    """Its scores on the validation side are those logged for the best epoch, by the library's own metrics."""
    scored = metrics.weighted_prf(trained.predict("val")).first()
    row = trained.epochs().filter(F.col("epoch") == trained.best_epoch().first().best_epoch).first()
    assert np.allclose(tuple(scored), (row.val_acc, row.val_precision, row.val_recall, row.val_f1))
    assert metrics.accuracy(trained.predict("test")).first()[0] > 0.6


def test_early_stopping(texts):
    run = epochs.train(texts, **SMALL | {"rate": 0.0, "patience": 2, "epochs": 9})
    # nothing moves: the first epoch is the best, two more exhaust the patience, the last is not logged
    assert [r.epoch for r in run.epochs().collect()] == [1, 2, 3]
    assert sorted(r.epoch for r in run.history().collect()) == [1, 2]
    assert run.best_epoch().first().best_epoch == 1
    traced = runs.early_stop(run.epochs(), 2).orderBy("epoch").collect()
    assert [r.stopped for r in traced] == [False, False, True]


def test_a_training_goes_on_from_its_state(texts, trained, tmp_path):
    path = str(tmp_path / "state")
    first = epochs.train(texts, state_path=path, **SMALL | {"epochs": 2})
    again = epochs.train(texts, state_path=path, **SMALL)
    assert len(first.state.history) == 2 and len(again.state.history) == 6
    assert again.state.history[:2] == first.state.history
    assert np.allclose(again.state.weights, trained.state.weights, atol=1e-12)
    done = epochs.train(texts, state_path=path, **SMALL)
    assert done.state.history == again.state.history


def test_classify_any_texts(spark, trained):
    fresh = spark.createDataFrame([(1, "GOOD  nice", "x"), (2, "poor, bad!", None), (3, None, "y")], "id int, t string, places string")
    got = {r.id: r for r in trained.classify(fresh, "t").collect()}
    assert [got[i].model_sentiment for i in (1, 2)] == ["Positive", "Negative"]
    assert got[2].t == "poor, bad!" and got[1].places == "x" and got[3].model_sentiment in ("Positive", "Negative")


def test_only_a_steps_folder_is_read(trained):
    plan = trained.data.side("train", 1)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "(step#" in plan.split("PartitionFilters", 1)[1]


def test_too_few_rows(spark):
    few = spark.createDataFrame([(i, "good", "Positive") for i in range(20)], "id long, ENGLISH string, Sentiment string")
    with pytest.raises(ValueError, match="class"):
        epochs.train(few)


def test_batches_are_taken_in_slices():
    """A large batch is worked on in parts that give the sums of the whole, rows without words included."""
    rng = np.random.default_rng(2)
    places = [None if i % 97 == 0 else np.unique(rng.integers(0, 64, i % 9)).astype(np.int32) for i in range(2 * epochs.SLICE_ROWS + 40)]
    counts = [None if x is None else np.arange(1, len(x) + 1, dtype=np.float32) for x in places]
    columns = [pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))]
    batch = pa.RecordBatch.from_arrays(columns, ["places", "counts"])
    parts = list(epochs.slices(iter([batch.slice(0, 0), batch])))
    assert [x.num_rows for x in parts] == [epochs.SLICE_ROWS, epochs.SLICE_ROWS, 40]
    weights, rarity = rng.normal(size=65), rng.random(64) + 0.5
    whole, cut = epochs.Rows(batch, rarity), [epochs.Rows(x, rarity) for x in parts]
    assert np.allclose(whole.margins(weights), np.concatenate([x.margins(weights) for x in cut]))
    sums = sum(x.gradient(np.ones(x.size), 64) for x in cut)
    assert np.allclose(whole.gradient(np.ones(whole.size), 64), sums)
