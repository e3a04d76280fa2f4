import random
from collections import Counter

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from voxtally.operators import metrics, runs, words


@pytest.fixture(scope="module")
def guesses(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), rng.choice([0, 1, 2, 3])) for i in range(400)]
    return spark.createDataFrame(rows, "id long, label int, prediction int"), rows


def test_scalars_agree_with_spark_ml(guesses):
    frame, _ = guesses
    doubles = frame.select(F.col("label").cast("double"), F.col("prediction").cast("double"))
    row = metrics.weighted_prf(frame).first()
    for name, metric in [("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "weightedFMeasure")]:
        assert abs(row[name] - MulticlassClassificationEvaluator(metricName=metric).evaluate(doubles)) < 1e-12
    assert abs(metrics.accuracy(frame).first()[0] - row.accuracy) < 1e-12


def test_confusion_has_zero_cells_and_sums_to_support(guesses):
    frame, rows = guesses
    cells = {(r.label, r.prediction): r.n for r in metrics.confusion_matrix(frame).collect()}
    counted = Counter((a, b) for _, a, b in rows)
    assert cells == {(a, b): counted[a, b] for a in range(4) for b in range(4)}
    table = metrics.confusion_table(frame, [0, 1, 2, 3]).collect()
    assert [r[str(c)] for r in table for c in range(4)] == [counted[a, b] for a in range(4) for b in range(4)]
    assert [r.label for r in metrics.label_axis(frame).collect()] == [0, 1, 2, 3]


def test_report(guesses):
    frame, rows = guesses
    report = metrics.classification_report(frame).collect()
    assert [r["class"] for r in report] == ["0", "1", "2", "3", "accuracy", "macro avg", "weighted avg"]
    assert [r.support for r in report[4:]] == [400] * 3
    assert (report[3].precision, report[3].recall, report[3].f1, report[3].support) == (0.0, 0.0, 0.0, 0)
    assert report[4].precision is None and abs(report[4].f1 - sum(a == b for _, a, b in rows) / 400) < 1e-12
    for name in ("precision", "recall", "f1"):
        per_class = [r[name] for r in report[:4]]
        assert abs(report[5][name] - sum(per_class) / 4) < 1e-12
        assert abs(report[6][name] - sum(p * r.support for p, r in zip(per_class, report[:4])) / 400) < 1e-12
    assert metrics.classification_report(frame, digits=4).first().precision == round(report[0].precision, 4)


def test_report_reads_the_predictions_once(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", (F.col("label") % 3).alias("prediction"))
    plan = metrics.classification_report(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_binary_cells(spark):
    frame = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (1, 1)], "label int, prediction int")
    assert tuple(metrics.confusion_cells(frame).first()) == (1, 1, 1, 2)


def test_batch_accuracy_weighs_batches_not_rows(spark):
    frame = spark.range(17).select("id", F.lit(1).alias("label"), (F.col("id") == 16).cast("int").alias("prediction"))
    row = metrics.batch_accuracy(frame, "id").first()
    assert (row.batch_accuracy, row.batches) == (0.5, 2)


def test_samples(spark):
    frame = spark.range(50).select("id", F.lit("t").alias("text"), F.lit(1).alias("label"), (F.col("id") % 2).cast("int").alias("prediction"))
    rows = metrics.prediction_samples(frame, "id", "text").collect()
    assert len(rows) == 20 and rows[0].id == 0
    assert (rows[0].true_sentiment, rows[0].predicted_sentiment, rows[0].correct) == ("Positive", "Negative", False)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    vocabulary = ["satu", "dua", "tiga", "empat", "lima", "enam"]
    rows = [(i, " ".join(rng.choices(vocabulary, [9, 5, 3, 2, 1, 1], k=rng.randint(0, 12))), "PN"[i % 3 == 0]) for i in range(200)]
    return spark.createDataFrame(rows, "id long, text string, label string"), rows


@pytest.mark.parametrize("k", [2, 5])
def test_word_freq(texts, k):
    frame, rows = texts
    counts = {"P": Counter(), "N": Counter()}
    for _, t, label in rows:
        counts[label].update(t.split())
    expected = {
        (label, w, n, rank)
        for label, c in counts.items()
        for rank, (w, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k], 1)
    }
    assert {tuple(r) for r in words.word_freq(frame, k=k).select("label", "word", "n", "rank").collect()} == expected


def test_vocabulary_and_encoding(texts):
    frame, rows = texts
    vocab = words.vocabulary(frame, size=4)
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert sorted(ids.values()) == [4, 5, 6, 7] and ids["satu"] == 4
    encoded = {r.id: r for r in words.encode_fixed_length(frame, vocab, "id", max_length=8).collect()}
    assert len(encoded) == len(rows)
    for i, t, _ in rows:
        body = [2] + [ids.get(w, 1) for w in t.split()[:6]] + [3]
        assert encoded[i].input_ids == body + [0] * (8 - len(body))
        assert encoded[i].attention_mask == [1] * len(body) + [0] * (8 - len(body))
    rare = words.vocabulary(frame, min_count=10_000)
    assert rare.count() == 0


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_whole_vocabulary_and_equal_keys(spark, broadcast_rows):
    rows = [(1, "b a a", "x"), (1, "c", "y"), (2, None, "x"), (None, "a " * 9, None)]
    frame = spark.createDataFrame(rows, "id int, text string, label string")
    vocab = words.vocabulary(frame)
    assert {r.token: r.token_id for r in vocab.collect()} == {"a": 4, "b": 5, "c": 6}
    coded = words.encode_fixed_length(frame, vocab, "id", max_length=6, label="label", broadcast_rows=broadcast_rows).collect()
    assert sorted(((r.id, r.label, r.input_ids) for r in coded), key=str) == sorted(
        [(1, "x", [2, 5, 4, 4, 3, 0]), (1, "y", [2, 6, 3, 0, 0, 0]), (2, "x", [2, 3, 0, 0, 0, 0]), (None, None, [2, 4, 4, 4, 4, 3])],
        key=str,
    )


def test_runs_without_an_accuracy_do_not_win(spark):
    wide = spark.createDataFrame(
        [("m", "80/20", None, 3.0, 5.0, 5.0), ("m", "70/30", 2.0, None, 5.0, 1.0), ("n", "80/20", None, None, None, None)],
        "model string, split_ratio string, Pre double, `Tuning 1` double, `Tuning 2` double, `Tuning 3` double",
    )
    long = runs.runs_long(wide)
    best = {r.model: (r.accuracy, r.split_ratio, r.stage) for r in runs.best_run(long).collect()}
    assert best == {"m": (5.0, "70/30", "Tuning 2"), "n": (None, None, None)}
    gain = {r.model: (r.split_ratio, r.gain) for r in runs.gain_over_baseline(long).collect()}
    assert gain == {"m": ("70/30", 3.0), "n": (None, None)}


PUBLISHED = {
    "Random Forest": [(61.38, 62.38, 62.17), (70.90, 70.49, 70.30), (74.78, 74.19, 74.40), (74.05, 74.95, 75.47)],
    "SVM": [(54.76, 54.81, 54.79), (51.39, 51.58, 51.83), (63.48, 64.78, 66.46), (71.00, 71.96, 72.51)],
    "Transformer": [(81.9, 81.9, 81.9), (89.2, 89.2, 89.2), (89.43, 90.53, 89.56), (85.73, 87.73, 88.37)],
}


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (model, ratio, *[stage[i] for stage in stages])
        for model, stages in PUBLISHED.items()
        for i, ratio in enumerate(("60/40", "70/30", "80/20"))
    ]
    return runs.runs_long(spark.createDataFrame(rows, ["model", "split_ratio", *runs.STAGES]))


def test_published_results_are_reproduced(table):
    assert table.count() == 36
    best = {r.model: (r.accuracy, r.split_ratio, r.stage) for r in runs.best_run(table).collect()}
    assert best == {
        "Random Forest": (75.47, "80/20", "Tuning 3"),
        "SVM": (72.51, "80/20", "Tuning 3"),
        "Transformer": (90.53, "70/30", "Tuning 2"),
    }
    gains = {r.model: round(r.gain, 2) for r in runs.gain_over_baseline(table).collect()}
    assert gains == {"Random Forest": 13.30, "SVM": 17.72, "Transformer": 8.63}


def test_stage_gain_and_split_effect(table):
    change = {(r.split_ratio, r.stage): r.change for r in runs.stage_gain(table).filter("model = 'SVM'").collect()}
    assert change["60/40", "Pre"] is None and round(change["60/40", "Tuning 1"], 2) == -3.37
    effect = {(r.model, r.split_ratio): r for r in runs.split_effect(table).collect()}
    assert effect["Transformer", "70/30"].is_best and not effect["Transformer", "80/20"].is_best
    assert round(effect["SVM", "80/20"].mean_accuracy, 4) == round((54.79 + 51.83 + 66.46 + 72.51) / 4, 4)


def test_early_stop(spark):
    scores = {"a": [0.80, 0.85, 0.85, 0.84, 0.83, 0.90], "b": [0.0, 0.0, 0.0, 0.5], "c": [0.1, 0.2]}
    rows = [(run, e, s) for run, values in scores.items() for e, s in enumerate(values, 1)]
    traced = runs.early_stop(spark.createDataFrame(rows, "run_id string, epoch int, val_acc double"))
    stops = {r.run_id: r.epoch for r in traced.filter("stopped").collect()}
    assert stops == {"a": 5, "b": 3}
    assert traced.filter("run_id = 'a' AND logged").count() == 4
    best = {r.run_id: (r.best_epoch, r.best_score) for r in runs.best_epoch(traced.select("run_id", "epoch", "val_acc")).collect()}
    assert best == {"a": (2, 0.85), "b": (1, 0.0), "c": (2, 0.2)}
