from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from voxtally.operators.splits import stratified_folds
from voxtally.plans import forest, kernel_svm, machines, text_classifier
from voxtally.plans.training import prepare_forest_table, prepare_svm_table
from voxtally.sinks.results import save_model
from voxtally.sources.csv import read_csv_sniffed


@pytest.fixture(scope="module")
def rings(spark):
    """Two classes apart in radius only: no line separates them."""
    rng = np.random.default_rng(1)
    angle, inner = rng.uniform(0, 2 * np.pi, 600), np.arange(600) % 2
    radius = np.where(inner, 1.0, 3.0) + rng.normal(0, 0.2, 600)
    rows = [
        (i, str(radius[i] * np.cos(angle[i])), str(radius[i] * np.sin(angle[i])), None, "in" if inner[i] else "out")
        for i in range(600)
    ]
    return spark.createDataFrame(rows, "row_id long, x string, y string, empty string, Score string")


def test_forest_table(spark, rings):
    table = prepare_forest_table(rings, "Score")
    assert table.names == ["x", "y"] and table.rows.count() == 600
    with pytest.raises(ValueError, match="empty"):
        prepare_forest_table(rings.withColumn("note", F.lit("word")), "Score")


def test_from_csv_with_odd_headers(spark, tmp_path):
    lines = ["  f.1 ;on;empty; My.Score (1-2)"]
    lines += [f"{i % 10 + (i % 2) * 20};{'True' if i % 4 else 'False'};;{1 + i % 2}" for i in range(60)]
    (tmp_path / "f.csv").write_text("\n".join(lines + ["oops;True;;1", "3;True;;"]) + "\n")
    frame = read_csv_sniffed(spark, str(tmp_path / "f.csv"))
    table = prepare_forest_table(frame, "Score")
    assert table.names == ["f.1", "on"] and table.rows.count() == 60
    assert {r.target for r in table.rows.collect()} == {1, 2}
    run = forest.train_forest(frame, trees=5, depth=3)
    assert run.accuracy().first()[0] == 1.0 and run.predictions.count() == 12
    renamed = frame.withColumnRenamed("Score", "My.Score").drop("empty")
    svm = kernel_svm.train_kernel_svm(renamed, "My.Score", gamma=0.5, dimension=64, iterations=20)
    assert svm.predictions.count() == 24 and svm.accuracy().first()[0] > 0.9


def test_svm_table_needs_every_column(rings):
    with pytest.raises(ValueError, match="empty"):
        prepare_svm_table(rings, "Score")
    gaps = rings.drop("empty").withColumn("x", F.when(F.col("row_id") > 9, F.col("x")))
    assert prepare_svm_table(gaps, "Score").rows.count() == 590


def test_forest(rings):
    run = forest.train_forest(rings, trees=15, depth=5)
    rows = run.predictions.orderBy("row_id").collect()
    assert len(rows) == 120 and sum(r.label == r.prediction for r in rows) > 110
    importances = forest.feature_importances(run).collect()
    assert {r.feature for r in importances} == {"x", "y"} and abs(sum(r.importance for r in importances) - 1) < 1e-9
    again = forest.train_forest(rings, trees=15, depth=5).predictions.orderBy("row_id").collect()
    assert [r.prediction for r in again] == [r.prediction for r in rows]
    assert run.report().filter("class = 'accuracy'").count() == 1


def test_kernel_error_falls_with_the_dimension(spark):
    rng = np.random.default_rng(2)
    x, gamma = rng.normal(size=(40, 5)), 0.1
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, values array<double>")
    exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    errors = []
    for size in (32, 256, 4096):
        features = kernel_svm.FourierFeatures(inputCol="values", gamma=gamma, dimension=size)
        mapped = np.array([r.features.toArray() for r in features.transform(frame).orderBy("i").collect()])
        errors.append(np.abs(mapped @ mapped.T - exact).mean())
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.02


def test_forest_does_not_depend_on_layout(rings):
    fits = [forest.train_forest(df, trees=8, depth=4).predictions for df in (rings.coalesce(1), rings.repartition(7))]
    first, second = ([(r.row_id, r.prediction) for r in p.orderBy("row_id").collect()] for p in fits)
    assert first == second


def test_forest_with_many_classes(spark):
    rows = spark.range(900).selectExpr("id AS row_id", "CAST(id % 150 AS STRING) AS x", "CAST(id % 150 AS STRING) AS Score")
    run = forest.train_forest(rows, trees=3, depth=8)
    assert run.predictions.count() == 150 + 30 and run.labels.count() == 150


def test_kernel_svm_separates_rings_and_is_saved(spark, rings, tmp_path):
    data = kernel_svm.prepare(rings.drop("empty"), "Score")
    run = kernel_svm.fit(data, C=100.0, gamma=1.0, dimension=128, iterations=30)
    assert run.predictions.count() == 240
    assert run.accuracy().first()[0] > 0.95
    save_model(run.model, str(tmp_path / "svm"))
    test = data.rows.filter("split = 'test'")
    loaded = PipelineModel.load(str(tmp_path / "svm")).transform(test).select("row_id", "prediction")
    assert loaded.exceptAll(run.model.transform(test).select("row_id", "prediction")).count() == 0
    table = kernel_svm.grid_search(data, {"C": [100.0], "gamma": [1e-6, 1.0]}, dimension=64, iterations=10).collect()
    assert table[0].deviation >= 0 and len(table) == 2 and table[1].accuracy > table[0].accuracy
    assert [r.chosen for r in table] == [False, True] and table[0].test_accuracy is None and table[1].test_accuracy > 0.9


def test_parameters_are_chosen_without_the_test_side(rings):
    data = kernel_svm.prepare(rings.drop("empty"), "Score")
    spoiled = data.rows.withColumn("label_index", F.when(F.col("split") == "test", 1 - F.col("label_index")).otherwise(F.col("label_index")))
    grid = {"C": [100.0], "gamma": [1e-6, 1.0]}
    tables = [kernel_svm.grid_search(d, grid, dimension=64, iterations=10).collect() for d in (data, replace(data, rows=spoiled))]
    assert [[r[:4] for r in t] for t in tables][0] == [[r[:4] for r in t] for t in tables][1]


def test_folds_are_predicted_by_fits_on_the_others(rings):
    """Against fits on folds cut out by hand."""
    data = kernel_svm.prepare(rings.drop("empty"), "Score")
    options = {"dimension": 32, "iterations": 8}
    got = kernel_svm.fold_accuracies(data, [1.0, 100.0], 0.5, folds=3, **options)
    train = stratified_folds(data.rows.filter("split = 'train'"), data.key, "target", 3, kernel_svm.SEED + 1)
    for fold in range(3):
        split = F.when(F.col("fold") == fold, "test").otherwise("train")
        by_hand = replace(data, rows=train.withColumn("split", split).drop("fold"))
        for i, C in enumerate((1.0, 100.0)):
            want = kernel_svm.fit(by_hand, C=C, gamma=0.5, **options).accuracy().first()[0]
            assert abs(got[i][fold] - want) < 1e-9


def test_machines_fitted_together_are_those_of_spark(spark, tmp_path):
    """Classes of equal size: their weights are whole numbers, so that no step hangs on rounding."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(480, 6)) * rng.uniform(0.3, 3.0, 6) + 1.0
    x[:, 4] = 0.7
    label = np.argsort(np.argsort(x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=480))) * 3 // 480
    data = [(int(k), i % 2, row.tolist()) for i, (k, row) in enumerate(zip(label, x))]
    frame = spark.createDataFrame(data, "label_index int, fold int, f array<double>").repartition(3).withColumn("features", array_to_vector("f"))
    rows = machines.Rows(frame.cache())
    ours = machines.fit(rows, [t for C in (10.0, 100.0) for t in machines.tasks_of(3, C)], 3, 0, 20)
    for C, mine in ((10.0, ours[:3]), (100.0, ours[3:])):
        options = {"regParam": 1 / (C * 480), "maxIter": 20, "standardization": False, "labelCol": "label_index"}
        theirs = OneVsRest(classifier=LinearSVC(**options), labelCol="label_index").fit(frame)
        for got, want in zip(mine, theirs.models):
            assert np.allclose([*got.coefficients, got.intercept], [*want.coefficients, want.intercept], atol=1e-7)
        save_model(PipelineModel(stages=[machines.LinearMachines.by(mine)]), str(tmp_path / f"c{C}"))
        said = PipelineModel.load(str(tmp_path / f"c{C}")).transform(theirs.transform(frame).withColumnRenamed("prediction", "theirs"))
        assert said.filter("prediction = theirs").count() == 480


def test_search_needs_few_jobs(spark, rings):
    """All machines of a search share each pass: their number of jobs does not multiply that of the steps."""
    data = kernel_svm.prepare(rings.drop("empty"), "Score")
    seen = []
    for values in ([1.0], [0.1, 1.0, 10.0, 100.0]):
        passes, total = [0], machines.Rows.total

        def counted(self, sums, size, passes=passes, total=total):
            passes[0] += 1
            return total(self, sums, size)

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(machines.Rows, "total", counted)
            kernel_svm.fold_accuracies(data, values, 0.5, folds=3, dimension=16, iterations=4)
        seen.append(passes[0])
    # a step has at most 19 trial points, whatever the number of machines
    assert all(count <= 4 * machines.TRIALS + 3 for count in seen)


def test_sums_of_many_tasks_are_merged(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = [(int(i % 2), rng.normal(size=3).tolist()) for i in range(60)]
    frame = spark.createDataFrame(data, "label_index int, f array<double>").repartition(5).withColumn("features", array_to_vector("f"))
    rows = machines.Rows(frame)
    assert rows.parts == 5
    one = rows.moments(2, 0)
    monkeypatch.setattr(machines, "MERGERS", 2)
    assert np.allclose(rows.moments(2, 0), one) and one[0, :, 0].tolist() == [30.0, 30.0]


def test_three_classes(spark, rings):
    third = rings.drop("empty").withColumn("Score", F.when(F.col("row_id") % 3 == 0, "far").otherwise(F.col("Score")))
    moved = third.withColumn("x", F.when(F.col("Score") == "far", "9.0").otherwise(F.col("x")))
    run = kernel_svm.train_kernel_svm(moved, "Score", gamma=0.5, dimension=64, iterations=20)
    assert run.accuracy().first()[0] > 0.9


@pytest.fixture(scope="module")
def opinions(spark):
    words = {"Positive": "baik bagus good", "negative": "buruk jelek bad"}
    rows = [(i, f"{words['Positive' if i % 3 else 'negative'].split()[i % 2]} filem nombor {i % 7}", "Positive" if i % 3 else "negative") for i in range(300)]
    return spark.createDataFrame(rows, "id long, ENGLISH string, Sentiment string")


def test_text_classifier(spark, opinions, tmp_path):
    run = text_classifier.train_text_classifier(opinions, features=1 << 12, iterations=20)
    rows = run.predict().collect()
    assert len(rows) == 30 and all(r.label == r.prediction for r in rows)
    losses = [r.train_loss for r in run.history().orderBy("epoch").collect()]
    assert losses[-1] < losses[0]
    save_model(run.model, str(tmp_path / "text"))
    fresh = spark.createDataFrame([(1, "filem bagus"), (2, "filem jelek")], "id long, ENGLISH string")
    answered = text_classifier.classify(fresh, PipelineModel.load(str(tmp_path / "text")))
    assert answered.columns == ["id", "ENGLISH", "model_sentiment"]
    assert {r.id: r.model_sentiment for r in answered.collect()} == {1: "Positive", 2: "Negative"}


def test_words_are_counted_once_for_a_fit(opinions, monkeypatch):
    """Rarity, the features' scale and the optimizer read written counts, not texts."""
    kept, keep = [], text_classifier.written
    monkeypatch.setattr(text_classifier, "written", lambda df: kept.append(keep(df)) or kept[-1])
    seen, fit = [], text_classifier.LogisticRegression.fit
    monkeypatch.setattr(text_classifier.LogisticRegression, "fit", lambda self, df: seen.append(df) or fit(self, df))
    text_classifier.train_text_classifier(opinions, features=1 << 8, iterations=2)
    assert kept[-1].columns == ["counts", "label", "weight"] and "ENGLISH" not in seen[0].columns
    assert sorted(seen[0].inputFiles()) == sorted(kept[-1].inputFiles())


def test_outside_model_by_batches(spark):
    def load():
        def predict(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("boom")
            return np.array([[0.0, 1.0] if "good" in t else [1.0, 0.0] for t in texts])

        return predict

    frame = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id int, text string").coalesce(1)
    got = frame.select("id", text_classifier.model_sentiment("text", load).alias("s")).collect()
    assert {r.id: r.s for r in got} == {1: "Positive", 2: "Negative", 3: "Negative"}
    broken = spark.createDataFrame([("boom",)], "text string")
    assert broken.select(text_classifier.model_sentiment("text", load)).first()[0] is None
    with pytest.raises(Exception, match="boom"):
        broken.select(text_classifier.model_sentiment("text", load, strict=True)).collect()
