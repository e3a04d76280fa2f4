"""Random forest on a feature table, with importances."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.operators.classes import decode_labels, encode_labels, label_index
from voxtally.operators.columns import to_vector
from voxtally.operators.splits import stratified_split
from voxtally.plans.training import KEY, TARGET, TrainingRun, laid_out, prepare_forest_table

# The forest's parameters. A leaf of three rows implies the minimum of five (six)
# rows for a split.
TREES, DEPTH, MIN_LEAF, FEATURE_SHARE, TEST_FRACTION, SEED = 80, 8, 3, 0.3, 0.2, 42


def forest(n_features: int, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassifier:
    # A whole number of features: a share would be rounded up.
    per_split = max(1, int(FEATURE_SHARE * n_features))
    return RandomForestClassifier(
        featuresCol="features",
        labelCol="label_index",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=MIN_LEAF,
        featureSubsetStrategy=str(per_split),
        seed=seed,
    )


def train_forest(
    df: DataFrame,
    target: str = "Score",
    key: str = KEY,
    test_fraction: float = TEST_FRACTION,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
    parts: int | None = None,
) -> TrainingRun:
    """Clean, split by class where possible, fit, predict the test side.

    The training rows are laid out by key in ``parts`` partitions (as many as their number asks for), so that equal
    rows give an equal forest.
    """
    table = prepare_forest_table(df, target, key)
    index = label_index(table.rows, TARGET)
    coded = to_vector(encode_labels(table.rows, TARGET, index)).drop("values")
    split = stratified_split(coded, key, TARGET, test_fraction, seed)
    # The number of classes is stated, as Spark infers a hundred at most.
    classes = {"ml_attr": {"type": "nominal", "name": "label_index", "num_vals": max(2, index.count())}}
    train = laid_out(split.filter("split = 'train'"), key, parts).select(
        "features", F.col("label_index").cast("double").alias("label_index", metadata=classes)
    )
    model = Pipeline(stages=[forest(len(table.names), trees, depth, seed)]).fit(train)
    scored = model.transform(split.filter("split = 'test'")).withColumnRenamed("prediction", "prediction_index")
    decoded = decode_labels(scored, "prediction_index", index, "prediction")
    predictions = decoded.select(key, F.col(TARGET).alias("label"), "prediction", "probability")
    return TrainingRun(model, predictions, index, table.names)


def feature_importances(run: TrainingRun, k: int = 10) -> DataFrame:
    """The ``k`` most important features: ``feature, importance``."""
    importances = run.model.stages[-1].featureImportances.toArray().tolist()
    pairs = list(zip(run.names, importances))
    spark = run.predictions.sparkSession
    table = spark.createDataFrame(pairs, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(k)
