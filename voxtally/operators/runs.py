"""Comparing training runs: stages, splits, epochs.

Run tables have a row per model, split and stage (or run and epoch); windows over them hold the
stages or epochs of one run, not data rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The stages' names.
STAGES = ("Pre", "Tuning 1", "Tuning 2", "Tuning 3")
START_ACCURACY = 0.0


def runs_long(wide: DataFrame, stages: tuple[str, ...] = STAGES, ids: tuple[str, ...] = ("model", "split_ratio")) -> DataFrame:
    """One accuracy column per stage to rows ``model, split_ratio, stage_no, stage, accuracy``."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"), F.col(f"`{s}`").cast("double").alias("accuracy"))
            for i, s in enumerate(stages)
        ]
    )
    return wide.select(*ids, F.inline(rows))


def best_run(runs: DataFrame) -> DataFrame:
    """Per model the best accuracy with its split and stage; of equals the first split and stage.

    Runs without an accuracy are passed over; a model that has no other gets NULLs.
    """
    found = F.struct("accuracy", "split_ratio", "stage_no", "stage")
    best = F.min_by(found, _best_first())
    return runs.groupBy("model").agg(best.alias("best")).select("model", "best.*")


def _best_first():
    """Order of runs, NULL for those without an accuracy."""
    return F.when(F.col("accuracy").isNotNull(), F.struct(-F.col("accuracy"), "split_ratio", "stage_no"))


def _by_stage():
    return Window.partitionBy("model", "split_ratio").orderBy("stage_no")


def with_baseline(runs: DataFrame) -> DataFrame:
    """Add the first stage's accuracy of the same model and split, and the gain over it."""
    first = F.first("accuracy").over(_by_stage())
    return runs.withColumn("baseline", first).withColumn("gain", F.col("accuracy") - F.col("baseline"))


def gain_over_baseline(runs: DataFrame) -> DataFrame:
    """Per model the best run's gain over the first stage of the same split."""
    rows = with_baseline(runs)
    found = F.struct("split_ratio", "stage", "accuracy", "baseline", "gain")
    best = F.min_by(found, _best_first())
    return rows.groupBy("model").agg(best.alias("best")).select("model", "best.*")


def stage_gain(runs: DataFrame) -> DataFrame:
    """Change of accuracy from one stage to the next; NULL at the first."""
    return runs.withColumn("change", F.col("accuracy") - F.lag("accuracy").over(_by_stage()))


def split_effect(runs: DataFrame) -> DataFrame:
    """Mean and best accuracy per model and split, and whether the split is the model's best."""
    per_split = runs.groupBy("model", "split_ratio").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.max("accuracy").alias("max_accuracy")
    )
    order = Window.partitionBy("model").orderBy(F.desc("max_accuracy"), "split_ratio")
    return per_split.withColumn("is_best", F.row_number().over(order) == 1)


def early_stop(history: DataFrame, patience: int = 3, run: str = "run_id", score: str = "val_acc") -> DataFrame:
    """Trace of early stopping over the epochs of each run.

    An epoch improves if it beats all before it (and the start value 0). ``waited`` counts the
    epochs since the last improvement; training stops at the first epoch where it reaches
    ``patience``. That epoch is not ``logged``, and none after it happen.
    """
    ordered = Window.partitionBy(run).orderBy("epoch")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    traced = (
        history.withColumn("step", F.row_number().over(ordered))
        .withColumn("best_before", F.coalesce(F.max(score).over(earlier), F.lit(START_ACCURACY)))
        .withColumn("best_before", F.greatest("best_before", F.lit(START_ACCURACY)))
        .withColumn("improved", F.coalesce(F.col(score) > F.col("best_before"), F.lit(False)))
    )
    last = F.coalesce(F.max(F.when(F.col("improved"), F.col("step"))).over(upto), F.lit(0))
    waited = traced.withColumn("waited", F.col("step") - last)
    reached = F.when(F.col("waited") >= patience, F.col("step"))
    stop = F.min(reached).over(Window.partitionBy(run))
    return (
        waited.withColumn("stop_step", stop)
        .withColumn("stopped", F.coalesce(F.col("step") == F.col("stop_step"), F.lit(False)))
        .withColumn("logged", F.coalesce(F.col("step") < F.col("stop_step"), F.lit(True)))
    )


def best_epoch(history: DataFrame, patience: int | None = 3, run: str = "run_id", score: str = "val_acc") -> DataFrame:
    """Per run the best epoch (the earliest of equals) and its score, as far as training went."""
    rows = history if patience is None else early_stop(history, patience, run, score).filter("logged")
    best = F.max_by("epoch", F.struct(score, -F.col("epoch")))
    return rows.groupBy(run).agg(best.alias("best_epoch"), F.max(score).alias("best_score"))
