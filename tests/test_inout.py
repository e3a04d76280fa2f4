import glob
import json
from datetime import date, datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from voxtally.operators import browse, metrics
from voxtally.sinks import results
from voxtally.sources import comments, csv
from voxtally.streaming.scoring import append_log_stream, score_stream


def write(path, data, encoding="utf-8"):
    path.write_bytes(data.encode(encoding))
    return str(path)


def test_utf8_and_latin1(spark, tmp_path):
    good = write(tmp_path / "good.csv", "ENGLISH,Sentiment\ncafé,Positive\n")
    bad = write(tmp_path / "bad file.csv", "ENGLISH,Sentiment\ncafé,Negative\n", "latin-1")
    assert csv.undecodable_files(spark, good) == []
    assert csv.read_csv_encoded(spark, good).first().ENGLISH == "café"
    assert csv.read_csv_encoded(spark, bad).first().ENGLISH == "café"
    both = csv.read_csv_encoded(spark, str(tmp_path))
    assert sorted(tuple(r) for r in both.collect()) == [("café", "Negative"), ("café", "Positive")]


def test_a_written_replacement_character_is_valid(spark, tmp_path):
    path = write(tmp_path / "x.csv", "a,b\n� é,1\n")
    assert csv.read_csv_encoded(spark, path).first().a == "� é"


def test_missing_file(spark):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        csv.read_csv(spark, "/nowhere/x.csv").count()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        csv.read_csv_sniffed(spark, "/nowhere/x.csv")


def test_quotes_line_breaks_and_missing_values(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b\n"say ""hi"", ok\nnext",NA\nx,\n')
    rows = [tuple(r) for r in csv.read_csv(spark, path).collect()]
    assert rows == [('say "hi", ok\nnext', None), ("x", None)]


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_sniffing(spark, tmp_path, sep):
    path = write(tmp_path / "f.csv", sep.join([" f1 ", "f2", " Final Score"]) + "\n" + sep.join(["1", "2", "A"]) + "\n")
    frame = csv.read_csv_sniffed(spark, path)
    assert frame.columns == ["f1", "f2", "Score"] and tuple(frame.first()) == ("1", "2", "A")


def test_sniffing_without_target(spark, tmp_path):
    assert csv.read_csv_sniffed(spark, write(tmp_path / "f.csv", "a,b\n1,2\n")) is None


def test_load_comments(spark, tmp_path):
    path = write(tmp_path / "c.csv", "createTimeISO,label,text\n2024-01-01 00:00:00,Positive,ok\n")
    frame = comments.load_comments(spark, (str(tmp_path / "none.parquet"), path))
    assert frame.first().text == "ok" and "comment_id" in frame.columns
    with pytest.raises(FileNotFoundError):
        comments.load_comments(spark, (str(tmp_path / "none.parquet"),))
    assert comments.load_comments(spark, (str(tmp_path / "none.csv"),), sample_if_missing=True).count() == 362
    with pytest.raises(ValueError, match="CSV or Parquet"):
        comments.load_comments(spark, ("x.xlsx",))


def test_samples(spark):
    rows = comments.sample_comments(spark).orderBy("comment_id").collect()
    assert len(rows) == 362 and rows[0].createTimeISO == datetime(2024, 1, 1) and rows[-1].createTimeISO == datetime(2024, 12, 27)
    assert rows[5].text == "Sample comment 5"
    share = sum(r.label == "Positive" for r in rows) / 362
    assert 0.57 < share < 0.77
    assert comments.sample_comments(spark, date(2024, 1, 1), date(2024, 1, 3)).count() == 3


def test_history_results_samples_report(spark, tmp_path):
    history = spark.createDataFrame([("r", 1, 0.5)], "run_id string, epoch int, val_acc double")
    results.write_history_csv(history, str(tmp_path / "history"))
    (part,) = glob.glob(str(tmp_path / "history/*.csv"))
    assert open(part).read() == "run_id,epoch,val_acc\nr,1,0.5\n"

    rows = [(i, f"text {i}", i % 2, int(i % 3 == 0)) for i in range(40)]
    predictions = spark.createDataFrame(rows, "id long, text string, label int, prediction int")
    results.write_test_results(predictions, str(tmp_path / "out"), best_validation_accuracy=0.9, config={"epochs": 3})
    (part,) = glob.glob(str(tmp_path / "out/metrics/*.json"))
    written = json.loads(open(part).read())
    assert abs(written["accuracy"] - sum(r[2] == r[3] for r in rows) / 40) < 1e-12
    assert [c["n"] for c in written["confusion_matrix"]] == [13, 7, 13, 7]
    assert written["best_validation_accuracy"] == 0.9 and json.loads(written["config"]) == {"epochs": 3}
    assert spark.read.parquet(str(tmp_path / "out/predictions")).count() == 40

    results.write_prediction_samples(predictions, str(tmp_path / "samples"), "id", "text")
    assert spark.read.json(str(tmp_path / "samples")).count() == 20

    split = predictions.select(F.lit("train").alias("split")).groupBy("split").count()
    results.write_report(
        str(tmp_path / "report"),
        {"results": metrics.weighted_prf(predictions), "cells": metrics.confusion_cells(predictions)},
        {"split": split},
        {"epochs": 3},
    )
    report = {(r.section, r.key): r.value for r in spark.read.option("header", True).csv(str(tmp_path / "report")).collect()}
    assert report["split", "train"] == "40" and report["cells", "tn"] == "13" and report["settings", "epochs"] == "3"


def test_log_is_appended(spark, tmp_path):
    frame = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), "a" * 90, "Positive", "Model")],
        "comment_id long, createTimeISO timestamp_ntz, text string, sentiment string, model string",
    )
    for _ in range(2):
        results.append_log(browse.analysis_log(frame), str(tmp_path / "log"))
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(rows) == 2 and rows[0].text == "a" * 80 + "..." and rows[0].model == "Model"


def test_a_stream_is_scored_like_a_table(spark, tmp_path):
    rows = [(i, f"2024-01-0{i} 10:00:00", t) for i, t in enumerate(["terima kasih", "gagal total", "happy " * 30], 1)]
    schema = "comment_id long, createTimeISO string, text string"
    spark.createDataFrame(rows[:2], schema).write.parquet(str(tmp_path / "in"))
    for more in (None, rows[2:]):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = append_log_stream(score_stream(stream), str(tmp_path / "log"), str(tmp_path / "ckpt"), available_now=True)
        assert query.awaitTermination(60)
    got = {r.comment_id: r for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert [got[i].sentiment for i in (1, 2, 3)] == ["Positive", "Negative", "Positive"]
    assert len(got) == 3 and got[3].text.endswith("...") and got[1].ts == datetime(2024, 1, 1, 10)
