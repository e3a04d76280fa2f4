import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from voxtally.llm import circulant_minhash, line_rules
from voxtally.llm.common import read_table, written
from voxtally.llm.queries import QUERIES


def test_stages_in_order_keep_the_columns(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_dedup", "decontaminate", "encode"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir))
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        if name == "quality_rules":
            judged = line_rules.apply_rules(docs, clean_text=True).filter("kept")
            want = docs.drop("text", "n_chars").join(judged.select("doc_id", F.col("clean_text").alias("text")), "doc_id")
            want = want.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
            assert want.exceptAll(kept).isEmpty() and want.count() == kept.count()
            assert not kept.exceptAll(docs).isEmpty()
        else:
            assert kept.exceptAll(docs).isEmpty(), name
        if name == "near_dedup":
            sets = {r.doc_id: circulant_minhash.exact_set(r.text) for r in kept.collect()}
            gone = [circulant_minhash.exact_set(r.text) for r in docs.join(kept, "doc_id", "left_anti").collect()]
            near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b) > 0
            ids = sorted(sets)
            assert not any(near(sets[a], sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :])
            assert all(any(near(x, y) for y in sets.values()) for x in gone)
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_input(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_queries_are_registered():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES}
    assert numbers == set(range(1, 14))


def test_the_rest_works_without_this_folder(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/voxtally", tmp_path / "voxtally", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = (
        "import __spark_entry__ as e; "
        "assert 'pipeline' not in e.queries() and not [q for q in e.queries() if q.startswith('op')]; "
        "assert 'monthly_trend' in e.queries() and not [q for q in e.oracle_sql() if q.startswith('op')]"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""})


def test_errors_inside_are_not_swallowed(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/voxtally", tmp_path / "voxtally", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    (tmp_path / "voxtally/llm/queries.py").write_text("import no_such_package\n")
    run = [sys.executable, "-c", "import __spark_entry__"]
    found = subprocess.run(run, cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert found.returncode and "no_such_package" in found.stderr
