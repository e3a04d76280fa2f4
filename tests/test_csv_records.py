"""Large CSV files in several tasks, against Spark's reader of whole files and Python's."""

import csv as python_csv
import random

import pytest
from pyspark.sql import functions as F

from voxtally.sources import csv, csv_records


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of some bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}

    def use(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)

    yield use
    for name, value in before.items():
        spark.conf.set(name, value)


def random_table(rng, sep):
    parts = ["", "a", "b c", '"', '""', sep, "\n", "\n\n", f'{sep}"', f'"{sep}', "é漢", " ", "x\ny", "\t", "'"]
    cell = lambda: "".join(rng.choice(parts) for _ in range(rng.choice((0, 1, 1, 2, 3, 9))))
    return [[f"r{i}", cell(), cell(), cell() + "."] for i in range(rng.randint(1, 60))]


def write(path, rows, sep, line_break, rng):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = python_csv.writer(out, delimiter=sep, lineterminator=line_break)
        for row in [["key", "one", 'the "2nd"', "last"], *rows]:
            writer.writerow(row)
            if rng.random() < 0.1:
                out.write(line_break)  # a blank line


def one_task(spark, path, sep):
    options = {"header": True, "sep": sep, "multiLine": True, "escape": '"', "quote": '"'}
    return sorted(map(str, spark.read.options(**options).csv(path).collect()))


@pytest.mark.parametrize("seed", range(8))
def test_ranges_of_any_size_equal_one_task(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    sep, line_break = rng.choice(",;\t"), rng.choice(("\n", "\r\n"))
    rows = random_table(rng, sep)
    path = str(tmp_path / "a file.csv")
    write(path, rows, sep, line_break, rng)
    want = one_task(spark, path, sep)
    assert len(want) == len(rows)
    for size in (7, 50, 10_000):
        small_ranges(size)
        got = csv_records.read_records(spark, path, sep)
        assert sorted(map(str, got.collect())) == want
        assert got.columns == ["key", "one", 'the "2nd"', "last"]


def test_one_file_is_read_in_several_tasks(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    rows = [[str(i), "line\n" * rng.randint(0, 5) + "end", f'say "{i}"'] for i in range(3000)]
    write(str(tmp_path / "large.csv"), [[*row, "x"] for row in rows], ",", "\n", rng)
    small_ranges(8_000)
    got = csv.read_csv(spark, str(tmp_path / "large.csv"))
    assert len({r[0] for r in got.select(F.spark_partition_id()).collect()}) > 5
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == sorted(map(tuple, rows))


def test_order_header_and_several_files(spark, tmp_path, small_ranges):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text('\n\r\n"k\n1",v\n' + "".join(f'{name}{i},"x\n{i}"\n' for i in range(30)))
    small_ranges(20)
    found = csv_records.records(spark, str(tmp_path)).orderBy("path", "start", "place").collect()
    assert [r.record for r in found if r.path.endswith("a.csv")] == ['"k\n1",v', *(f'a.csv{i},"x\n{i}"' for i in range(30))]
    assert sum(r.header for r in found) == 2
    assert csv_records.read_records(spark, str(tmp_path)).count() == 60


@pytest.mark.parametrize(
    "text",
    ['a,b\n"x" y,1\n2,3\n', 'a,b\nx "q\n",1\n', 'a,b\n"open,1\n2,3\n', 'a,b\n"x"  ,1\n"",2\n', "a,b\n1\n1,2,3\n", "﻿a,b\n1,2\n"],
)
def test_odd_quoting_is_read_as_spark_does(spark, tmp_path, small_ranges, text):
    (tmp_path / "x.csv").write_text(text)
    # the line break that ends a file is no part of a field, even if the field's quote is never closed
    closed = lambda rows: [row.replace("\\n'", "'") for row in rows]
    want = closed(one_task(spark, str(tmp_path / "x.csv"), ","))
    for size in (5, 1000):
        small_ranges(size)
        got = csv_records.read_records(spark, str(tmp_path / "x.csv")).collect()
        assert closed(sorted(map(str, got))) == want


def test_latin_1_and_bad_bytes(spark, tmp_path, small_ranges):
    (tmp_path / "l.csv").write_bytes('a,b\n"caf\né",ü\n'.encode("latin-1"))
    small_ranges(6)
    assert tuple(csv.read_csv_encoded(spark, str(tmp_path / "l.csv")).first()) == ("caf\né", "ü")
    assert csv.read_csv(spark, str(tmp_path / "l.csv")).first()[0] == "caf\n�"


def test_states():
    for line, outside, inside in [
        ("a,b", 0, 1), ('"a', 1, 0), ('a"', 0, 0), ('a,"b', 1, 0), ('"a""', 1, 0), ('"a"","b"', 0, 0), ('",', 1, 0),
        ('","', 0, 1), ('"","', 1, 0), ('x",y', 0, 0), ('x","y', 1, 1), ('x"",y', 0, 1),
    ]:
        assert (csv_records.state_after(line, 0, ","), csv_records.state_after(line, 1, ",")) == (outside, inside), line
