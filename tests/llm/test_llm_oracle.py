import math

import duckdb
import pytest

from test_rules_and_seeds import CLEAN
from voxtally.llm import line_rules, oracle, queries

TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")


@pytest.mark.parametrize("name", sorted(oracle.STATEMENTS))
def test_query_equals_its_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    want = connection.sql(oracle.STATEMENTS[name])
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    rows = [tuple(r[i] for i in order) for r in want.fetchall()]
    plain = lambda r: tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r)
    assert sorted(map(plain, df.collect()), key=str) == sorted(map(plain, rows), key=str)


def test_line_rules_equal_their_sql_on_other_scripts(documents):
    """Clean texts, headings and symbols of many scripts, alone and mixed."""
    lines = [line for text in CLEAN.values() for line in (text, text.rstrip("।؟۔።။"), text + " ★★★★ ☃")]
    lines += ["यह एक शीर्षक है", "هذا عنوان بلا علامة", "วันนี้ ☃☃☃☃ ★★★★", "ก only latin words here", "मेनू ★★★★ है।", "a\u00a0b\u3000c.", "naïve café — yes…"]
    rows = [(i, "\n".join(lines[k % len(lines)] for k in range(i, i + 1 + i % 4))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "words of plain text " * 30)]
    df = documents(rows, extra=False)
    connection = duckdb.connect()
    connection.register("documents", df.toPandas())
    want = connection.sql(oracle.STATEMENTS["op5_line_rules"])
    got = line_rules.apply_rules(df)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
