"""CSV sources. All columns are read as text and cast later, so nothing depends on inference."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.operators.columns import find_target_contains, rename_target, trim_headers
from voxtally.sources import csv_records

SEPARATORS = (",", ";", "\t")

# Texts that count as missing in a CSV field, as documented for pandas.read_csv.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _missing_to_null(df: DataFrame) -> DataFrame:
    def value(name: str) -> Column:
        column = F.col("`" + name.replace("`", "``") + "`")
        return F.when(~column.isin(list(MISSING)), column).alias(name)

    return df.select(*[value(name) for name in df.columns])


def read_csv(
    spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8", multiline: bool = True
) -> DataFrame:
    """A CSV table with header; fields that mean "missing" become NULL.

    Quoted fields may hold line breaks. Large files are split among tasks all the same, at the price of a second
    look at their quotes, which ``multiline=False`` saves where there are no such line breaks. Only files in an
    encoding that is not based on ASCII take a task each.
    """
    if multiline and encoding.upper() in csv_records.ASCII_BASED:
        return _missing_to_null(csv_records.read_records(spark, path, sep, encoding))
    options = csv_records.parser_options(sep) | {"header": "true", "encoding": encoding, "multiLine": str(multiline)}
    return _missing_to_null(spark.read.options(**options).csv(path))


def _paths(uris) -> list[str]:
    return sorted(unquote(uri) for uri in uris)


def undecodable_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Files under the path that hold bytes which are not UTF-8.

    The text source hands the bytes of a line on unchanged, so one distributed scan tests them;
    what reaches the driver is the distinct file names.
    """
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return _paths(row[0] for row in bad.select(F.input_file_name()).distinct().collect())


def read_csv_encoded(spark: SparkSession, path: str, sep: str = ",", multiline: bool = True) -> DataFrame:
    """A CSV read as UTF-8, but every file that is not valid UTF-8 as ISO-8859-1."""
    bad = undecodable_files(spark, path)
    if not bad:
        return read_csv(spark, path, sep, "UTF-8", multiline)
    latin = read_csv(spark, bad, sep, "ISO-8859-1", multiline)
    good = sorted(set(_paths(spark.read.text(path).inputFiles())) - set(bad))
    if not good:
        return latin
    return read_csv(spark, good, sep, "UTF-8", multiline).unionByName(latin)


def read_csv_sniffed(
    spark: SparkSession,
    path: str,
    separators: tuple[str, ...] = SEPARATORS,
    target_word: str = "score",
    target_name: str = "Score",
    multiline: bool = True,
) -> DataFrame | None:
    """A CSV read with the first separator that gives two or more columns and a target column.

    Header names are trimmed and the target is renamed. None if no separator fits. As all
    columns are text, a trial reads the header line only.
    """
    for sep in separators:
        try:
            names = csv_records.header_of(spark, path, sep, "UTF-8")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise
            continue
        if len(names) >= 2 and any(target_word.lower() in name.lower() for name in names):
            frame = trim_headers(read_csv(spark, path, sep, multiline=multiline))
            return rename_target(frame, find_target_contains(frame, target_word), target_name)
    return None
