"""Schema operators: header names, target discovery, numeric coercion, feature assembly."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.functions.columns import as_column
from voxtally.functions.numbers import to_number

# Texts read as truth values, as documented for pandas.read_csv.
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def find_target_contains(df: DataFrame, word: str = "score") -> str | None:
    """The first column whose name contains the word, in any case."""
    return next((name for name in df.columns if word.lower() in name.lower()), None)


def find_target_exact(df: DataFrame, word: str = "score") -> str | None:
    """The column named exactly so (in any case), else the first one containing the word.

    Of names that differ only by case, the last one counts.
    """
    by_lower = {name.lower(): name for name in df.columns}
    if word.lower() in by_lower:
        return by_lower[word.lower()]
    return next((name for lower, name in by_lower.items() if word.lower() in lower), None)


def rename_target(df: DataFrame, target: str, name: str = "Score") -> DataFrame:
    return df.withColumnRenamed(target, name)


def feature_columns(df: DataFrame, *excluded: str) -> list[str]:
    return [name for name in df.columns if name not in excluded]


def column_profile(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """Per column the number of values, and of those that spell a truth value; one pass for all."""
    cells = []
    for i, name in enumerate(columns):
        cells.append(F.count(quoted(name)).alias(f"v{i}"))
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        truth = F.count_if(quoted(name).isin(list(TRUE_TEXTS + FALSE_TEXTS))) if is_text else F.lit(0)
        cells.append(truth.alias(f"t{i}"))
    if not cells:
        return {}
    found = df.agg(*cells).first()
    return {name: (found[f"v{i}"], found[f"t{i}"]) for i, name in enumerate(columns)}


def drop_null_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns without any value; ``keep`` are exempt."""
    profile = column_profile(df, feature_columns(df, *keep))
    return df.drop(*[name for name, (values, _) in profile.items() if values == 0])


def truth_columns(profile: dict[str, tuple[int, int]]) -> list[str]:
    """Text columns that hold truth values only. They count as numbers, while a truth value among
    other texts does not."""
    return [name for name, (values, truths) in profile.items() if 0 < values == truths]


def _as_double(df: DataFrame, name: str, truths: list[str] = ()) -> Column:
    """The column as double: text parsed, numbers cast, NaN as NULL like any other missing value."""
    kind, column = df.schema[name].dataType, quoted(name)
    if name in truths:
        return F.when(column.isin(list(TRUE_TEXTS)), 1.0).when(column.isin(list(FALSE_TEXTS)), 0.0)
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        number = column.cast("double")
        return F.when(~F.isnan(number), number) if isinstance(kind, (T.DoubleType, T.FloatType)) else number
    return to_number(column)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as doubles; text that is no number becomes NULL."""
    return df.withColumns({name: _as_double(df, name) for name in columns})


def coerce_text_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Like :func:`coerce_numeric`, but numeric columns stay as they are."""
    texts = [
        name
        for name in columns
        if not isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))
    ]
    return coerce_numeric(df, texts) if texts else df


def pack_features(
    df: DataFrame, columns: list[str], name: str = "values", truths: list[str] = ()
) -> DataFrame:
    """The named columns, coerced, as one array of doubles in their place; ``truths`` name the
    text columns of truth values.

    Wide tables should be packed and written out before they are filtered: from a
    filter over many computed columns Catalyst derives a constraint for each combination of them.
    """
    packed = F.array(*[_as_double(df, c, truths) for c in columns])
    kept = [quoted(c) for c in df.columns if c not in columns]
    return df.select(*kept, packed.alias(name))


def complete_features(df: DataFrame, name: str = "values") -> DataFrame:
    """Rows whose packed features are all there."""
    return df.filter(F.forall(name, lambda x: x.isNotNull()))


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Features and target as two frames of the same rows.

    For looking at either alone. Work that needs both keeps them in one frame: the rows then
    stay aligned without any join.
    """
    return df.drop(target), df.select(quoted(target))


def to_vector(df: DataFrame, values: str = "values", name: str = "features") -> DataFrame:
    """Packed features as the vector Spark ML works on."""
    return df.withColumn(name, array_to_vector(F.col(values)))


def spread_array(df: DataFrame, array: str, width: int, prefix: str = "f") -> DataFrame:
    """One double column per element of a fixed-width array, in place of the array."""
    digits = len(str(width))
    cells = {
        f"{prefix}{i:0{digits}d}": F.element_at(as_column(array), i).cast("double") for i in range(1, width + 1)
    }
    return df.withColumns(cells).drop(array)
