"""Word statistics and fixed-length encoding."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from voxtally.functions.lexicon import DEFAULT_LEXICON, Lexicon
from voxtally.functions.scoring import matched_terms
from voxtally.functions.text import tokens
from voxtally.operators.ranking import global_row_number, top_per_group
from voxtally.session import bounded_table

# Ids of the special tokens; vocabulary ids follow them.
PAD, UNKNOWN, START, END = 0, 1, 2, 3
FIRST_ID = 4
MAX_LENGTH = 256  # fixed value
# Rows of a vocabulary that every task may hold.
VOCABULARY_ROWS = 500_000


def word_freq(df: DataFrame, text: str = "text", label: str = "label", k: int = 20) -> DataFrame:
    """The ``k`` most frequent words of each label: ``label, word, n, rank``.

    Counting is combined before the shuffle, so frequent words cost no more than rare ones, and
    ranks are taken on the counted words only.
    """
    counts = (
        df.select(F.col(label).alias("label"), F.explode(tokens(text)).alias("word"))
        .groupBy("label", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per_group(counts, "label", [F.desc("n"), F.asc("word")], k, spread_by="word")


def lexicon_usage(df: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """``term, polarity, weight, n_texts``: in how many texts each lexicon term occurs.

    The counts have a row per lexicon term at most, so they are broadcast.
    """
    used = (
        df.select(F.explode(matched_terms(text, lexicon)).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n_texts"))
    )
    terms = lexicon.to_frame(df.sparkSession).filter("kind = 'term'").drop("kind")
    return (
        terms.join(F.broadcast(used), "term", "left")
        .withColumn("n_texts", F.coalesce("n_texts", F.lit(0)))
        .select("term", "polarity", "weight", "n_texts")
    )


def vocabulary(df: DataFrame, text: str = "text", size: int | None = None, min_count: int = 1) -> DataFrame:
    """``token, n, token_id`` of all tokens, the most frequent ones first; with ``size`` only of so many.

    All tokens are numbered by the distributed sort, a top-k in its one task.
    """
    counts = (
        df.select(F.explode(tokens(text)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )
    order = [F.desc("n"), F.asc("token")]
    if size is None:
        numbered = global_row_number(counts, order, "_number")
        return numbered.select("token", "n", (F.col("_number") + (FIRST_ID - 1)).cast("int").alias("token_id"))
    top = counts.orderBy(*order).limit(size)
    return top.withColumn("token_id", F.row_number().over(Window.orderBy(*order)) + (FIRST_ID - 1))


def encode_fixed_length(
    df: DataFrame,
    vocab: DataFrame,
    key: str,
    text: str = "text",
    max_length: int = MAX_LENGTH,
    label: str | None = None,
    broadcast_rows: int = VOCABULARY_ROWS,
) -> DataFrame:
    """``key, input_ids, attention_mask`` of exactly ``max_length`` ids per row, and the label's column if named.

    A text is start token, its token ids, end token, padding; tokens beyond the length are cut. A vocabulary
    within the bound goes to all tasks, and no row is shuffled: its tokens are looked up in Arrow batches. A
    larger one is joined token by token, and a row is put together by a number of its own. Rows that share a
    key stay apart either way.
    """
    body = F.slice(tokens(text), 1, max_length - 2).alias("body")
    names = [key, label] if label else [key]
    rows = df.select(*(F.col(name) for name in names), body)
    table = bounded_table(vocab.select("token", F.col("token_id").cast("int").alias("token_id")), broadcast_rows)
    coded = _joined_ids(rows, vocab, names) if table is None else _looked_up_ids(rows, table)
    filled = F.concat(F.array(F.lit(START)), F.col("ids"), F.array(F.lit(END)))
    padding = F.array_repeat(F.lit(PAD), F.lit(max_length) - F.size("filled"))
    ones = F.array_repeat(F.lit(1), F.size("filled"))
    return (
        coded.withColumn("filled", filled)
        .withColumn("padding", padding)
        .select(
            *names,
            F.concat("filled", "padding").alias("input_ids"),
            F.concat(ones, F.col("padding")).alias("attention_mask"),
        )
    )


def _looked_up_ids(rows: DataFrame, table: pa.Table) -> DataFrame:
    """``body`` replaced by ``ids``, looked up in a vocabulary that every task holds."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    unknown = UNKNOWN

    def look_up(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known, ids = (shared.value.column(i).combine_chunks() for i in range(2))
        for batch in batches:
            body = batch.column(batch.num_columns - 1)
            found = ids.take(pc.index_in(body.flatten(), value_set=known))
            offsets = pa.array([0, *pc.cumulative_sum(pc.list_value_length(body)).to_pylist()], pa.int32())
            coded = pa.ListArray.from_arrays(offsets, pc.fill_null(found, unknown))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], coded], [*batch.schema.names[:-1], "ids"])

    schema = StructType([*rows.schema.fields[:-1], StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(look_up, schema)


def _joined_ids(rows: DataFrame, vocab: DataFrame, names: list[str]) -> DataFrame:
    """The same for a vocabulary of any size."""
    exploded = rows.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", *names, F.posexplode_outer("body").alias("pos", "token")
    )
    known = exploded.join(vocab.select("token", "token_id"), "token", "left").select(
        "_row",
        *names,
        F.when(
            F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN)).cast("int").alias("token_id"))
        ).alias("item"),
    )
    first = [F.first(name).alias(name) for name in names]
    rebuilt = known.groupBy("_row").agg(*first, F.array_sort(F.collect_list("item")).alias("items"))
    return rebuilt.withColumn("ids", F.transform("items", lambda x: x["token_id"]))
