"""Searching comments by an index of trigrams, so that only rows that may match are read.

Comments are stored in blocks of a bounded number of rows, as they come, without a shuffle. The index lists, for
each trigram of the folded texts, the rows of each block that have it; lists are made block by block and dealt to
folders by trigram. A query's literal runs give trigrams that every match must hold; rows that hold all of
them are candidates, found by reading the lists of these trigrams alone. The candidates' texts are then read,
their folders and blocks only, and tested with the query itself. A query without a usable trigram is a scan.

Folding lowers A-Z and the few other letters that match them without regard to case (the long s, the Kelvin sign,
i with and without dot). Only characters whose matches are so known take part: ASCII, and letters of scripts
without case. So no match can be missed; a candidate that does not match is dropped by the test.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxtally.operators.browse import search
from voxtally.session import bounded_table, written

GRAM = 3
#: Rows of a block: 2 ** BLOCK_BITS.
BLOCK_BITS = 10
#: Folders of the comments (by writing task) and of the index (by trigram), and parts of an index folder.
ROW_FOLDERS, GRAM_FOLDERS, GRAM_PARTS = 1024, 64, 8
#: Trigrams of a query that are looked up; more would only narrow the candidates.
LOOKED_UP = 16
#: Blocks that are named to the file scan; the candidates of more are found by the join alone.
NAMED_BLOCKS = 1000
LISTS = "gram string, block long, rows array<int>"
#: Bits of Spark's increasing numbers below a task's number.
_TASK_BITS = 33
#: Letters beside A-Z that match a letter of a-z without regard to case: fixed values.
FOLDED = {"ſ": "s", "K": "k", "İ": "i", "ı": "i"}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded(text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.translate(column, _UPPER + "".join(FOLDED), _UPPER.lower() + "".join(FOLDED.values()))


def _usable(char: str) -> bool:
    return char.isascii() or unicodedata.category(char) == "Lo"


def _grams_of_run(run: str) -> set[str]:
    lower = "".join(c.lower() if c.isascii() else c for c in run)
    return {
        lower[i : i + GRAM] for i in range(len(lower) - GRAM + 1) if all(map(_usable, lower[i : i + GRAM]))
    }


def _literal_runs(branch: str) -> list[str] | None:
    """Runs of characters that a match of this part of a pattern must hold; None if the pattern is not plain enough.

    Groups and classes are passed over as a whole, and so is a character before a quantifier.
    """
    runs, run, i, depth = [], "", 0, 0
    while i < len(branch):
        char = branch[i]
        if char == "\\":
            if i + 1 >= len(branch) or branch[i + 1] in "QExuNpPkc0123456789":
                return None
            char, i = branch[i : i + 2], i + 1
        if depth:
            depth += (char == "(") - (char == ")")
            run = run if depth else ""
        elif char == "(":
            runs.append(run)
            run, depth = "", 1
        elif char == "[":
            end = re.match(r"\[\^?\]?(?:[^\]\\\[&]|\\.)*\]", branch[i:])
            if end is None:
                return None
            runs.append(run)
            run, i = "", i + end.end() - 1
        elif char in "?*+{":
            runs.append(run[:-1])
            run = ""
            if char == "{":
                i = branch.find("}", i)
                if i < 0:
                    return None
        elif len(char) == 1 and char not in ".^$)":
            run += char
        elif len(char) == 2 and not char[1].isalnum():
            run += char[1]
        else:
            runs.append(run)
            run = ""
        i += 1
    return [*runs, run] if not depth else None


def required_grams(query: str, literal: bool = False) -> list[set[str]] | None:
    """Sets of trigrams, of which a match holds at least one whole; None if no such sets follow from the query."""
    if literal:
        found = [_grams_of_run(query)]
    elif "(?" in query or "#" in query and "(?x" in query:
        return None
    else:
        branches, depth, start = [], 0, 0
        if re.search(r"\[[^\]]*[|()\[][^\]]*\]|\\[|()\[\]]", query):
            return None  # brackets or bars that do not part the pattern
        for i, char in enumerate(query):
            depth += (char == "(") - (char == ")")
            if char == "|" and not depth:
                branches.append(query[start:i])
                start = i + 1
        branches.append(query[start:])
        runs = [_literal_runs(branch) for branch in branches]
        if None in runs:
            return None
        found = [set().union(*map(_grams_of_run, of_branch)) for of_branch in runs]
    return found if all(found) else None


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, row, folded text) in runs of a block to (gram, block, rows)."""

    def told(block: int, found: dict[str, array]) -> pa.RecordBatch:
        rows = [x.tolist() for x in found.values()]
        columns = [pa.array(list(found), pa.string()), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["gram", "block", "rows"])

    at, found = None, defaultdict(lambda: array("H"))
    for batch in batches:
        for block, row, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if block != at:
                if found:
                    yield told(at, found)
                at, found = block, defaultdict(lambda: array("H"))
            for gram in {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}:
                found[gram].append(row)
    if found:
        yield told(at, found)


def _row_folder(block: Column) -> Column:
    return F.pmod(F.shiftright(block, _TASK_BITS - BLOCK_BITS), F.lit(ROW_FOLDERS)).cast("int")


def _gram_folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_FOLDERS)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """Stored comments and the index of their trigrams."""

    spark: SparkSession
    path: str
    text: str
    schema: StructType

    def stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        """All stored comments."""
        return self.stored().drop("_block", "_row", "_folder")

    def candidates(self, sets: list[set[str]]) -> DataFrame:
        """``block, row``: the rows that hold all trigrams (at most ``LOOKED_UP`` of them) of one of the sets."""
        lists = self.spark.read.schema(f"{LISTS}, _folder int").parquet(f"{self.path}/grams")
        found = None
        for grams in sets:
            wanted = sorted(grams)[:: -(-len(grams) // LOOKED_UP)]
            folder = F.array_contains(F.array(*(_gram_folder(F.lit(gram)) for gram in wanted)), F.col("_folder"))
            one = lists.filter(folder & F.col("gram").isin(wanted))
            # a block that was read in two parts has two lists
            one = one.groupBy("block", "gram").agg(F.flatten(F.collect_list("rows")).alias("rows"))
            one = one.groupBy("block").agg(F.collect_list("rows").alias("lists"))
            common = F.reduce("lists", F.col("lists")[0], lambda both, x: F.array_intersect(both, x))
            one = one.filter(F.size("lists") == len(wanted)).select("block", F.explode(common).alias("row"))
            found = one if found is None else found.unionByName(one)
        return found.distinct() if len(sets) > 1 else found

    def search(self, query: str, literal: bool = False) -> DataFrame:
        """The stored rows that match, as :func:`voxtally.operators.browse.search` finds them."""
        sets = required_grams(query, literal) if query else None
        if sets is None:
            return search(self.rows(), query, self.text, literal)
        found, stored = written(self.candidates(sets)), self.stored()
        blocks = bounded_table(found.select("block").distinct(), NAMED_BLOCKS)
        if blocks is not None:  # what is not named is not read
            named = blocks.column(0).to_pylist()
            folders = sorted({(block >> (_TASK_BITS - BLOCK_BITS)) % ROW_FOLDERS for block in named})
            stored = stored.filter(F.col("_folder").isin(folders) & F.col("_block").isin(named))
        kept = stored.join(found, (stored["_block"] == found["block"]) & (stored["_row"] == found["row"]), "left_semi")
        return search(kept.drop("_block", "_row", "_folder"), query, self.text, literal)


def build_index(df: DataFrame, path: str, text: str = "text") -> SearchIndex:
    """Store the comments and their index under ``path``, which must not exist."""
    spark, place = df.sparkSession, F.col("_place")
    numbered = df.withColumn("_place", F.monotonically_increasing_id())
    block, row = F.shiftright(place, BLOCK_BITS), place.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    rows = numbered.withColumns({"_block": block, "_row": row}).drop("_place")
    rows = rows.withColumn("_folder", _row_folder(F.col("_block")))
    rows.write.partitionBy("_folder").parquet(f"{path}/rows")
    index = SearchIndex(spark, path, text, rows.schema)
    # read back, so that lists and rows agree whatever is run again
    stored = index.stored().filter(F.col(text).isNotNull())
    lists = stored.select("_block", "_row", folded(text)).mapInArrow(_lists, LISTS)
    dealt = lists.withColumn("_folder", _gram_folder(F.col("gram"))).repartition("_folder", F.pmod("block", F.lit(GRAM_PARTS)))
    dealt.sortWithinPartitions("_folder", "gram").write.partitionBy("_folder").parquet(f"{path}/grams")
    return index
