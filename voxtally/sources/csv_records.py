"""Large CSV files with quoted line breaks, read in several tasks.

Spark cuts files into ranges of lines. Whether a range begins inside a quoted field depends on all before it in
its file. A line, and so a range, is a map of two states (outside or inside a quoted field) to two states, and such maps
are composed in any grouping. So one pass maps each range by itself, with both states tried; the maps of a
file's ranges, a row each, are then composed in order, which tells every range the state it begins in. The
second pass joins lines to records inside each range. Only what a record has in other ranges than its first is
sent on, and put together by file and place. Spark's own CSV parser takes the records apart.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Encodings in which a line feed, a quote and a separator are the bytes they are in ASCII.
ASCII_BASED = ("UTF-8", "ISO-8859-1", "US-ASCII", "WINDOWS-1252")
OUTSIDE, INSIDE = 0, 1
QUOTE = '"'


def state_after(line: str, state: int, sep: str) -> int:
    """The state after a line and its line break.

    A field is quoted if a quote is its first character; doubled quotes are part of it. What follows
    the closing quote up to the next separator belongs to the field and holds no quoting.
    """
    at, size = 0, len(line)
    opening = sep + QUOTE
    if state == OUTSIDE and not line.startswith(QUOTE):
        at = line.find(opening)
        if at < 0:
            return OUTSIDE
        at += len(sep)
    at += state == OUTSIDE  # past the opening quote
    while True:
        at = line.find(QUOTE, at)
        if at < 0:
            return INSIDE
        if line.startswith(QUOTE, at + 1) and at + 1 < size:
            at += 2
            continue
        at = line.find(sep, at + 1)
        if at < 0:
            return OUTSIDE
        if not line.startswith(QUOTE, at + len(sep)):
            at = line.find(opening, at)
            if at < 0:
                return OUTSIDE
        at += len(opening)


def lines_of(spark: SparkSession, paths: str | list[str], encoding: str) -> DataFrame:
    """``path, start, line``: lines in order within each range of a file, which begins at byte ``start``."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    if encoding.upper() == "UTF-8":
        line = F.make_valid_utf8("value")
    else:
        line = F.decode(F.col("value").cast("binary"), encoding)
    path, start = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    # a byte order mark is no part of the first field
    return raw.select(path, start, F.when(start == 0, F.ltrim(line, F.lit("\ufeff"))).otherwise(line).alias("line"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """(range, lines) in order; a range may come in several pieces."""
    for batch in batches:
        paths, starts, lines = (column.to_pylist() for column in batch.columns)
        spots = list(zip(paths, starts, strict=True))
        cuts = [0, *(i for i in range(1, len(spots)) if spots[i] != spots[i - 1]), len(spots)]
        for a, b in pairwise(cuts):
            if b > a:
                yield spots[a], lines[a:b]


def range_maps(lines: DataFrame, sep: str) -> DataFrame:
    """``path, start, from_outside, from_inside``: the state a range ends in, by the state it begins in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends = None, [OUTSIDE, INSIDE]
        for spot, quoting in _ranges(batches):
            if spot != at:
                if at is not None:
                    yield told(at, ends)
                at, ends = spot, [OUTSIDE, INSIDE]
            for line in quoting:
                if ends[0] == ends[1]:
                    ends = [state_after(line, ends[0], sep)] * 2
                else:
                    ends = [state_after(line, x, sep) for x in ends]
        if at is not None:
            yield told(at, ends)

    def told(at: tuple[str, int], ends: list[int]) -> pa.RecordBatch:
        columns = [pa.array([at[0]]), pa.array([at[1]], pa.int64()), *(pa.array([x], pa.int32()) for x in ends)]
        return pa.RecordBatch.from_arrays(columns, ["path", "start", "from_outside", "from_inside"])

    # a line without a quote leaves either state as it is; a long range may be told in several rows of Arrow input
    quoting = lines.filter(F.col("line").contains(QUOTE))
    return quoting.mapInArrow(run, "path string, start long, from_outside int, from_inside int")


def ranges_inside(maps: DataFrame) -> DataFrame:
    """``path, start, end_inside``: how each range that holds quotes ends, given all before it in its file."""
    # a map that forgets where it began decides alone; those behind it only keep or swap the state
    swap = (F.col("from_outside") == INSIDE) & (F.col("from_inside") == OUTSIDE)
    fixed = F.col("from_outside") == F.col("from_inside")
    upto = Window.partitionBy("path").orderBy("start")
    run = F.sum(fixed.cast("int")).over(upto)
    grouped = maps.withColumns({"run": run, "fixed": fixed, "swap": (swap & ~fixed).cast("int")})
    within = Window.partitionBy("path", "run").orderBy("start")
    base = F.coalesce(F.max(F.when(F.col("fixed"), F.col("from_outside"))).over(within), F.lit(OUTSIDE))
    return grouped.select("path", "start", ((base + F.sum("swap").over(within)) % 2 == 1).alias("end_inside"))


def _joined(begins, sep: str):
    """Lines of ranges to records. What does not begin and end in one range is told as a piece.

    ``begins`` is a broadcast table: for each path the starts of its ranges with quotes and how they end.
    """

    def begins_inside(spot: tuple[str, int]) -> bool:
        ends = begins.value.get(spot[0], [])
        before = bisect_left(ends, (spot[1],))
        return before > 0 and ends[before - 1][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, leading, place, headless, state = None, [], False, 0, False, OUTSIDE

        def record(ends: bool) -> tuple:
            nonlocal headless
            text = "\n".join(held)
            header = headless and bool(text.strip("\r"))
            headless = headless and not header
            return (*at, place, text, leading, ends, header)

        for spot, lines in _ranges(batches):
            out = []
            if spot != at:
                if held:
                    out.append(record(False))
                at, held, place, headless = spot, [], 0, spot[1] == 0
                leading = begins_inside(spot)
                state = INSIDE if leading else OUTSIDE
            for line in lines:
                if QUOTE in line:
                    state = state_after(line, state, sep)
                held.append(line)
                if state == OUTSIDE:
                    out.append(record(True))
                    held, leading, place = [], False, place + 1
            yield told(out)
        if held:
            yield told([record(False)])

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)],
            ["path", "start", "place", "record", "continues", "ends", "header"],
        )

    return run


def records(spark: SparkSession, paths: str | list[str], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """``path, start, place, record, header``: the records of CSV files, line breaks kept.

    ``start`` and ``place`` order the records of a file; ``header`` marks the first one that is not blank. Records
    end with a line feed, or a carriage return and a line feed, outside of quotes. Blank lines are no records. A quote
    that is never closed takes the rest of its file into one record, less the line break at its end.
    """
    lines = lines_of(spark, paths, encoding)
    ends = ranges_inside(range_maps(lines, sep))
    # a row a range of a file, as many as Spark's own list of ranges on the driver
    by_path: dict[str, list[tuple[int, bool]]] = {}
    for row in ends.collect():
        by_path.setdefault(row.path, []).append((row.start, row.end_inside))
    begins = {path: sorted(found) for path, found in by_path.items() if any(inside for _, inside in found)}
    schema = "path string, start long, place long, record string, continues boolean, ends boolean, header boolean"
    found = lines.mapInArrow(_joined(spark.sparkContext.broadcast(begins), sep), schema)
    if not begins:  # every range begins and ends outside of quotes
        return _tidy(found)
    # a record's pieces: the last of one range, whole ranges, the first of another; few, as ranges are large
    order = Window.partitionBy("path").orderBy("start", "place")
    pieces = found.filter("continues or not ends").withColumn("number", F.sum((~F.col("continues")).cast("int")).over(order))
    joined = pieces.groupBy("path", "number").agg(
        F.min(F.struct("start", "place")).alias("first"),
        F.array_sort(F.collect_list(F.struct("start", "place", "record"))).alias("pieces"),
        F.max("header").alias("header"),
    )
    text = F.array_join(F.transform("pieces", lambda x: x["record"]), "\n").alias("record")
    whole = found.filter("ends and not continues")
    return _tidy(whole).unionByName(_tidy(joined.select("path", "first.start", "first.place", text, "header")))


def _tidy(found: DataFrame) -> DataFrame:
    record = F.regexp_replace("record", r"\r\z", "")
    return found.select("path", "start", "place", record.alias("record"), "header").filter(F.length("record") > 0)


def parser_options(sep: str) -> dict[str, str]:
    return {"sep": sep, "quote": QUOTE, "escape": QUOTE, "multiLine": "true"}


def header_of(spark: SparkSession, paths: str | list[str], sep: str, encoding: str) -> list[str]:
    """The column names: Spark's reader looks at the first record only."""
    options = parser_options(sep) | {"header": "true", "encoding": encoding}
    return spark.read.options(**options).csv(paths).columns


def read_records(spark: SparkSession, paths: str | list[str], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV files with headers as columns of text, large files in several tasks, quoted line breaks allowed.

    Without a file range that ends inside of quotes the files are read twice, else three times.
    """
    names = header_of(spark, paths, sep, encoding)
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = records(spark, paths, sep, encoding).filter("not header")
    return rows.select(F.from_csv("record", fields, parser_options(sep)).alias("cells")).select("cells.*").toDF(*names)
