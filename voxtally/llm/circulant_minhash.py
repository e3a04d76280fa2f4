"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components.

A document's set holds its distinct five-word shingles (A-Z lower-cased, words are runs without
ASCII white space; a shorter text is one shingle). Two documents are linked when their exact
Jaccard similarity is at least 0.75.

Signature: shingle hashes are scattered over ``2**UNIVERSE_BITS`` slots by a first permutation. A
second permutation, shifted circularly by k, gives coordinate k, so the coordinates 0 to K - 1 of a shingle
are one contiguous slice of that permutation and a signature is the minimum over such slices. 51 bands of 5
coordinates miss a pair at similarity 0.75 with probability 1e-6. For documents that share a bucket 1024
coordinates are made; their lowest bits are a sketch. At similarity 0.75 seven eighths of these agree on average,
and pairs whose sketches differ in more than 181 of 1024 bits, which a pair at 0.75 does with probability 7.6e-7, are
not compared by text.

Documents with equal sets form a class, which goes through the search once. In each bucket members
are compared with leaders instead of with each other; a bucket is closed when its members are in one
component or every pair of different components has been compared. A hot bucket so costs one pass,
and no link is lost: there is one leader first, then 16 in each bucket that is still open, so that most of a large
group is in one component; in the rounds after that all members are leaders, or 1024 new ones a round in a larger bucket. Among the members of open buckets, shingles that only one document has are counted first: what two
documents can share at most follows from that, and rules out most pairs without a look at their texts. The rest is left
to cells: each shingle marks one of 4096, the further ones of a cell mark one of 1024 more, and two documents share at
most the cells that both have marked and the lesser number of shingles that marked none. So the pairs whose texts are
compared are few besides the linked ones, and no linked one is ruled out.

Rows: a null text or one without words has an empty set, is linked with nothing and kept. Repeated
rows are in one class. A row with a null id takes part; it is kept only if its whole component has no id. Very long
texts are hashed whole, a bounded number of shingles at a time. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import free_name, map_batches, written

WORDS = 5
SIMILARITY = 75
UNIVERSE_BITS = 20
BANDS, ROWS = 51, 5
SKETCH = 1024
#: How many lowest bits may differ.
DIFFERENT = 181
#: Leaders of a bucket in the round after the first, and in later ones.
FEW_LEADERS, LEADERS = 16, 1024
#: Cells of a set's map, and those for the further shingles of a cell.
CELLS, MORE_CELLS = 4096, 1024
SEED = 20240607
NO_ID = -(1 << 63)
#: Word hashes that a worker remembers, of words of at most so many bytes: about 16 MB.
CACHE_WORDS, LONGEST_WORD = 100_000, 32
MIX_1, MIX_2, BASE = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))

#: What is known of a class without its text.
BITS = tuple(f"s{k}" for k in range(SKETCH // 64))
TRAITS = ("n_shingles", "bands", "cells", "beside", *BITS)
LEFT, RIGHT = ({"node": side} | {name: f"{name}_{side}" for name in (*TRAITS, "shared")} for side in "ab")
#: What sizes and sketches allow.
FITS = (
    f"100 * least(n_shingles_a, n_shingles_b) >= {SIMILARITY} * greatest(n_shingles_a, n_shingles_b) and "
    + " + ".join(f"bit_count({x}_a ^ {x}_b)" for x in BITS)
    + f" <= {DIFFERENT}"
)
#: What the shingles that others have too allow.
SHARES = (
    f"100 * least(shared_a, shared_b) >= {SIMILARITY} * (n_shingles_a + n_shingles_b - least(shared_a, shared_b))"
)
#: What the cells allow.
COMMON = "aggregate(zip_with(cells_a, cells_b, (x, y) -> bit_count(x & y)), least(beside_a, beside_b), (n, x) -> n + x)"
OVERLAPS = f"{100 + SIMILARITY} * {COMMON} >= {SIMILARITY} * (n_shingles_a + n_shingles_b)"
#: A pair is looked at in one of the buckets it shares. If a side was that bucket's leader, that is done.
FIRST_SHARED = "bucket = array_min(array_intersect(bands_a, bands_b))"

_word_hashes: dict[bytes, int] = {}
_permutations: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    if not words:
        return np.empty(0, np.uint64)
    if len(_word_hashes) > CACHE_WORDS:
        _word_hashes.clear()
    known, hashed = _word_hashes.get, []
    for word in words:
        h = known(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
            if len(word) <= LONGEST_WORD:
                _word_hashes[word] = h
        hashed.append(h)
    ids = np.array(hashed, np.uint64)
    width = min(size, len(ids))
    out = np.full(len(ids) - width + 1, np.uint64(width))
    for k in range(width):
        out = mix(out * BASE + ids[k : len(ids) - width + 1 + k])
    return np.unique(out)


def permutations() -> list[np.ndarray]:
    """The scattering permutation, and all shifts of the circulant one as a strided view."""
    if not _permutations:
        rng, size = np.random.default_rng(SEED), 1 << UNIVERSE_BITS
        scatter = rng.permutation(size).astype(np.uint32)
        circular = rng.permutation(size).astype(np.uint32)
        around = np.concatenate([circular, circular[: SKETCH - 1]])
        _permutations.extend([scatter, np.lib.stride_tricks.sliding_window_view(around, SKETCH)])
    return _permutations


def signature(hashes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The first coordinates of a set's signature."""
    scatter, shifts = permutations()
    places = scatter[(hashes & np.uint64((1 << UNIVERSE_BITS) - 1)).astype(np.int64)]
    out, step = np.full(size, np.iinfo(np.uint32).max, np.uint32), max(1, (1 << 17) // size)
    for start in range(0, len(places), step):
        np.minimum(out, shifts[places[start : start + step], :size].min(axis=0), out=out)
    return out


def band_hashes(signed: np.ndarray) -> np.ndarray:
    """A bucket number for each band; band b has the coordinates b, b + 51, b + 102, b + 153, b + 204."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in signed.reshape(ROWS, BANDS).astype(np.uint64):
        out = mix(out * BASE + row)
    return out.view(np.int64)


def sketch(signed: np.ndarray) -> np.ndarray:
    """The lowest bits of the coordinates, 64 a number."""
    return np.packbits((signed & np.uint32(1)).astype(np.uint8)).view(np.int64)


def cells(hashes: np.ndarray) -> np.ndarray:
    """The map of a set: which of the cells its shingles fall on, 64 a number."""
    counts = np.bincount(((hashes >> np.uint64(32)) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    further = np.maximum(counts - 1, 0).reshape(-1, MORE_CELLS).sum(axis=0)
    return np.packbits(np.concatenate([counts, further]) > 0).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, high, low, bands = [], [], [], []
        for text in batch.column(1).to_pylist():
            hashes = shingle_hashes(words_of(text))
            sizes.append(len(hashes))
            if not len(hashes):
                high.append(None), low.append(None), bands.append(None)
                continue
            high.append(int(mix(hashes).sum().view(np.int64)))
            low.append(int(mix(hashes ^ BASE).sum().view(np.int64)))
            bands.append(band_hashes(signature(hashes)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(sizes, pa.int64()),
                pa.array(high, pa.int64()),
                pa.array(low, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            ["doc_id", "print", "n_shingles", "high", "low", "bands"],
        )


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: id, hash of the text, set size, 128-bit digest of the set, buckets."""
    schema = "doc_id long, print long, n_shingles long, high long, low long, bands array<long>"
    text = F.col("text").cast("string")
    return map_batches(docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)), _sets, schema)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add set sizes, buckets, maps and sketches to texts."""
    for batch in batches:
        sizes, bands, bits = [], [], np.empty((batch.num_rows, SKETCH // 64), np.int64)
        maps = np.empty((batch.num_rows, (CELLS + MORE_CELLS) // 64), np.int64)
        for i, text in enumerate(batch.column(1).to_pylist()):
            hashes = shingle_hashes(words_of(text))
            sizes.append(len(hashes))
            signed = signature(hashes, SKETCH)
            bands.append(band_hashes(signed[: BANDS * ROWS]))
            bits[i], maps[i] = sketch(signed), cells(hashes)
        beside = np.array(sizes, np.int64) - np.bitwise_count(maps.view(np.uint64)).sum(axis=1, dtype=np.int64)
        columns = [pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        columns += [pa.array(list(maps), pa.list_(pa.int64())), pa.array(beside)]
        columns += [pa.array(x, pa.int64()) for x in bits.T]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["node", "text", *TRAITS])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a text."""
    for batch in batches:
        found = [shingle_hashes(words_of(text)).view(np.int64) for text in batch.column(1).to_pylist()]
        nodes = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(x) for x in found])
        shingles = np.concatenate(found) if found else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(shingles)], ["node", "shingle"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose full sets are similar enough. Rows come in runs of one leader."""
    leader, left = None, None
    for batch in batches:
        keep = []
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for a, _, text_a, text_b in zip(*columns, strict=True):
            if a != leader:
                leader, left = a, exact_set(text_a)
            right = exact_set(text_b)
            common = len(left & right)
            keep.append(100 * common >= SIMILARITY * (len(left) + len(right) - common))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


def exact_set(text: str | None) -> set:
    words = words_of(text)
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(WORDS)), strict=False))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar by their texts (node, text).

    A leader may have very many partners. The last join attaches its text to them in the reading task, where
    Spark splits a large partition and repeats the leader's one row; rows of a leader stand together.
    """
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return map_batches(both.select("a", "b", "text_a", "text_b"), _verified, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b), for nodes with an edge.

    Labels move along edges and then jump to the label's own label, until nothing changes.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = (
            both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        )
        step = labels.join(near, labels.node == near.a).select(
            "node", "component", F.least("component", "near").alias("nearest")
        )
        jump = labels.select(F.col("node").alias("nearest"), F.col("component").alias("beyond"))
        moved = written(
            step.join(jump, "nearest", "left").select(
                "node",
                F.least("nearest", "beyond").alias("component"),
                (F.least("nearest", "beyond") != F.col("component")).alias("changed"),
            )
        )
        labels = moved.select("node", "component")
        if moved.filter("changed").isEmpty():
            return labels


def with_shared(traits: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``shared``: how many of a node's shingles other nodes of ``traits`` have too."""
    own = texts.join(traits.select("node"), "node", "left_semi").select("node", "text")
    rows = map_batches(own, _shingle_rows, "node long, shingle long")
    single = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("n")).filter("n = 1")
    alone = single.groupBy("node").agg(F.count("*").alias("alone"))
    return traits.join(alone, "node", "left").withColumn(
        "shared", F.col("n_shingles") - F.coalesce("alone", F.lit(0))
    ).drop("alone")


def linked_classes(classes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(node, component) of the classes that have a link; None if no class has one."""
    exploded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    members = written(exploded.join(shared.filter("first < last").drop("last"), "bucket"))
    texts = class_texts(classes.join(members.select("node").distinct(), "node", "left_semi"), docs)
    kinds = "node long, text string, n_shingles long, bands array<long>, cells array<long>, beside long, "
    kinds += ", ".join(f"{x} long" for x in BITS)
    texts = written(map_batches(texts, _described, kinds))
    traits = texts.select("node", *TRAITS)
    rest = members.filter("node > first").select("bucket", "node")
    pairs = members.filter("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    slim = traits.drop("bands")
    pairs = pairs.join(slim.withColumnsRenamed(LEFT), "a").join(slim.withColumnsRenamed(RIGHT), "b").filter(f"{FITS} and {OVERLAPS}")
    checked = edges = labels = None
    limit = min(FEW_LEADERS, LEADERS)
    while True:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = written(pairs)
        if not pairs.isEmpty():
            checked = pairs if checked is None else checked.unionAll(pairs)
            found = written(verify(pairs, texts))
            if not found.isEmpty():
                edges = found if edges is None else edges.unionAll(found)
                labels = components(edges)
        if rest is None:
            return labels
        tagged = rest.withColumn("component", F.col("node"))
        if labels is not None:
            known = labels.withColumnRenamed("component", "known")
            tagged = rest.join(known, "node", "left").select(
                "bucket", "node", F.coalesce("known", "node").alias("component")
            )
        span = tagged.groupBy("bucket").agg(
            F.min("component").alias("low"), F.max("component").alias("top"), F.count("*").alias("n")
        )
        still_open = written(tagged.join(span.filter("low < top").select("bucket", "n"), "bucket"))
        largest = still_open.agg(F.max("n")).first()[0]
        if largest is None:
            return labels
        open_traits = traits.join(still_open.select("node").distinct(), "node", "left_semi")
        described = written(still_open.join(with_shared(open_traits, texts), "node"))
        slot = F.expr(f"if(n <= {limit}, node, pmod(xxhash64(node), {limit}))").alias("slot")
        leaders = described.groupBy("bucket", slot).agg(
            F.min_by(F.struct("node", "component", "shared", *TRAITS), "node").alias("leader")
        )
        leaders = leaders.select("bucket", "leader.*")
        near = described.withColumnsRenamed(RIGHT | {"component": "component_b"}).join(
            leaders.withColumnsRenamed(LEFT | {"component": "component_a"}), "bucket"
        )
        fresh = f"component_a <> component_b and (n > {limit} or a < b)"
        pairs = near.filter(f"{fresh} and {SHARES} and {FITS} and {FIRST_SHARED} and {OVERLAPS}").select("a", "b")
        if largest <= limit:
            rest = None
        else:
            wide = described.filter(f"n > {limit}").select("bucket", "node")
            rest = written(wide.join(leaders.select("bucket", "node"), ["bucket", "node"], "left_anti"))
            limit = LEADERS


def class_texts(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text): one text of each class, found by the id and the print of the class's first row."""
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.xxhash64(F.col("text").cast("string")).alias("print"),
        F.col("text").cast("string").alias("text"),
    )
    return (
        keyed.join(classes.select("node", "key", "print"), ["key", "print"])
        .groupBy("key", "print")
        .agg(F.first("node").alias("node"), F.first("text").alias("text"))
        .select("node", "text")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, print, n_shingles, component_id, kept, class_id.

    component_id is the smallest doc_id reachable over links, the row's own included; kept marks the
    rows whose id it is. print hashes the text, class_id numbers the distinct sets (null for the empty one), group_id
    the components.
    """
    sets = written(shingle_sets(docs))
    classes = written(
        sets.filter("n_shingles > 0")
        .groupBy("high", "low")
        .agg(
            F.min(F.struct(F.expr("doc_id is null"), F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "print")).alias("at"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        )
        .select(
            F.monotonically_increasing_id().alias("node"), "high", "low", "at.key", "at.print", "n_shingles", "bands"
        )
    )
    labels = linked_classes(classes, docs)
    rep = F.when(F.col("key") != NO_ID, F.col("key"))
    named = classes.select("node", "high", "low", rep.alias("component_id"), F.col("node").alias("group_id"))
    if labels is not None:
        reps = labels.join(classes.select("node", rep.alias("rep")), "node")
        smallest = reps.groupBy("component").agg(F.min("rep").alias("smallest"))
        linked = labels.join(smallest, "component").select("node", "smallest", "component")
        named = named.join(linked, "node", "left").select(
            "node",
            "high",
            "low",
            F.coalesce("smallest", "component_id").alias("component_id"),
            F.coalesce("component", "node").alias("group_id"),
        )
    return sets.join(named, ["high", "low"], "left").select(
        "doc_id",
        "print",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("node").isNull(), F.lit(True))
        .otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .alias("kept"),
        F.col("node").alias("class_id"),
        "group_id",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns unchanged; rows without words all stay.

    It is the one with the smallest id, of equal ids the one with the smallest hash of its text; rows without id come
    last. Of rows that agree in both any one stays.
    """
    found = near_duplicates(docs).filter("group_id is not null")
    texts = written(found.groupBy("group_id", "doc_id", "print").agg(F.count("*").alias("n")))
    place = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("key"), "print")
    chosen = texts.groupBy("group_id").agg(F.min(place).alias("chosen"))
    marked = texts.join(chosen, "group_id").withColumn("first", place == F.col("chosen"))
    row_id, row_print = free_name(docs, "row_id"), free_name(docs, "row_print")
    keys = {row_id: F.col("doc_id").cast("long"), row_print: F.xxhash64(F.col("text").cast("string"))}
    keyed = docs.withColumns(keys)

    def by_key(rows: DataFrame, of: DataFrame, how: str) -> DataFrame:
        named = of.select(F.col("doc_id").alias("of_id"), F.col("print").alias("of_print"))
        return rows.join(named, rows[row_id].eqNullSafe(named.of_id) & (rows[row_print] == named.of_print), how)

    dropped, repeated = marked.filter("not first"), marked.filter("first and n > 1")
    stay = by_key(keyed, dropped, "left_anti")
    if repeated.isEmpty():
        return stay.select(docs.columns)
    once = by_key(stay, repeated, "left_anti").select(docs.columns)
    many = by_key(stay, repeated, "left_semi").groupBy(row_id, row_print).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(many.select("row.*"))
