"""Benchmark decontamination by spaced seeds.

Words are lower-cased runs of letters and digits. A mask says which places of a short stretch count and which
are ignored, so a substituted word under an ignored place does not hide a stretch. The masked stretches
of all benchmark items are joined with those of all documents by hash. Around each hit the words of
document and item are compared at equal offsets: a window of 16 item words (the whole item if it is shorter)
that holds the stretch must agree in 80 % of its words.

The search is one pass of native columns over the documents, without a shuffle, as long as the seeds of the
benchmark are few enough to be broadcast (their number is counted first; a seed takes some 40 bytes, whatever its item,
and the items' words, which are fewer than the seeds, eight each). More seeds are joined by a shuffle
of the masked hashes, and the documents with hits are compared afterwards; the result is the same.

The masks are short enough that no overlap of this kind is without a hit: in a window of 5 to 16 words with up to
20 % substituted words, wherever they stand, a mask finds a stretch. The first two do so from 7 words on; the
others are used only if the benchmark has items of 5 or 6 words. Items of up to three words are shorter than any
mask and are searched for exactly, as a whole, so a one-word item overlaps with each document that has the word. Such
overlaps are reported, but ``without_overlaps`` drops no document for them.

Rows: a null or empty text has no words and no overlap. Repeated rows of documents or items give one row for
their ids. Texts of any length are searched whole. An empty table on either side gives no overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import free_name, written

MASKS = ("1111", "11101", "11011", "10111")
#: The masks that suffice for windows from so many words on.
LONG_MASKS, LONG = MASKS[:2], 7
#: Whole items of fewer words than a mask.
WHOLE = ("1", "11", "111")
WINDOW = 16
MIN_AGREED = 80
BROADCAST_SEEDS = 500_000
#: Items of fewer words drop no document by themselves.
LEAST_WORDS = 4


def word_hashes(text: str) -> Column:
    """The hashes of a text's words, in order."""
    words = F.array_remove(F.split(F.lower(F.col(text).cast("string")), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda word: F.xxhash64(word))


def seeds(words: str, masks: tuple[str, ...] = MASKS) -> Column:
    """The hashes of the masked stretches of words at all places, mask by mask."""
    of_mask = []
    for mask in masks:
        used = ", ".join(f"get({words}, i + {k})" for k, flag in enumerate(mask) if flag == "1")
        places = f"if(size({words}) < {len(mask)}, array(), sequence(0, size({words}) - {len(mask)}))"
        of_mask.append(f"transform({places}, i -> xxhash64({int(mask, 2)}, {used}))")
    return F.expr(f"concat({', '.join(of_mask)})")


def place_of(position: str, size: str, masks: tuple[str, ...] = MASKS) -> tuple[Column, Column]:
    """Place and span of the seed at a position of ``seeds``, for a text of ``size`` words."""
    place, span, before = [], [], "0"
    for mask in masks:
        until = f"{before} + greatest({size} - {len(mask)} + 1, 0)"
        place.append(f"when {position} < {until} then {position} - ({before})")
        span.append(f"when {position} < {until} then {len(mask)}")
        before = until
    return F.expr(f"case {' '.join(place)} end"), F.expr(f"case {' '.join(span)} end")


def agreed() -> Column:
    """The most words that agree in a window of the item that holds the seed."""
    width = f"least({WINDOW}, size(item_words))"
    first = f"greatest(0, least(item_place + span - {width}, size(item_words) - {width}))"
    last = f"greatest({first}, least(item_place, size(item_words) - {width}))"
    same = (
        f"transform(sequence(0, {last} - {first} + {width} - 1), k -> "
        f"if(get(item_words, {first} + k) = get(doc_words, place - item_place + {first} + k), 1L, 0L))"
    )
    return F.expr(
        f"array_max(transform(array({same}), same -> array_max(transform(sequence(0, {last} - {first}), s -> "
        f"aggregate(slice(same, s + 1, {width}), 0L, (sum, x) -> sum + x)))))"
    )


def masks_for(items: DataFrame) -> tuple[tuple[str, ...], int]:
    """The masks that items of these sizes need, and a bound of the number of their seeds."""
    n = F.size("item_words")
    least = min(map(len, MASKS))
    counted = items.agg(
        F.coalesce(F.sum(n), F.lit(0)), *(F.coalesce(F.max(n == k), F.lit(False)) for k in range(1, LONG))
    ).first()
    masks = MASKS if any(counted[k] for k in range(least + 1, LONG)) else LONG_MASKS
    return masks + tuple(mask for mask in WHOLE if counted[len(mask)]), counted[0] * len(masks)


def benchmark_seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """The distinct seeds (seed, item, item_place, span) of items (item, item_words)."""
    least = min(map(len, MASKS))
    parts = []
    for group in (tuple(m for m in masks if m not in WHOLE), *((m,) for m in masks if m in WHOLE)):
        fits = F.size("item_words") >= least if group[0] not in WHOLE else F.size("item_words") == len(group[0])
        place, span = place_of("position", "size(item_words)", group)
        listed = items.filter(fits).select("item", "item_words", F.posexplode(seeds("item_words", group)).alias("position", "seed"))
        parts.append(listed.select("seed", "item", place.alias("item_place"), span.alias("span")))
    probes = parts[0]
    for part in parts[1:]:
        probes = probes.unionAll(part)
    return probes.distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The pairs of a document and a benchmark item that overlap: ``keys``, item_id, n_agreed, window_words.

    ``n_agreed`` is the largest number of words that agree in a window, ``window_words`` its length.
    """
    items = benchmark.select(F.col("item_id").cast("long"), word_hashes("text").alias("item_words")).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "item_words"))
    masks, size = masks_for(items)
    probes = benchmark_seeds(items, masks)
    rows = docs.select(*keys, word_hashes("text").alias("doc_words"))
    place, _ = place_of("position", "size(doc_words)", masks)
    if size <= BROADCAST_SEEDS:
        listed = rows.select(*keys, "doc_words", F.posexplode(seeds("doc_words", masks)).alias("position", "seed"))
        hits = listed.join(F.broadcast(probes), "seed").join(F.broadcast(items), "item")
    else:
        kept = written(rows.withColumn("row", F.monotonically_increasing_id()))
        listed = kept.select("row", F.posexplode(seeds("doc_words", masks)).alias("position", "seed"))
        found = listed.select("row", "position", "seed").join(probes, "seed").drop("seed")
        hits = found.join(kept, "row").join(items, "item")
    compared = hits.select(
        *keys, "item_id", "item_words", "doc_words", place.alias("place"), "item_place", "span"
    ).select(
        *keys,
        "item_id",
        agreed().alias("n_agreed"),
        F.least(F.lit(WINDOW), F.size("item_words")).cast("long").alias("window_words"),
    )
    return (
        compared.filter(f"100 * n_agreed >= {MIN_AGREED} * window_words")
        .groupBy(*keys, "item_id")
        .agg(F.max("n_agreed").alias("n_agreed"), F.max("window_words").alias("window_words"))
    )


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no benchmark item of ``LEAST_WORDS`` words or more, all columns unchanged.

    Rows are told apart by id and text, so a row without id goes for its own text only.
    """
    text_print = F.xxhash64(F.col("text").cast("string"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("row_id"), text_print.alias("row_print"), "text")
    long_items = benchmark.filter(F.size(word_hashes("text")) >= LEAST_WORDS)
    dirty = overlaps(keyed, long_items, ("row_id", "row_print")).select("row_id", "row_print").distinct()
    dirty = dirty.toDF(id_key := free_name(docs, "row_id"), print_key := free_name(docs, "row_print"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_key)) & (text_print == F.col(print_key))
    return docs.join(dirty, same, "left_anti")
