"""Benchmark decontamination by SimHash of item-sized windows. DataFrame and SQL functions only.

Words are the runs of letters and digits, lower-cased; shingles are WORDS words in a row, by their 64-bit hashes. A window
is as many words as an item has, or the whole of a shorter text. A window as similar as asked must hold shingles of its
item, so windows are laid only where document and item share one: at the offsets at which shared shingles would line up,
and at all offsets between two of these that one window can reach.

Windows of the same shingles are one entry: a passage that a third of all documents hold is looked up and verified once. An
entry's fingerprint of 128 bits is looked up among the items of its length by its BLOCKS blocks of BLOCK_BITS bits. The index
holds every block of an item in all forms with up to PROBES bits changed, so each fingerprint within RADIUS shares at least
one key, and by chance some 9 in 100 others do, of which the distance leaves next to none. What is within RADIUS is verified:
the weighted Jaccard similarity of the shingles, each weighing as often as it occurs.

At a similarity of 0.75 fingerprints differ in 22 bits on average, with a standard deviation of 4.3, so some 1 in 70 windows
right at the limit lies beyond RADIUS (31), and far fewer above it. Items of less than WORDS words have no shingle and are
found as a whole sequence of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WORDS, SIMILARITY = 5, 0.75
#: Blocks of a fingerprint, their bits, and how many of these an item's block has changed at most in the index.
BLOCKS, BLOCK_BITS, PROBES = 8, 16, 3
#: Two fingerprints that differ in more than PROBES bits of every block differ in more than this.
RADIUS = BLOCKS * (PROBES + 1) - 1
#: Item shingles up to which they are broadcast (24 bytes each, 12 MB in all); above it the join shuffles.
BROADCAST_SHINGLES = 500_000


def _hashes(text: str) -> str:
    """SQL: word hashes of a text."""
    return f"transform(filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> ''), w -> xxhash64(w))"


def _shingles(hashes: str) -> str:
    """SQL: shingle hashes by position, of an array of word hashes."""
    parts = ", ".join(f"element_at({hashes}, i + {j})" for j in range(WORDS))
    return f"if(size({hashes}) >= {WORDS}, transform(sequence(1, size({hashes}) - {WORDS - 1}), i -> xxhash64({parts})), cast(array() as array<bigint>))"


def _half(hashes: str) -> str:
    """SQL: SimHash of an array of 64-bit hashes: bit b is set if more than half of them have it."""
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * aggregate({hashes}, 0, (n, h) -> n + cast(shiftright(h, b) & 1 as int)) > size({hashes}), shiftleft(1L, b), 0L))"


def _fingerprint(shingles: str) -> str:
    """SQL: SimHash of 128 bits as an array of two numbers: of the shingles' hashes and of the hashes of these."""
    return f"array({_half(shingles)}, {_half(f'transform({shingles}, s -> xxhash64(s))')})"


def _blocks(fingerprint: str, probes: int = 0) -> str:
    """SQL: the blocks of a fingerprint, each with its number, in all forms with up to `probes` bits changed."""
    each, size = 64 // BLOCK_BITS, 1 << BLOCK_BITS
    cut = [f"{i * size}L + (shiftrightunsigned({fingerprint}[{i // each}], {i % each * BLOCK_BITS}) & {size - 1})" for i in range(BLOCKS)]
    if not probes:
        return f"array({', '.join(cut)})"
    masks = f"filter(sequence(0L, {size - 1}L), m -> bit_count(m) <= {probes})"  # a constant: made once
    return f"flatten(transform(array({', '.join(cut)}), b -> transform({masks}, m -> b ^ m)))"


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words, h (word hashes), item_shingles, item_print of the items that have a word. A null item_id or text is left out."""
    own = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.expr(_hashes("cast(text as string)")).alias("h"))
    own = own.where("size(h) > 0").select("item_id", F.expr("size(h)").alias("n_words"), "h", F.expr(_shingles("h")).alias("item_shingles"))
    return own.distinct().withColumn("item_print", F.expr(_fingerprint("item_shingles")))


def _short_matches(whole: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, at_word (the first), similarity (1) of items of less than WORDS words, which a document holds as they are."""
    lengths = sorted(r[0] for r in items.where(f"n_words < {WORDS}").select("n_words").distinct().collect())  # WORDS - 1 at most
    if not lengths:
        return whole.sparkSession.createDataFrame([], "doc_id long, item_id long, at_word long, similarity double")
    keys = items.where(f"n_words < {WORDS}").select("item_id", "n_words", F.expr("xxhash64(h)").alias("sequence"))
    # From 0 up to the last place, or down to below 0 in a text that is shorter: these fall to the filter.
    parts = ", ".join(f"transform(sequence(0, size(h) - {n}), i -> named_struct('n_words', {n}, 'at', i, 'sequence', xxhash64(slice(h, greatest(i, 0) + 1, {n}))))" for n in lengths)
    own = whole.select("doc_id", F.expr(_hashes("text")).alias("h")).where(f"size(h) >= {lengths[0]}")
    flat = own.select("doc_id", F.explode(F.expr(f"filter(flatten(array({parts})), x -> x.at >= 0 and x.at + x.n_words <= size(h))")).alias("x")).select("doc_id", "x.*")
    small = keys.count() <= BROADCAST_SHINGLES
    met = flat.join(F.broadcast(keys) if small else keys, ["n_words", "sequence"])
    return met.groupBy("doc_id", "item_id").agg(F.min("at").cast("long").alias("at_word")).withColumn("similarity", F.lit(1.0))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, at_word (from 0, of the best window, the first of equals), similarity.

    A document shorter than an item is one window. A null text is empty. Repeated rows of a doc_id give one row; items with
    the same text are matched each; items without a word are left out; empty tables give an empty result.
    """
    items = shared.written(items_of(benchmark), "items")
    parts = items.select("item_id", "n_words", F.posexplode("item_shingles").alias("q", "shingle"))
    small = parts.count() <= BROADCAST_SHINGLES
    keys = parts.select("shingle").distinct()
    whole = shared.texts(docs)
    # One pass over all texts: documents with a shared shingle keep their shingles.
    own = whole.select("doc_id", F.expr(_hashes("text")).alias("h")).select("doc_id", F.expr(_shingles("h")).alias("shingles"))
    # The outer form, as for the other Spark would push a test of the array's size, and with it the whole expression, down to the scan.
    flat = own.select("doc_id", F.posexplode_outer("shingles").alias("p", "shingle"))
    hits = flat.join(F.broadcast(keys) if small else keys, "shingle")
    hits = shared.written(hits, "hits")
    # Items of which a document holds fewer shingles than any similar window must are out; counts are per document and item.
    found = hits.join(F.broadcast(parts) if small else parts, "shingle")
    offsets = found.groupBy("doc_id", "item_id", "n_words", (F.col("p") - F.col("q")).alias("at")).agg(F.count("*").alias("n"))
    enough = F.ceil(F.lit(similarity) * (F.col("n_words") - (WORDS - 1)))
    whole_item = offsets.groupBy("doc_id", "item_id").agg(F.sum("n").alias("total"))
    offsets = offsets.join(whole_item, ["doc_id", "item_id"]).where(F.col("total") >= enough)
    offsets = offsets.groupBy("doc_id", "item_id", "n_words").agg(F.sort_array(F.collect_set("at")).alias("at"))
    # From each offset on to the next, where one window can hold shingles of both: each side's shared shingles lie within the item.
    starts = F.expr(f"flatten(transform(at, (a, i) -> if(i + 1 < size(at) and at[i + 1] - a <= 2 * (n_words - {WORDS}), sequence(a, at[i + 1]), array(a))))")
    laid = shared.written(offsets.select("doc_id", "n_words", F.explode(starts).alias("at")).distinct(), "laid")
    near = laid.groupBy("doc_id").agg(F.collect_list(F.struct("n_words", "at")).alias("windows"))
    ids = shared.written(near, "windows")
    texts = shared.semi(whole, ids.select("doc_id"), "doc_id").join(ids, "doc_id")
    cut = texts.select("doc_id", "windows", F.expr(_hashes("text")).alias("h")).select("doc_id", "windows", F.expr(_shingles("h")).alias("shingles"))
    window = cut.select("doc_id", F.explode("windows").alias("w"), "shingles").select("doc_id", "w.n_words", "w.at", "shingles")
    # A window that would stick out at an end is moved in; of a text that is shorter it is the whole.
    window = window.withColumn("at", F.expr(f"greatest(0, least(at, size(shingles) - (n_words - {WORDS - 1})))"))
    window = window.select("doc_id", "n_words", "at", F.expr(f"slice(shingles, at + 1, n_words - {WORDS - 1})").alias("window_shingles")).dropDuplicates(["doc_id", "n_words", "at"])
    window = shared.written(window.withColumn("content", F.sha2(F.concat_ws(",", "n_words", F.col("window_shingles").cast("array<string>")), 256)), "laid_windows")
    shared.spent(hits, laid, ids)
    contents = window.groupBy("content").agg(F.first("n_words").alias("n_words"), F.first("window_shingles").alias("window_shingles"), F.count("*").alias("n"))  # the same in all rows of a content
    contents = shared.written(contents.withColumn("window_print", F.expr(_fingerprint("window_shingles"))), "contents")
    looked = contents.select("content", "n_words", "window_print", F.explode(F.expr(_blocks("window_print"))).alias("block"))
    index = items.where(f"n_words >= {WORDS}").select("item_id", "n_words", "item_print", F.explode(F.expr(_blocks("item_print", PROBES))).alias("block"))
    apart = "bit_count(window_print[0] ^ item_print[0]) + bit_count(window_print[1] ^ item_print[1])"
    candidates = looked.join(index, ["n_words", "block"]).where(f"{apart} <= {RADIUS}").select("content", "item_id").distinct()
    pairs = candidates.join(contents.select("content", "window_shingles", "n"), "content").join(items.select("item_id", "item_shingles"), "item_id")
    # The smaller counts add up to the weight in common.
    common = "aggregate(array_distinct(item_shingles), 0, (n, s) -> n + least(size(filter(item_shingles, x -> x = s)), size(filter(window_shingles, x -> x = s))))"
    scored = pairs.withColumn("common", F.expr(common)).withColumn("similarity", F.expr("common / (1.0D * size(item_shingles) + size(window_shingles) - common)"))
    verdicts = scored.where(F.col("similarity") >= similarity).groupBy("content").agg(F.first("n").alias("n"), F.collect_list(F.struct("item_id", "similarity")).alias("held"))
    verdicts = shared.written(verdicts, "verdicts")
    shared.spent(contents)
    told = shared.hot_join(window.select("doc_id", "at", "content"), verdicts, "content", "doc_id", "n").select("doc_id", "at", F.inline("held"))
    best = told.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("at")).alias("at"))).alias("best"))
    best = best.select("doc_id", "item_id", (-F.col("best.at")).cast("long").alias("at_word"), F.round("best.similarity", 6).alias("similarity"))
    return best.unionByName(_short_matches(whole, items))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, all columns."""
    found = shared.written(matches(docs, benchmark).select(F.col("doc_id").alias("_found")).distinct(), "found")
    return docs.join(found.withColumnRenamed("_found", "doc_id"), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
