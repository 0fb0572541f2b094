"""Exact deduplication by a tree-merge of sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Rows of a run, about, and how many runs one round merges (2: binomial rounds; 4: two of them at once). LEAST runs at any rate.
RUN_ROWS, FAN_IN, LEAST = 1_000_000, 4, 64
KEY = ["text_sha256", "n_bytes", "check"]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and what identifies a text: its SHA-256, and its length and an independent 64-bit hash."""
    return shared.texts(docs).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("check"))


def merged_entries(runs: DataFrame) -> DataFrame:
    """The entries of sorted runs, merged in the order of KEY: of entries of one text, which lie side by side then, one stays, with the preferred identifier and the summed count."""
    same = Window.partitionBy("run", *KEY)
    lead = Window.partitionBy("run", *KEY).orderBy(F.desc("keep_id"))
    ordered = runs.sortWithinPartitions("run", *KEY, F.desc("keep_id"))
    return ordered.withColumn("_at", F.row_number().over(lead)).withColumn("group_size", F.sum("group_size").over(same)).where("_at = 1").drop("_at")


def merge_runs(marked: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """KEY, keep_id, group_size of each distinct text.

    A run is sorted by KEY and lies in one partition, of which there are as many as runs (by a
    hash of the run's number, so one may have two and another none). Every document begins in the run of its doc_id's
    hash, as a number of so many digits to the base fan_in; `runs` is rounded up to a power of it. In round j runs whose numbers differ in digit
    j alone exchange entries: an entry goes to that run of the fan_in which has the digest's digit j. There the
    fan_in sorted runs that have come are merged: entries of equal digest, length and check lie side by side, and the one
    with the preferred identifier (the largest doc_id comes first) stays, with the summed count. After the last round a
    run's number is its digests', so every digest is in one run only and no run ever holds more than its share. A
    task sums up equal texts before the first round, so a text that a third of all rows share is an entry a run from the
    start, and arrives fan_in entries at a time.
    """
    rounds = 0
    while fan_in**rounds < runs:
        rounds += 1
    runs = fan_in**rounds
    target = F.pmod(F.conv(F.substring("text_sha256", 1, 12), 16, 10).cast("long"), F.lit(runs))
    first = marked.select(F.pmod(F.xxhash64("doc_id"), F.lit(runs)).alias("run"), *KEY, "doc_id")
    level = first.groupBy("run", *KEY).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    for j in range(rounds):
        digit = lambda x: F.floor(x / fan_in**j) % fan_in  # noqa: B023, E731
        to = F.col("run") + (digit(target) - digit(F.col("run"))) * fan_in**j
        level = merged_entries(level.withColumn("run", to).repartition(runs, "run"))
    return level.drop("run")


def unlike(docs: DataFrame, merged: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and text of the documents whose text isn't that of the document which stands for their digest: none, unless SHA-256, length and a second hash all agree for two texts.

    Texts meet in pairs with the one that stays, hot ones salted. Up to a quarter of shared.BROADCAST_ROWS digests of groups
    of two or more are sent to where the texts are, and only these texts move; beyond that all do. merged: as merge_runs()
    gives it, written.
    """
    several = merged.where("group_size > 1")
    digests = several.select("text_sha256")
    few = digests.count() <= shared.BROADCAST_ROWS // 4  # a digest is four times as long as an id
    rows = shared.texts(docs).withColumn("text_sha256", F.sha2("text", 256)).join(F.broadcast(digests) if few else digests, "text_sha256", "left_semi")
    stays = several.select("text_sha256", F.col("keep_id").alias("doc_id"), "group_size")
    # Rows that repeat a doc_id with several texts of one digest can't be told apart by it; the largest text stands for them.
    wide = rows.join(stays, ["doc_id", "text_sha256"]).groupBy("text_sha256", "group_size").agg(F.max("text").alias("kept_text"))
    wide = shared.written(wide, "kept")
    met = shared.hot_join(rows, wide, "text_sha256", "doc_id", "group_size")
    return met.where("text <> kept_text").select("doc_id", "text_sha256", "text")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without any change, case and white space included; null counts as empty, and all empty
    texts form one group. The largest doc_id of a group stays. Rows without a doc_id are left out. A row that is repeated
    with its doc_id counts in group_size each time and gets a row each time (kept if its doc_id is the group's keep_id);
    an empty table gives an empty result. Other columns, whatever their names, are not read. Equality is told by SHA-256,
    length and an independent hash at every level, and the texts of every group are held against the one that stays; should
    one differ for all that, unlike texts are grouped by themselves.
    """
    marked = digests(docs)
    runs = max(LEAST, -(-shared.texts(docs).count() // RUN_ROWS))
    merged = shared.written(merge_runs(marked, runs).withColumn("n", F.col("group_size")), "merged")
    other = shared.written(unlike(docs, merged), "unlike")
    out = shared.hot_join(marked.drop("n_bytes", "check"), merged.drop("n_bytes", "check"), "text_sha256", "doc_id", "n")
    if other.head(1):
        lost = other.groupBy("text_sha256").agg(F.count("*").alias("lost"))
        own = other.groupBy("text_sha256", "text").agg(F.max("doc_id").alias("own_id"), F.count("*").alias("own_size"))
        own = other.join(own, ["text_sha256", "text"]).groupBy("doc_id", "text_sha256").agg(F.max("own_id").alias("own_id"), F.max("own_size").alias("own_size"))
        out = out.join(lost, "text_sha256", "left").join(own, ["doc_id", "text_sha256"], "left")
        out = out.withColumns({"keep_id": F.coalesce("own_id", "keep_id"), "group_size": F.coalesce("own_size", F.col("group_size") - F.coalesce("lost", F.lit(0)))})
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; rows that repeat a kept doc_id and text are dropped as well."""
    keep = exact_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(shared.table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
