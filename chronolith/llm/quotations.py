"""Quotation linking of messages. DataFrame and SQL functions only.

A line's quote level is how many '>' it begins with. Runs of lines of one level are passages. Quoted passages, and their
paragraphs, lines and sentences, are normalised and hashed and joined to the message of the conversation in which the same
piece first stood unquoted; so a paragraph that a mail program has wrapped anew, or a sentence taken out of its line, is
found as well. The message that a reply quotes at the lowest level is its parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

KEY = ["conv_id", "turn", "text_hash"]
#: Sentences of fewer words say too little of where they come from.
SENTENCE_WORDS = 3


def _normal(c: str):
    return F.trim(F.regexp_replace(F.lower(F.col(c)), r"\s+", " "))


def messages(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def passages(own: DataFrame) -> DataFrame:
    """KEY, level, run, text of each run of lines of one quote level; a run's text has its lines without the marks, joined by line ends."""
    lines = own.select("conv_id", "turn", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    marks = F.regexp_extract("line", r"^((?:[ \t]*>)*)", 1)
    lines = lines.select(*KEY, "i", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace("line", r"^(?:[ \t]*>)+[ \t]?", "").alias("line"))
    order = Window.partitionBy(*KEY).orderBy("i")  # one message a partition
    lines = lines.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int")).withColumn("run", F.sum("new").over(order))
    return lines.groupBy(*KEY, "level", "run").agg(F.expr("array_join(transform(array_sort(collect_set(struct(i, line))), x -> x.line), '\\n')").alias("text"))


def pieces_of(runs: DataFrame) -> DataFrame:
    """KEY, level, run, kind (3: the passage, 2: a paragraph, 1: a line, 0: a sentence), piece (hash of the conversation and the normalised text)."""
    paragraphs = F.split("text", r"\n[ \t\r]*\n")
    sentences = F.filter(F.flatten(F.transform(paragraphs, lambda x: F.split(x, r"(?<=[.!?])\s+"))), lambda x: F.size(F.split(F.trim(x), r"\s+")) >= SENTENCE_WORDS)
    each = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))
    every = F.concat(each(3, F.array("text")), each(2, paragraphs), each(1, F.split("text", "\n")), each(0, sentences))
    out = runs.select(*KEY, "level", "run", F.explode(every).alias("x")).select(*KEY, "level", "run", "x.*").withColumn("normal", _normal("text")).where("normal <> ''")
    return out.select(*KEY, "level", "run", "kind", F.xxhash64("conv_id", "normal").alias("piece"))


def quotations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages, links). links: KEY, level, run, source_turn of each quoted passage; source_turn is null where no earlier message of the conversation has the text."""
    runs = shared.written(passages(messages(conversations).select("conv_id", "turn", "text").distinct()), "passages")
    # Only conversations with a quote are looked into.
    quoting = shared.written(runs.where("level > 0").select("conv_id").distinct(), "quoting")
    pieces = shared.written(pieces_of(shared.semi(runs, quoting, "conv_id")), "pieces")
    # The original is where the text first stood: one row per conversation and text, however often it is said again.
    originals = pieces.where("level = 0").groupBy("piece").agg(F.min("turn").alias("source_turn"))
    quoted = pieces.where("level > 0")
    # A line quoted all over one conversation is many rows of one key: these are salted.
    sources = shared.written(quoted.groupBy("piece").agg(F.count("*").alias("n_quotes")).join(originals, "piece", "left"), "sources")
    met = shared.hot_join(quoted, sources, "piece", "turn", "n_quotes").withColumn("source_turn", F.when(F.col("source_turn") < F.col("turn"), F.col("source_turn")))
    # A whole passage tells more than a paragraph, that more than a line or a sentence; then the source of the most, then the latest.
    votes = met.groupBy(*KEY, "level", "run", "source_turn").agg(F.max("kind").alias("kind"), F.count("*").alias("n"))
    links = votes.groupBy(*KEY, "level", "run").agg(F.max(F.when(F.col("source_turn").isNotNull(), F.struct("kind", "n", "source_turn")))["source_turn"].alias("source_turn"))
    # A quoted passage without a word has no piece and no source.
    links = runs.where("level > 0").where(_normal("text") != "").select(*KEY, "level", "run").join(links, [*KEY, "level", "run"], "left")
    return runs, links


def reply_order(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, parent_turn, root_turn, depth, n_quotes, n_linked, text.

    text is the message without quoted lines and without white space at the ends. parent_turn is the message that its passages at the lowest linked level quote
    most (ties: the latest), null if none is found; root_turn and depth follow the parents up. Sorting a conversation by
    (root_turn, depth, turn) puts every reply after what it replies to. Parents are earlier turns, so there is no cycle.
    A null text is empty; rows without conv_id or turn are left out; repeated rows give a row each; of several texts at
    the same turn each has its quotes, and they count as one message to others. Nothing collects a conversation.
    """
    runs, links = quotations(conversations)
    links = shared.written(links, "links")
    found = links.where("source_turn is not null").groupBy("conv_id", "turn", "level", "source_turn").count()
    parent = found.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "count", "source_turn"))["source_turn"].alias("parent_turn"))
    parent = shared.written(parent, "parents")
    # Pointer doubling: each round doubles how far up a message sees.
    up = parent.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    while True:
        far = up.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        joined = shared.written(up.join(far, ["conv_id", "root_turn"], "left").select("conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "roots")
        up = joined.drop("moved")
        if not joined.where("moved").head(1):
            break
    own = runs.where("level = 0").groupBy(*KEY).agg(F.expr("array_join(transform(array_sort(collect_list(struct(run, text))), x -> x.text), '\\n')").alias("own"))
    counts = links.groupBy(*KEY).agg(F.count("*").alias("n_quotes"), F.count("source_turn").alias("n_linked"))
    out = messages(conversations).withColumn("text_hash", F.xxhash64("text")).drop("text")
    out = out.join(own, KEY, "left").join(counts, KEY, "left").join(parent, ["conv_id", "turn"], "left").join(up, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.trim(F.coalesce("own", F.lit("")), F.lit(" \t\r\n")).alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reply_order(shared.table(spark, sf_dir, "conversations"))
    return out.withColumn("text_sha256", F.sha2("text", 256)).drop("text")
