"""What several corpus operators share: the shared folder, reading `documents`, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which an id list may be broadcast (16 bytes each in the relation, 3 MB in all); above it, a shuffle join.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and every executor see. Only a local session without one (tests) gets its own here; on a cluster the setting must be there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/chronolith/{uuid.uuid4().hex}"


#: Where the tables that written() has made lie.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


#: Spark's own switch: a query's shuffle files go when the query ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives the loss of any executor. What was shuffled for it is given back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    _places[out] = path
    return out


def spent(*tables: DataFrame) -> None:
    """Gives the files of tables that written() made back: nothing reads these tables any more. An empty table takes their place."""
    for t in tables:
        if path := _places.pop(t, None):
            t.sparkSession.createDataFrame([], t.schema).coalesce(1).write.mode("overwrite").parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id long, text string of every row that has a doc_id; a null text is the empty one. A row without a doc_id can't be named in a result and is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts of texts()."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def semi(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` is in ids. ids must be a written table: its rows are counted, and broadcast only up to BROADCAST_ROWS."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, "left_semi")


#: Rows of a key are spread over so many salts where they are at least one in so many of all rows.
SALTS, SHARE = 64, 1000


def hot_join(rows: DataFrame, facts: DataFrame, on: str, by: str, n: str) -> DataFrame:
    """rows joined to facts (one row a key, with the number n of rows that have the key, which is dropped), spread evenly.

    Keys with a SHARE-th of all rows or more, SHARE of them at most, are broadcast, their rows dealt out by a hash of `by`
    and their facts repeated for every salt. facts must be a written table.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    hot = facts.where(F.col(n) * SHARE >= total).select(on, F.lit(True).alias("_hot"))  # SHARE rows at most
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    salts = F.when(F.col(n) * SHARE >= F.lit(total), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(facts.withColumn("_salt", F.explode(salts)).drop(n), [on, "_salt"]).drop("_salt")


def buckets_for(n_bytes: int, each: int = 4 << 20, least: int = 128) -> int:
    """How many hash buckets deal out work over n_bytes of text."""
    return max(least, -(-n_bytes // each))
