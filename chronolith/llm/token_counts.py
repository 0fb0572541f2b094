"""Token counts through a digest cache: only distinct texts that no stored count covers are encoded."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

CACHE_SCHEMA = "text_digest string, tokenizer string, n_tokens long"
LIMIT = 4096
_loaded: dict[str, object] = {}


def tokenizer_version(model: str) -> str:
    """Digest of the tokenizer's file: another file, another version, another set of cached counts."""
    with open(model, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encoder(model: str):
    if model not in _loaded:
        if model.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=model)
            _loaded[model] = lambda texts: [len(own.encode(x, num_threads=1)) for x in texts]
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(model)
            whole.no_truncation()
            whole.no_padding()
            _loaded[model] = lambda texts: [len(whole.encode(x, add_special_tokens=False).ids) for x in texts]
    return _loaded[model]


def _count(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("text_digest"), pa.array(count(x.as_py() for x in b.column("text")), pa.int64())], ["text_digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Content is normalised by nothing but null to empty, so that a stored count is the count of every text with the digest.
    The texts' SHA-256 and the tokenizer's version are joined to the table `cache` (Parquet, CACHE_SCHEMA, a folder for each
    tokenizer); of the digests that it lacks, one document each is encoded, and the new counts are appended as one more
    folder.
    Without `cache` a new, empty one is made in the shared folder. model: a .model file of sentencepiece or a .json of
    tokenizers, at the same path on every executor. No begin, end or added special tokens, no truncation or padding.

    An empty text has 0 tokens if the library says so; over_limit is n_tokens > limit, so a text at the limit is within.
    Repeated rows give a row each; rows without a doc_id are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared.shared_dir(spark)}/token-cache"
    version = tokenizer_version(model)
    whole = shared.texts(docs).withColumn("text_digest", F.sha2("text", 256))
    known = _stored(spark, cache, version)
    # A text that a third of all rows hold is one row after the partial aggregation; texts themselves move once, by doc_id.
    groups = shared.written(whole.groupBy("text_digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "digests")
    misses = groups.drop("n").join(known, "text_digest", "left_anti")
    todo = whole.select("doc_id", "text_digest", "text").join(misses, ["doc_id", "text_digest"], "left_semi")
    encoded = todo.select("text_digest", "text").mapInArrow(_count(model), "text_digest string, n_tokens long")
    new = encoded.groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))  # a repeated row of the same doc_id is encoded twice at most
    new.select("text_digest", "n_tokens").write.parquet(f"{cache}/tokenizer={version}/part={uuid.uuid4().hex}")
    facts = shared.written(groups.drop("doc_id").join(_stored(spark, cache, version), "text_digest"), "counts")
    own = whole.select("doc_id", "text_digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return shared.hot_join(own, facts, "text_digest", "doc_id", "n").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """text_digest and n_tokens of this tokenizer, one row per digest even if two runs have appended the same one."""
    try:
        rows = spark.read.schema("text_digest string, n_tokens long, part string").parquet(f"{cache}/tokenizer={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "text_digest string, n_tokens long")
    return rows.groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
