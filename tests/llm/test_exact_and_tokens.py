import hashlib

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from chronolith.llm import byte_bpe, exact_dedup, licenses, shared, token_counts

P = pytest.importorskip("public_tokenizers")
SMALL = brute.SMALL
NASTY = [None, "", " ", "a", "A a", "it's they're we'll 's 'll 'x I'd", "  two  blanks\t\n\n x ", "naïve ÉCOLE 日本語 ½ ² ٣", "<|endoftext|> </s> <s>", "x" * 3000, "a b " * 2000, "''' 're re  　　x", "\u0000�🎉🎉👨‍👩‍👧", "don't\n\n\n  end   ", "1234567 12a b34", "'", "'r", " '", "'s", "x's's's"]


@pytest.fixture(scope="module")
def nasty(spark):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(3, "a"), (None, "lost"), (50, "A a"), (51, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("node", "bucket", "text_sha256", "n_tokens", "comp", "keep_id", "run", "count")})


def same(spark, df, sql):
    names = sorted(df.columns)
    for t in ("documents", "conversations"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = duckdb.sql(sql)
    assert sorted(want.columns) == names
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())


def test_exact_matches_sql(spark):
    same(spark, exact_dedup.query(spark, SMALL), exact_dedup.ORACLE)


def test_exact_edges(spark, nasty):
    got = exact_dedup.exact_duplicates(nasty).collect()
    assert len(got) == len(NASTY) + 3  # the row without an id is left out
    by = {r.doc_id: r for r in got}
    assert {by[i].keep_id for i in (0, 1, 51)} == {51} and by[51].kept and not by[0].kept and by[0].group_size == 3
    assert by[4].keep_id == 50 and by[3].group_size == 2 and sum(r.doc_id == 3 and r.kept for r in got) == 2
    assert by[1].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_duplicates(nasty.limit(0)).count() == 0
    kept = exact_dedup.deduplicated(nasty)
    assert kept.columns == nasty.columns and kept.where("doc_id = 3").count() == 1


def test_tree_is_the_same_for_any_fan_in(spark, nasty):
    marked = exact_dedup.digests(nasty)
    assert exact_dedup.unlike(nasty, shared.written(exact_dedup.merge_runs(marked, 4))).count() == 0
    trees = [sorted(map(tuple, exact_dedup.merge_runs(marked, runs, fan).collect())) for runs, fan in ((1, 2), (64, 2), (64, 4), (7, 3))]
    assert all(t == trees[0] for t in trees)


def test_runs_are_sorted_partitions(spark, nasty):
    """A sort for every round is in the optimised plan, and no exchange but the rounds' own comes between; a partition holds whole runs, in order."""
    merged = exact_dedup.merge_runs(exact_dedup.digests(nasty), 64)
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Sort [") == 3
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 4  # three rounds, and the first sums
    parts = {}
    for r in merged.select(F.spark_partition_id().alias("p"), "*").collect():
        parts.setdefault(r.p, []).append((int(r.text_sha256[:12], 16) % 64, r.text_sha256))
    owners = [{run for run, _ in own} for own in parts.values()]
    assert sum(map(len, owners)) == len(set.union(*owners)) and all(own == sorted(own) for own in parts.values())


def test_texts_that_only_share_their_digests(spark, monkeypatch):
    """With a digest that says nothing, the texts themselves decide."""
    rows = [(i, t) for i, t in enumerate(["a", "b", "a", "b", "b", "c", None])] + [(None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sha2 = F.sha2

    def weak(c, bits):
        return sha2(F.when(F.lit(True), F.lit("x")), bits)

    monkeypatch.setattr(exact_dedup, "digests", lambda d: shared.texts(d).select("doc_id", weak("text", 256).alias("text_sha256"), F.lit(1).alias("n_bytes"), F.lit(1).cast("long").alias("check")))
    monkeypatch.setattr(exact_dedup.F, "sha2", weak)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()}
    assert got == {0: (2, 2, False), 1: (4, 3, False), 2: (2, 2, True), 3: (4, 3, False), 4: (4, 3, True), 5: (5, 1, True), 6: (6, 1, True)}


def test_token_counts(spark, nasty, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    cache = f"file://{tmp_path}/cache"
    got = token_counts.token_counts(nasty, P.path("piece_bpe_32k.model"), cache)
    want = sorted((i, len((t or "").encode()), n := len(own.encode(t or "")), n > 4096) for i, t in [*enumerate(NASTY), (3, "a"), (50, "A a"), (51, None)])
    assert sorted(map(tuple, got.collect())) == want
    stored = spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache)
    before = stored.count()
    assert before == len({t or "" for t in NASTY})  # each distinct text once
    assert sorted(map(tuple, token_counts.token_counts(nasty, P.path("piece_bpe_32k.model"), cache).collect())) == want
    assert spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).count() == before  # nothing was encoded again
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(nasty, P.path("byte_bpe_50k.json"), cache).collect()}
    assert all(got[i] == len(other.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(NASTY))
    assert token_counts.token_counts(nasty.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_token_counts_of_the_table(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = sorted((d, len((t or "").encode()), n := len(own.encode(t or "")), n > 4096) for d, t in brute.table("documents", "doc_id, text"))
    assert sorted(map(tuple, token_counts.query(spark, SMALL).collect())) == want


def reference_encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_like_tiktoken(spark, nasty):
    enc, path = reference_encoding(), P.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(nasty, path).collect()
    assert len(encoded) == len(NASTY) + 3
    for r in encoded:
        t = (NASTY + [None] * 30 + ["A a", None])[r.doc_id] if r.doc_id < 50 else ("A a" if r.doc_id == 50 else "")
        assert r.ids == enc.encode_ordinary(t or ""), repr(t)
        assert r.offsets[-1] == len((t or "").encode()) and r.offsets == sorted(set(r.offsets))
    decoded = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(byte_bpe.encode(nasty, path), path).collect()}
    assert all(decoded[i] == (t or "").encode() for i, t in enumerate(NASTY))


def test_byte_bpe_of_the_table(spark):
    enc = reference_encoding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in brute.table("documents", "doc_id, text"):
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, byte_bpe.query(spark, SMALL).collect())) == sorted(want)


def test_licenses(spark):
    same(spark, licenses.query(spark, SMALL), licenses.ORACLE)
    rows = [
        (1, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
        (2, "Nothing of the kind. Released under something else"),
        (3, None),
        (4, "you may not use this file except in compliance with the License"),
        (5, "Hello.\nreleased under the  MIT license.\nThis work is licensed under the GNU General Public License, version 3."),
        (5, "Released under the MIT License"),
        (None, "Released under the MIT License"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sentence": F.lit(1), "at": F.lit(2), "licence": F.lit("x")})
    got = {(r.doc_id, r.licence): r.rule for r in licenses.scan(docs).collect()}
    assert got == {(1, "Apache-2.0"): 0, (5, "MIT"): 4, (5, "GPL-3.0-only"): 8}
    assert licenses.scan(docs.limit(0)).count() == 0
