"""One text that is longer than the slices and flushes of every operator, beside short ones."""

import hashlib
import random

import brute
import pytest
from test_exact_and_tokens import reference_encoding
from test_models import base_scores, compare

from chronolith.llm import brown_lm, byte_bpe, decontaminate, exact_dedup, fill_middle, host_rules, licenses, line_dedup, ngram_join, quality, token_counts

P = pytest.importorskip("public_tokenizers")
PASSAGE = " ".join(f"passage{i}" for i in range(30))


def long_text(n_bytes, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    lines, size = [], 0
    while size < n_bytes:
        lines.append(" ".join(rng.choice(vocabulary) for _ in range(18)))
        size += len(lines[-1].encode()) + 1
    return "\n".join([*lines, PASSAGE, "Released under the MIT License"])


@pytest.fixture(scope="module")
def rows():
    whole = long_text(3 << 20, 1)
    return [(1, whole), (2, whole), (3, "begin " + whole), (4, "a short text of a few words"), (5, PASSAGE.upper()), (6, "passagX" + PASSAGE[7:])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def test_scores(docs, rows):
    compare(brown_lm.scores(docs).collect(), base_scores(rows))


def test_windows_at_the_end(spark, docs):
    items = spark.createDataFrame([(7, PASSAGE), (8, "nothing like it anywhere in these texts at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(docs, items).collect()}
    assert {k: got[k] for k in got if k[0] != 6} == {(i, 7): 1.0 for i in (1, 2, 3, 5)}


def test_tokens(docs, rows):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect()} == {d: len(own.encode(t)) for d, t in rows}
    enc = reference_encoding()
    got = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken")).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {d: (sha(" ".join(map(str, enc.encode_ordinary(t))).encode()), sha(t.encode())) for d, t in rows}


def test_duplicates_and_licences(docs, rows):
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (6, 1)}
    assert {(r.doc_id, r.licence) for r in licenses.scan(docs).collect()} == {(i, "MIT") for i in (1, 2, 3)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()}
    sets = {d: len(brute.shingles(t)) for d, t in rows}
    assert got == {d: (sets[d], c) for d, c in {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}.items()}


def test_lines(spark):
    """Longer than what a task gathers before it gives keys out."""
    rng = random.Random(2)
    whole = "\n".join([*(f"{rng.getrandbits(400):0100x}" for _ in range(93_000)), PASSAGE])
    first = whole.split("\n")[0]
    df = spark.createDataFrame([(1, whole), (2, PASSAGE[:-1] + "x"), (3, first + "s"), (4, "a line of its own")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_kept) for r in line_dedup.report(df).collect()}
    assert got[2] == (1, 0) and got[3] == (1, 0) and got[4] == (1, 1) and got[1][0] == whole.count("\n") + 1


def test_ratios_rules_and_parts(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(1, 7)], "doc_id long, quality int")
    got = {r.doc_id: r.log_ratio for r in quality.resample(docs, labels).collect()}
    assert set(got) == {d for d, _ in rows} and got[1] == got[2] != got[3] and got[1] != 0
    by = {r.doc_id: r for r in host_rules.host_rules(docs).collect()}
    assert by[1].n_words == len(rows[0][1].split()) and by[1].n_lines == rows[0][1].count("\n") + 1 and by[1].kept
    made = {r.doc_id: r for r in fill_middle.fill_middle(docs).collect()}
    assert made[3].n == len(rows[2][1]) and made[3].restored_sha256 == hashlib.sha256(rows[2][1].encode()).hexdigest()
