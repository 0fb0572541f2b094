import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import decontaminate, line_dedup, links, ngram_join, quotations

SMALL = brute.SMALL
CLASH = ("node", "cell", "comp", "first", "keep", "line_no", "kept", "items", "windows", "h", "n_words", "rep", "fingerprint")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})


def varied(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_jaccard_of_the_table(spark):
    rows = brute.table("documents", "doc_id, text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.query(spark, SMALL).collect()}
    assert got == brute.jaccard_components(rows)


def test_jaccard_edges_and_hot_groups(spark):
    base = varied(40, 1)
    rows = [(i, " ".join(base[:j] + [f"x{i}"] + base[j:])) for i, j in zip(range(100, 140), range(40))]  # a large group of near copies
    rows += [(200 + i, " ".join(base)) for i in range(30)] + [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a B"), (6, "a b c"), (None, "a b"), (6, "a b c")]
    rows += [(300 + i, " ".join(base[:5] + varied(30, 50 + i))) for i in range(20)]  # a common passage, no links
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs_of(spark, rows)).collect())
    want = brute.jaccard_components([r for r in rows if r[0] is not None])
    assert got == sorted((d, *want[d]) for d, _ in rows if d is not None)
    one = ngram_join.one_of_each(docs_of(spark, rows))
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in want.values()}) and one.columns == docs_of(spark, rows).columns
    assert ngram_join.similar_documents(docs_of(spark, rows).limit(0)).count() == 0


def test_jaccard_in_tiles_and_row_by_row(spark, monkeypatch):
    """Large cells go by pivot and tiles, oversize buckets row by row, with the same result."""
    monkeypatch.setattr(links, "TILE", 4)
    monkeypatch.setattr(links, "MOST", 3)
    rng, base = random.Random(4), varied(60, 2)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(60)] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:12] + varied(48, 70 + i))) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs_of(spark, rows)).collect()}
    assert got == brute.jaccard_components(rows)
    lines = [(d, t[: 200 + 20 * (d % 5)]) for d, t in rows]
    keep, _ = brute.kept_lines(lines)
    assert {(r.doc_id, r.line_no) for r in line_dedup.fuzzy_lines(docs_of(spark, lines)).where("kept").collect()} == keep


def test_lines(spark):
    rows = [(d, t) for d, t in brute.table("documents", "doc_id, text")]
    keep, every = brute.kept_lines(rows)
    got = line_dedup.fuzzy_lines(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.line_no) for r in got} == every
    assert {(r.doc_id, r.line_no) for r in got if r.kept} == keep
    assert sorted((r.doc_id, r.text) for r in line_dedup.without_repeated_lines(docs_of(spark, rows)).select("doc_id", "text").collect()) == sorted(brute.without_lines(rows))


def test_line_edges(spark):
    long = " ".join(varied(60, 3))
    rows = [(1, "Same  line\nother\n\nsame line"), (2, "SAME LINE"), (3, None), (4, ""), (5, long), (6, long[:-1] + "x"), (None, "same line"), (7, "other\n\n"), (7, "other\n\n")]
    keep, every = brute.kept_lines([r for r in rows if r[0] is not None])
    got = line_dedup.fuzzy_lines(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.line_no) for r in got if r.kept} == keep == {(1, 0), (1, 1), (5, 0)} | ({(6, 0)} & keep)
    out = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs_of(spark, rows)).where("doc_id is not null").collect()}
    assert out[1] == "Same  line\nother\n" and 2 not in out and out[3] is None and out[4] == ""
    report = line_dedup.report(docs_of(spark, rows))
    assert report.count() == 8 and report.where("doc_id = 1").first()[1:3] == (3, 2)
    assert line_dedup.report(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("a,b", [("", ""), ("a", ""), ("kitten", "sitting"), ("abcdef", "azced"), ("x" * 50, "x" * 49 + "y"), ("ab" * 40, "ba" * 40)])
def test_edit_distance(a, b):
    d = brute.distance(a, b)
    assert line_dedup.edit_distance(a, b, d + 9) == line_dedup.edit_distance(a, b, d) == d
    assert d == 0 or line_dedup.edit_distance(a, b, d - 1) == d


def test_bounds_of_the_distance():
    rng = random.Random(5)
    for t in range(400):
        letters = "ab" if t % 2 else "abcdefgh \u00e9"
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
        b = list(a)
        for _ in range(rng.randrange(25)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        b = "".join(b)[rng.randrange(5) :]
        d = brute.distance(a, b)
        assert all(line_dedup.edit_distance(a, b, most) == min(d, most + 1) for most in {0, d // 2, max(d - 1, 0), d, d + 5})
        x, y = line_dedup.profiles([a, b]).astype(int)
        assert np.abs(x - y).sum() <= 6 * d


def test_benchmark_of_the_table(spark):
    rows, items = brute.table("documents", "doc_id, text"), brute.table("benchmark", "item_id, text")
    got = {(r.doc_id, r.item_id) for r in decontaminate.query(spark, SMALL).collect()}
    assert got == brute.contaminated(rows, items)


def test_benchmark_blocks_meet_within_the_radius(spark):
    """Any two fingerprints within RADIUS share a key of the index, also where the bits are dealt evenly over the blocks."""
    rng, rows = np.random.default_rng(3), []
    per, bits = decontaminate.PROBES + 1, decontaminate.BLOCK_BITS
    for k in range(200):
        a = rng.integers(0, 2, 128)
        if k % 2:
            flip = rng.choice(128, rng.integers(0, decontaminate.RADIUS + 1), replace=False)
        else:  # all blocks but one at the limit of what misses
            flip = np.concatenate([b * bits + rng.choice(bits, per - (b == k // 2 % 8), replace=False) for b in range(decontaminate.BLOCKS)])
        b = a.copy()
        b[flip] ^= 1
        rows.append(tuple([int(np.packbits(x[i : i + 64], bitorder="little").view(np.int64)[0]) for i in (0, 64)] for x in (a, b)))
    df = spark.createDataFrame(rows, "p array<long>, q array<long>")
    met = df.where(f"arrays_overlap({decontaminate._blocks('p')}, {decontaminate._blocks('q', decontaminate.PROBES)})")
    assert met.count() == 200


def test_benchmark_recall_near_the_limit(spark):
    """Items with words changed at random places, down to a similarity of 0.75: at least 0.97 of what brute force finds, and nothing else."""
    rng, items, rows = random.Random(5), [], []
    for i in range(40):
        item = varied(rng.randint(20, 80), 1000 + i)
        items.append((i, " ".join(item)))
        for k in range(3):
            own = list(item)
            for at in rng.sample(range(len(own)), max(1, k * len(own) // 40)):
                own[at] = f"changed{i}x{k}"
            rows.append((i * 3 + k, " ".join(varied(rng.randint(0, 60), 2000 + i * 3 + k) + own + varied(30, 3000 + i * 3 + k))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs_of(spark, rows), bench).collect()}
    want = brute.contaminated(rows, items)
    assert len(want) > 50 and got <= want and len(got) >= 0.97 * len(want)


def test_benchmark_edges(spark):
    item = varied(40, 7)
    edited = [*item[:20], "edited", *item[21:]]
    rows = [
        (1, " ".join(varied(200, 8) + item + varied(100, 9))),
        (2, " ".join(varied(10, 10) + edited)),
        (3, " ".join(item[:25])),
        (4, None),
        (5, ""),
        (6, ", ".join(item).upper()),
        (7, " ".join(item * 30)),
        (8, " ".join(varied(300, 11))),
        (1, " ".join(varied(200, 8) + item + varied(100, 9))),
        (None, " ".join(item)),
        (11, " ".join(item[:-1])),  # shorter than the item
        (12, " ".join(varied(80, 21) + item[20:] + item[:20] + varied(80, 22))),  # its halves the other way round
        (13, "Something TOO, short for a shingle"),
        (14, "too"),
    ]
    items = [(1, " ".join(item)), (2, "too short"), (3, None), (None, "a b c d e f g h"), (4, " ".join(item)), (5, "rep " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "at": F.lit(2)})
    got = decontaminate.matches(docs_of(spark, rows), bench).collect()
    want = brute.contaminated([r for r in rows if r[0] is not None], [r for r in items if r[0] is not None])
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {d for d, _ in want} == {1, 2, 6, 7, 11, 12, 13}
    assert sorted({r.doc_id for r in decontaminate.clean_documents(docs_of(spark, rows), bench).where("doc_id is not null").collect()}) == [3, 4, 5, 8, 14]
    assert decontaminate.matches(docs_of(spark, rows).limit(0), bench).count() == 0
    assert decontaminate.matches(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_quotations(spark):
    rows = [
        (1, 0, "user", "How do I read it?\nThanks in advance."),
        (1, 1, "bot", "> How do I  read it?\nWith the reader."),
        (1, 2, "user", "> > how do i read it?\n> With the reader.\nIt fails."),
        (1, 3, "bot", "> It fails.\n> Never said.\nShow me."),
        (1, 4, "user", None),
        (2, 0, "user", "> With the reader.\nquoted from elsewhere"),
        (2, 1, None, ""),
        (None, 1, "user", "x"),
        (3, 0, "user", ">>> deep\n>\n\nplain"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"level": F.lit(1), "run": F.lit(1), "hash": F.lit(1)})
    got = {(r.conv_id, r.turn): r for r in quotations.reply_order(df).collect()}
    assert len(got) == 8
    assert [got[1, t].parent_turn for t in range(5)] == [None, 0, 1, 2, None]
    assert [got[1, t].depth for t in range(5)] == [0, 1, 2, 3, 0] and [got[1, t].root_turn for t in range(5)] == [0, 0, 0, 0, 4]
    assert got[1, 2].text == "It fails." and got[1, 2].n_quotes == 2 and got[1, 2].n_linked == 2
    assert got[2, 0].parent_turn is None and got[2, 0].n_quotes == 1 and got[2, 0].n_linked == 0 and got[3, 0].text == "plain"
    assert quotations.reply_order(df.limit(0)).count() == 0
    assert quotations.query(spark, SMALL).count() == len(brute.table("conversations", "conv_id"))
