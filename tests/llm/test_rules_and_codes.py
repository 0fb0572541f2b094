import hashlib
import math
import re
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from chronolith.llm import fill_middle, host_rules, vector_codes

SMALL = brute.SMALL
NASTY = [None, "", " ", "a", "<P>x", "x<S", "a <M> b", "日本語 🎉🎉 é", "\u0000\n\t", "ab " * 50, "🎉" * 70_000, "one two three four five six seven eight " * 20_000]


def same(df, sql, *names_of):
    for t in names_of:
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = duckdb.sql(sql)
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.select(names).collect()), key=key) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall(), key=key)


def test_tables_match_sql(spark):
    same(fill_middle.query(spark, SMALL), fill_middle.ORACLE, "documents")
    same(host_rules.query(spark, SMALL), host_rules.ORACLE, "documents")
    same(vector_codes.query(spark, SMALL), vector_codes.ORACLE, "embeddings")


@pytest.fixture(scope="module")
def nasty(spark):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(3, "a"), (7, "other"), (None, "lost")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(5) for c in ("n", "form", "output", "host", "made", "kept", "label")})


def fim(doc_id, text):
    """As the contract says it, in plain Python."""
    t = text or ""
    h = [int(hashlib.sha256(b"1:%d" % doc_id).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return doc_id, n, "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


def test_fill_middle(spark, nasty):
    got = fill_middle.fill_middle(nasty).collect()
    rows = [*enumerate(NASTY), (3, "a"), (7, "other")]
    key = lambda r: (r[0], r[5])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((fim(*r) for r in rows), key=key)
    texts = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.restored_sha256) for r in got) == texts
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got)
    back = fill_middle.fill_middle(nasty).select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t or "") for i, t in rows)
    assert fill_middle.fill_middle(nasty.limit(0)).count() == 0


def test_fill_middle_shares_and_units(spark):
    rows = [(i, f"doc {i} has a few words") for i in range(4000)]
    got = fill_middle.fill_middle(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("form").count().collect()
    share = {r["form"]: r["count"] / 4000 for r in got}
    assert abs(share["plain"] - 0.1) < 0.02 and abs(share["spm"] - 0.18) < 0.02
    words = regex.compile(r"\S+\s*")
    assert list(fill_middle.unit_ends(words, "  ab c  d ")) == [5, 8, 10]
    assert list(fill_middle.unit_ends(regex.compile("b"), "abca")) == [2, 4]
    for i in range(50):
        n, form, before, inside, output = fill_middle.cut(words, "7", i, "ab <x> c  <P d <M", plain=0)
        assert form != "plain" and fill_middle.rebuilt(output, form) == "ab <x> c  <P d <M"
    with pytest.raises(ValueError):
        fill_middle.fill_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit="x*")
    # Parts that end like the start of a mark.
    for cut in range(12):
        text = "a<b<P<S<M>c<"
        p, m, s = text[:cut], text[cut : cut + 2], text[cut + 2 :]
        if not any(x in text for x in ("<P>", "<S>", "<M>")):
            assert fill_middle.rebuilt(f"<P>{p}<S>{s}<M>{m}", "psm") == text == fill_middle.rebuilt(f"<S>{s}<P>{p}<M>{m}", "spm")


def plain_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(inside)


def test_measures(spark, nasty):
    more = ["A a\nA a\n\na A\n A a", "x\n\nx\n", "\n", "# $ %% <b> &amp; |", "a b c d e f g h a b c d e f g h", "A b c d e f g h a b c d e f g h", "w " * 9, "u v\r\nu v\r\n", "é é\u0085x", "line\n" * 200_000]
    rows = [*enumerate(NASTY + more), (3, "a"), (7, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(5) for c in ("n_words", "rejected", "host", "kept")}).repartition(2)
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in host_rules.host_rules(df).collect())
    assert got == sorted((i, *plain_measures(t)) for i, t in rows)
    by = {r.doc_id: r for r in host_rules.host_rules(df).collect()}
    assert all(r.host is None and r.host_rate is None and r.kept == (not r.base_failed) for r in by.values())
    assert host_rules.host_rules(df.limit(0)).count() == 0
    assert host_rules.kept_documents(nasty).columns == nasty.columns


GOOD = " ".join(f"word{i}" for i in range(40))
SPAM = " ".join(f"$$$ word{i} ###" for i in range(20))


def test_hosts_are_judged_by_shrunk_rates(spark):
    """A host of spam goes with its good documents; one spam document of a host of one doesn't condemn it; hosts of addresses."""
    rows = [(i, f"http://www.Spam.example:80/{i}", SPAM if i % 10 else GOOD) for i in range(100)]
    rows += [(1000 + i, f"https://user@host{i % 30}.example/x?y", GOOD if i % 50 else SPAM) for i in range(900)]
    rows += [(5000, "tiny.example", SPAM), (5001, "tiny.example", GOOD), (5002, None, GOOD), (5003, "", SPAM), (5004, "host1.example", "short text"), (None, "host1.example", GOOD)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in host_rules.host_rules(docs).collect()}
    assert got[0].host == "spam.example" and got[1001].host == "host1.example" and got[5002].host is None
    assert not any(got[i].kept for i in range(100)) and all(got[1000 + i].kept for i in range(900))
    assert got[5002].kept and got[5003].kept and not got[5004].kept and got[5004].base_failed
    # By hand: the prior by moments, of the rule that decides.
    hosts = Counter(got[i].host for i in got if got[i].host)
    failed = Counter(got[i].host for i in got if got[i].host and 100 * got[i].n_symbols > 10 * got[i].n_words)
    n, k = sum(hosts.values()), len(hosts)
    p = sum(failed.values()) / n
    between = sum(failed[h] ** 2 / m for h, m in hosts.items()) - n * p * p - p * (1 - p) * (k - 1)
    share = between / (p * (1 - p) * (n - sum(m * m for m in hosts.values()) / n - (k - 1)))
    strength = 1 / share - 1
    want = (failed["spam.example"] + p * strength) / (hosts["spam.example"] + strength)
    assert math.isclose(got[0].host_rate, want, abs_tol=1e-8) and got[0].host_rate < 0.9
    # Two of the same: the rate of all, and the way for very many hosts.
    before = host_rules.shared.BROADCAST_ROWS
    host_rules.shared.BROADCAST_ROWS = 0
    try:
        assert {r.doc_id: r for r in host_rules.host_rules(docs).collect()} == got
    finally:
        host_rules.shared.BROADCAST_ROWS = before


def test_nearest_is_every_pair():
    rng = np.random.default_rng(5)
    for width, spread in ((1, 3), (2, 4), (8, 100), (8, 1 << 27)):
        entries = rng.integers(-spread, spread, (16, width))
        entries[7] = entries[3]
        entries[9] = -entries[2]
        points = np.concatenate([rng.integers(-spread, spread, (2000, width)), entries, np.zeros((1, width), np.int64), (entries[1:] + entries[:-1]) // 2])
        d = ((points[:, None] - entries[None]) ** 2).sum(2)
        index, best = vector_codes.nearest(points, entries)
        assert (best == d.min(1)).all() and (index == d.argmin(1)).all()


def plain_codes(rows):
    """(vec_id -> (code, error)) and the books, one vector at a time."""
    x = {i: np.floor(np.array(v, np.float64) * 4096).astype(int).reshape(8, -1) for i, v in rows}
    books = [[x[i][p].tolist() for i in sorted(x)[:16]] for p in range(8)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(books[p]))
    for _ in range(6):
        for p in range(8):
            own = [[] for _ in books[p]]
            for i in x:
                own[near(x[i][p].tolist(), p)[1]].append(x[i][p])
            books[p] = [(np.sum(o, 0) // len(o)).tolist() if o else e for o, e in zip(own, books[p])]
    return {i: ("".join(f"{near(v[p].tolist(), p)[1]:02x}" for p in range(8)), sum(near(v[p].tolist(), p)[0] for p in range(8))) for i, v in x.items()}, books


def test_codes_like_plain_python(spark):
    rng = np.random.default_rng(2)
    rows = [(i * 7 % 211, rng.normal(0, 1, 16).round(2).tolist(), i % 3 or None) for i in range(60)]
    rows += [(900, [0.5] * 16, 1), (901, [0.5] * 16, 1)]
    bad = [(1000, None, 1), (1001, [None] + [0.0] * 15, 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] + [0.0] * 15, None), (1004, [], 1), (1005, [1.0] * 24, 1), (1006, [1.0] * 9, 1), (1007, [4e4] * 16, 1), (None, [0.0] * 16, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("vector", "code", "n", "part")}).repartition(5)
    want, books = plain_codes([r[:2] for r in rows])
    got = {r.vec_id: r for r in vector_codes.coded_errors(df).collect()}
    assert {i: (r.code, r.error) for i, r in got.items()} == want
    by_label = Counter()
    for i, _, label in rows:
        by_label[label] += want[i][1]
    assert all(got[i].label_error == by_label[label] for i, _, label in rows)
    flat = ",".join(str(x) for part in books for e in part for x in e)
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(flat.encode()).hexdigest()}
    codes, made = vector_codes.vector_codes(df)
    back = {r.vec_id: r.vector for r in vector_codes.decoded(codes, made).collect()}
    for i, (code, error) in want.items():
        whole = [x for p in range(8) for x in books[p][int(code[2 * p : 2 * p + 2], 16)]]
        assert np.allclose(np.array(back[i]) * 4096, whole)
        assert len(got) == len(rows)


def test_codes_edges(spark):
    one = [(5, [float(i) for i in range(8)], None), (5, [float(i) for i in range(8)], None), (2, [9.0] * 8, None)]
    df = spark.createDataFrame(one, "vec_id long, embedding array<float>, label int")
    got = vector_codes.coded_errors(df).collect()
    assert len(got) == 3 and all(r.error == 0 and r.label_error == 0 for r in got)
    assert vector_codes.coded_errors(df.limit(0)).count() == 0
