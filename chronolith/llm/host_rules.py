"""Quality rules by host: failures of rules are summed by host, their rates shrunk towards what hosts have in common, and hosts' verdicts joined back to documents.

A host with few documents says little about itself, so its rate is the mean of a beta distribution whose prior is fitted to
all hosts by moments: (failed + alpha) / (documents + alpha + beta).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, vec

#: Words in a window of which a repetition counts; a text of fewer words than LEAST_WORDS is short.
WINDOW, LEAST_WORDS = 8, 20
#: A host goes where the shrunk rate of a rule is this or more: half of what it has to offer fails.
LIMIT = 0.5
#: The rules a document can fail, over the columns of measures().
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeated": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "word_length": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 10 * n_words)",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
#: The rules that a document fails for itself, whatever its host.
BASE = ("short", "repeated")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NAMES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeats(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which of the hashes occur twice or more in their text, the first included."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    same = np.append(False, (h[1:] == h[:-1]) & (text[1:] == text[:-1]))
    out = np.zeros(len(h), bool)
    out[order] = same | np.append(same[1:], False)
    return out


def measured(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The columns of _NAMES of each text."""
    n = len(off) - 1
    if not len(raw):
        return [np.zeros(n, np.int64) for _ in _NAMES]
    h, starts, ends, woff = vec.words(raw, off, lower=False)
    n_words = np.diff(woff)
    per_text = lambda on: np.diff(np.append(0, np.cumsum(on))[off])
    begins = (raw & 0xC0) != 0x80  # a byte that begins a code point
    solid = vec.solid(raw)
    # Lines: between \n, and at the texts' ends.
    breaks = raw == 10
    line_starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], np.flatnonzero(breaks) + 1]))
    line_starts = line_starts[line_starts < len(raw)]
    line_ends = np.append(line_starts[1:], len(raw))
    line_ends = line_ends - breaks[line_ends - 1]
    upto = np.append(0, np.cumsum(solid))
    some = upto[line_ends] > upto[line_starts]
    line_starts, line_ends = line_starts[some], line_ends[some]
    line_text = np.searchsorted(off, line_starts, "right") - 1
    lines = vec.hashes(raw, line_starts, line_ends)
    n_lines = np.bincount(line_text, minlength=n)
    order = np.lexsort((lines, line_text))
    again = np.append(False, (lines[order][1:] == lines[order][:-1]) & (line_text[order][1:] == line_text[order][:-1]))[: len(lines)]
    n_dup = np.bincount(line_text[order][again], minlength=n)
    # Words in windows that occur twice or more: a window's first word opens, the word behind it closes.
    n_repeat = np.zeros(n, np.int64)
    if len(h) >= WINDOW:
        text = np.repeat(np.arange(n), n_words)
        grams = np.zeros(len(h) - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            grams = grams * vec.MULT + h[j : len(h) - WINDOW + 1 + j]
        at = np.flatnonzero(text[: len(grams)] == text[WINDOW - 1 :])
        twice = at[_repeats(vec.mix(grams[at]), text[at])]
        open_ = np.zeros(len(h) + 1, np.int64)
        np.add.at(open_, twice, 1)
        np.add.at(open_, twice + WINDOW, -1)
        n_repeat = np.diff(np.append(0, np.cumsum(np.cumsum(open_[:-1]) > 0))[woff])
    return [x.astype(np.int64) for x in (n_words, per_text(begins & solid), per_text(_SYMBOL[raw]), n_lines, n_dup, n_repeat)]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, raw, off in vec.slices(batches, 2 << 20):
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("host"), *map(pa.array, measured(raw, off))], ["doc_id", "host", *_NAMES])


def host_of(source: Column) -> Column:
    """The host of a source: of an address the part between scheme and port or path, without "www."; of another text the whole. Lower case; null for an empty one."""
    host = F.regexp_extract(F.trim(F.lower(source.cast("string"))), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?(?:www\.)?([^/:?#]*)", 1)
    return F.nullif(host, F.lit(""))


def measures(docs: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars (code points in words), n_symbols, n_lines (with a word), n_dup_lines (equal to an earlier one), n_repeat_words (in windows of WINDOW words that the text holds twice or more), and a boolean for each rule."""
    own = docs if source in docs.columns else docs.withColumn(source, F.lit(None).cast("string"))
    rows = own.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), host_of(F.col(source)).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = rows.mapInArrow(_measure, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _NAMES))
    return counted.select("*", *[F.expr(rule).alias(f"fails_{name}") for name, rule in RULES.items()])


def priors(hosts: DataFrame) -> DataFrame:
    """One row for each rule: rule, mean, strength (alpha + beta), of a table of host, n_docs and failed_<rule>.

    By moments: the mean is the share of all documents that fail; the strength follows from how much more the hosts' rates
    differ than documents at random would make them. It is null, for infinite, where they don't differ more.
    """
    n = F.col("n_docs")
    sums = hosts.agg(F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), *[F.sum(f"failed_{r}").alias(f"f_{r}") for r in RULES], *[F.sum(F.col(f"failed_{r}") * F.col(f"failed_{r}") / n).alias(f"s_{r}") for r in RULES])  # one row
    rows = sums.select("h", "n", "nn", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("f"), F.col(f"s_{r}").alias("s")) for r in RULES])))
    rows = rows.where("n > 0").withColumn("mean", F.col("f") / F.col("n"))
    chance = F.col("mean") * (1 - F.col("mean"))
    between = (F.col("s") - F.col("n") * F.col("mean") * F.col("mean")) - chance * (F.col("h") - 1)
    share = F.try_divide(between, chance * (F.col("n") - F.col("nn") / F.col("n") - (F.col("h") - 1)))
    return rows.withColumn("share", share).select("rule", "mean", F.when(F.col("share") > 0, F.greatest(1 / F.least(F.col("share"), F.lit(1.0)) - 1, F.lit(1e-3))).alias("strength"))


def verdicts(measured: DataFrame, limit: float = LIMIT) -> DataFrame:
    """One row a host: host, n_docs, worst_rule, worst_rate (the largest shrunk rate, of equal ones the rule whose name sorts first), rejected (worst_rate >= limit), each rate rounded to nine digits. Documents without a host form none."""
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), *[F.count_if(f"fails_{r}").alias(f"failed_{r}") for r in RULES])
    hosts = shared.written(hosts, "hosts")
    prior = priors(hosts).agg(*[F.max(F.when(F.col("rule") == r, F.struct("mean", "strength"))).alias(f"p_{r}") for r in RULES])  # one row

    def rate(r: str) -> Column:
        mean, strength = F.col(f"p_{r}.mean"), F.col(f"p_{r}.strength")
        return F.round(F.when(strength.isNull(), mean).otherwise((F.col(f"failed_{r}") + mean * strength) / (F.col("n_docs") + strength)), 9)

    rates = hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", F.array_sort(F.array(*[F.struct((-rate(r)).alias("less"), F.lit(r).alias("rule")) for r in RULES]))[0].alias("worst"))
    return rates.select("host", "n_docs", F.col("worst.rule").alias("worst_rule"), (-F.col("worst.less")).alias("worst_rate")).withColumn("rejected", F.col("worst_rate") >= limit)


def host_rules(docs: DataFrame, source: str = "source", limit: float = LIMIT) -> DataFrame:
    """One row per document: doc_id, the counts of measures(), base_failed, host, host_rate, kept.

    base_failed: the document itself fails a rule of BASE. kept: it doesn't, and its host isn't rejected. A document without a
    host (null or empty, or a table without that column) has no host_rate and is judged for itself alone; so are all where
    hosts' rates don't differ, as long as less than `limit` of all documents fail. A null text has no words and fails. Rows
    that repeat a doc_id count and are judged each; rows without a doc_id are left out; an empty table gives an empty
    result. Other columns, whatever their names, are not read. A host of a third of all documents is summed in every task
    first, and its verdict joined back salted.
    """
    rows = shared.written(measures(docs, source), "measures")
    hosts = shared.written(verdicts(rows, limit).select("host", F.col("worst_rate").alias("host_rate"), "rejected", F.col("n_docs").alias("n")), "verdicts")
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    own = rows.select("doc_id", "host", *counts, F.expr(" or ".join(f"fails_{r}" for r in BASE)).alias("base_failed"))
    if hosts.count() <= shared.BROADCAST_ROWS // 4:  # a host's name is longer than an id
        met = own.join(F.broadcast(hosts.drop("n")), "host", "left")
    else:
        with_host = shared.hot_join(own.where("host is not null"), hosts, "host", "doc_id", "n")
        met = with_host.unionByName(own.where("host is null"), allowMissingColumns=True)
    return met.select("doc_id", *counts, "base_failed", "host", "host_rate", (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"))


def kept_documents(docs: DataFrame, source: str = "source", limit: float = LIMIT) -> DataFrame:
    """The documents that stay, all columns."""
    keep = host_rules(docs, source, limit).where("kept").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(shared.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, nullif(regexp_extract(trim(lower(source)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?(?:www\.)?([^/:?#]*)', 1), '') AS host, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
w AS MATERIALIZED (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\t-\r]+') AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest(range(0, 8)) AS j) GROUP BY 1),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\t-\r]')),
c AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY 1),
m AS MATERIALIZED (SELECT w.doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN p USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeated, 100 * n_symbols > 10 * n_words AS symbols, n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words) AS word_length, 100 * n_dup_lines > 30 * n_lines AS lines FROM m),
u AS (SELECT host, unnest(['short', 'repeated', 'symbols', 'word_length', 'lines']) AS rule, unnest([short, repeated, symbols, word_length, lines]) AS failed FROM f WHERE host IS NOT NULL),
h AS MATERIALIZED (SELECT host, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS k FROM u GROUP BY 1, 2),
s AS (SELECT rule, count(*) AS hosts, sum(n) AS total, sum(n * n) AS nn, sum(k) / sum(n) AS mean, sum(k * k / n) AS kk FROM h GROUP BY 1),
v AS (SELECT rule, mean, (kk - total * mean * mean - mean * (1 - mean) * (hosts - 1)) / nullif(mean * (1 - mean) * (total - nn / total - (hosts - 1)), 0) AS share FROM s),
b AS (SELECT rule, mean, CASE WHEN share > 0 THEN greatest(1 / least(share, 1) - 1, 0.001) END AS strength FROM v),
x AS (SELECT host, max(round(CASE WHEN strength IS NULL THEN mean ELSE (k + mean * strength) / (n + strength) END, 9)) AS host_rate FROM h JOIN b USING (rule) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, short OR repeated AS base_failed, host, host_rate, NOT (short OR repeated) AND NOT coalesce(host_rate >= 0.5, false) AS kept FROM f LEFT JOIN x USING (host)
"""
