"""Fill-in-the-middle documents: a text is cut into units, and its middle moved behind prefix and suffix.

Runs in a pandas UDF over Arrow batches: finditer of the regex library collects where each unit ends in a compact array,
two look-ups there give the slices, hashlib gives the numbers that a document is cut by, and the digests.
"""

from __future__ import annotations

import hashlib
from array import array
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The marks before the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit is a code point. Any pattern that doesn't match the empty string can be used, such as words or lines.
UNIT = r"(?s:.)"
#: Of a hundred documents so many stay plain; of the others so many are written suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
_end = methodcaller("end")


def unit_ends(unit: regex.Pattern, text: str) -> array:
    """Where each unit ends. What lies between two matches belongs to the unit after it, and what follows the last is one more."""
    ends = array("I", map(_end, unit.finditer(text, concurrent=False)))
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return ends


def numbers(seed: str, doc_id: int) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(unit: regex.Pattern, seed: str, doc_id: int, text: str, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and the text in that form."""
    ends = unit_ends(unit, text)
    n = len(ends)
    h1, h2, h3, h4 = numbers(seed, doc_id)
    if not text or h3 % 100 >= 100 - plain or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    a, b = (ends[at - 1] if at else 0 for at in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text of an output. No part holds a mark, so the first mark after a part's start ends it."""
    if form == "plain":
        return output
    second = output.index(SUFFIX if form == "psm" else PREFIX, 3)
    third = output.index(MIDDLE, second + 3)
    first, other, middle = output[3:second], output[second + 3 : third], output[third + 3 :]
    return first + middle + other if form == "psm" else other + middle + first


_sha256 = lambda text: hashlib.sha256(text.encode()).hexdigest()
MADE = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def fill_middle(docs: DataFrame, seed: str = "1", unit: str = UNIT, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output (the text in that form), output_sha256, restored_sha256 (of the text rebuilt from output and form).

    A document's form and cuts follow from seed and doc_id alone, so rows that repeat a doc_id are cut alike and a task
    that runs again gives the same. A null text is empty; an empty one, and one that holds a mark already, stays plain.
    A part may be empty. Texts are never cut off, whatever their length. Rows without a doc_id are left out; an empty
    table gives an empty result. Other columns, whatever their names, are not read.
    """
    pattern = regex.compile(unit)
    if pattern.fullmatch(""):
        raise ValueError("the unit's pattern matches the empty string")

    @F.pandas_udf(MADE)
    def made(doc_id: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for i, t in zip(doc_id, text):
            n, form, before, inside, output = cut(pattern, seed, i, t, plain, suffix_first)
            rows.append((n, form, before, inside, output, _sha256(output), _sha256(rebuilt(output, form))))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return shared.texts(docs).select("doc_id", made("doc_id", "text").alias("made")).select("doc_id", "made.*")


def restored(output: Column, form: Column) -> Column:
    """The text of an output column, by the form beside it; null where either is."""

    @F.pandas_udf("string")
    def texts(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else rebuilt(o, f) for o, f in zip(output, form)], dtype=object)

    return texts(output, form)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle(shared.table(spark, sf_dir, "documents")).drop("output")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
