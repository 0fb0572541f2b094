"""Product codes of vectors, each part assigned to its codebook's nearest entry with annular norm pruning.

A codebook's entries are sorted by norm. The distance of a part and an entry is at least the difference of their norms, so
once some entry is at a distance d, only entries whose norms lie within d of the part's own can be nearer or as near: an
annulus, found by binary search and made narrower with each better entry. What lies in it, its edges included, is evaluated
exactly in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components at this or beyond either way would let squared distances leave 64 bits.
LARGEST = 1 << 15
#: Sums of this many parts at a time stay in 64 bits.
_ROWS = 1 << 16


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry (of equally near ones the least index) and the squared distance. Whole numbers."""
    norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
    order = np.argsort(norms, kind="stable")
    sorted_norms, own = norms[order], np.sqrt((points.astype(np.float64) ** 2).sum(1))
    rows = np.arange(len(points))

    def squared(at: np.ndarray, place: np.ndarray) -> np.ndarray:
        apart = points[at] - entries[order[place]]
        return (apart * apart).sum(1)

    # The entry whose norm is nearest gives the first distance.
    right = np.clip(np.searchsorted(sorted_norms, own), 0, len(entries) - 1)
    left = np.maximum(right - 1, 0)
    start = np.where(own - sorted_norms[left] <= sorted_norms[right] - own, left, right)
    best, index = squared(rows, start), order[start]
    # From there outwards, one entry to a side at a time, as long as it lies in the annulus of the best distance so far.
    for step in (-1, 1):
        active, place = rows, start + step
        while True:
            reach = np.sqrt(best[active].astype(np.float64)) * (1 + 1e-9) + 1e-6  # what rounding could take off is added
            low, high = np.searchsorted(sorted_norms, own[active] - reach, "left"), np.searchsorted(sorted_norms, own[active] + reach, "right")
            inside = (place >= low) & (place < high)
            active, place = active[inside], place[inside]
            if not len(active):
                break
            d, entry = squared(active, place), order[place]
            better = (d < best[active]) | ((d == best[active]) & (entry < index[active]))
            best[active[better]], index[active[better]] = d[better], entry[better]
            place = place + step
    return index, best


def _parts(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """(rows, PARTS, width) whole numbers of a batch of kept vectors."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.astype(np.float64) * SCALE).astype(np.int64).reshape(batch.num_rows, PARTS, width)


def _sums(books, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        k = book.shape[1]
        total = np.zeros((PARTS, k, width + 1), np.int64)  # the last column counts
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                x = _parts(b.slice(at, _ROWS), width)
                for p in range(PARTS):
                    index, _ = nearest(x[:, p], book[p])
                    order = np.argsort(index, kind="stable")
                    used, starts = np.unique(index[order], return_index=True)
                    total[p, used, :width] += np.add.reduceat(x[order, p], starts)
                    total[p, :, width] += np.bincount(index, minlength=k)
        part, entry = np.nonzero(total[:, :, width])
        own = total[part, entry]
        place = np.tile(np.arange(width + 1), len(part))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, width + 1), pa.int32()), pa.array(np.repeat(entry, width + 1), pa.int32()), pa.array(place, pa.int32()), pa.array(own.ravel())], ["part", "entry", "place", "total"])

    return run


def _codes(books, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        digits = np.array([f"{i:02x}" for i in range(256)])
        for b in batches:
            x = _parts(b, width)
            code, error = np.empty((b.num_rows, PARTS), np.int64), np.zeros(b.num_rows, np.int64)
            for p in range(PARTS):
                code[:, p], d = nearest(x[:, p], book[p])
                error += d
            text = ["".join(r) for r in digits[code]]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def kept_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, vector of doubles) of the rows that can be coded, and the vectors' length.

    Left out are vectors that are null, hold a null or non-finite component or one of LARGEST or more either way, or have
    another length than most have (of equally frequent lengths that divide into PARTS the largest), and rows without a vec_id.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where("vec_id is not null and size(vector) > 0").where(f"size(vector) % {PARTS} = 0 and forall(vector, x -> coalesce(abs(x) < {LARGEST}, false))")  # nan is larger than any number
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()  # a row for each length
    length = sizes["size"] if sizes else 0
    return rows.where(F.size("vector") == length), length


def first_books(kept: DataFrame, length: int) -> np.ndarray:
    """(PARTS, entries, width): the parts of the vectors with the ENTRIES smallest vec_ids, ascending; fewer where there are fewer. Of rows with one vec_id the least vector stands."""
    rows = kept.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").limit(ENTRIES).collect()  # ENTRIES rows
    flat = np.array([r["vector"] for r in sorted(rows, key=lambda r: r["vec_id"])], np.float64).reshape(len(rows), length)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(rows), PARTS, length // PARTS).transpose(1, 0, 2)


def fit(kept: DataFrame, length: int, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds. A task sums its parts by entry, so what moves is PARTS * ENTRIES * (width + 1) numbers a task at most, and the driver gets as many in all."""
    spark, books, width = kept.sparkSession, first_books(kept, length), length // PARTS
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        sums = kept.select("vector").mapInArrow(_sums(sent, width), "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
        total = np.zeros((*books.shape[:2], width + 1), np.int64)
        for r in sums.collect():
            total[r["part"], r["entry"], r["place"]] = r["total"]
        count = total[:, :, width:]
        books = np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)
        sent.unpersist()
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error), written, and the codebooks (PARTS, entries, width) in whole numbers.

    Components are whole numbers floor(SCALE x). See kept_vectors() for which rows have a code, first_books() and fit() for
    the codebooks. code: an index of two hex digits for each part. error: the squared distances summed over the parts. Rows
    that repeat a vec_id are coded each; an empty table gives an empty result. Other columns are not read.
    """
    kept, length = kept_vectors(embeddings)
    if not length:
        return shared.written(embeddings.sparkSession.createDataFrame([], "vec_id long, label string, code string, error long"), "codes"), np.zeros((PARTS, 0, 0), np.int64)
    books = fit(kept, length, rounds)
    coded = kept.mapInArrow(_codes(embeddings.sparkSession.sparkContext.broadcast(books), length // PARTS), "vec_id long, label string, code string, error long")
    return shared.written(coded, "codes"), books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and the vector that a code stands for, as doubles."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for entry in part]) for part in books.tolist()])
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.get(F.get(flat, p), F.conv(F.substring(F.col("code"), 2 * p + 1, F.lit(2)), 16, 10).cast("int")))
    return codes.select("vec_id", F.flatten(parts).alias("vector"))


def coded_errors(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (the error summed over equal labels, nulls together), codebooks_sha256."""
    codes, books = vector_codes(embeddings, rounds)
    named = codes.withColumn("label", F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("")))
    facts = shared.written(named.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    out = shared.hot_join(named, facts, "label", "vec_id", "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_errors(shared.table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds one after the other, over a row for each component."""
    near = "a{0} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM (SELECT vec_id, part, entry, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{0} c USING (part, pos) GROUP BY 1, 2, 3) GROUP BY 1, 2)"
    step = "c{1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m, x) AS x FROM c{0} LEFT JOIN (SELECT part, entry, pos, CAST(floor(sum(v.x)::DOUBLE / count(*)) AS BIGINT) AS m FROM v JOIN a{0} USING (vec_id, part) GROUP BY 1, 2, 3) USING (part, entry, pos))"
    rounds = ",\n".join(f"{near.format(i)},\n{step.format(i, i + 1)}" for i in range(ROUNDS))
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS width FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE (x IS NULL OR NOT isfinite(x)) AND vec_id IS NOT NULL)),
v AS MATERIALIZED (SELECT vec_id, (i // width) AS part, i % width AS pos, CAST(floor({SCALE} * embedding[i + 1]::DOUBLE) AS BIGINT) AS x FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM k)),
c0 AS MATERIALIZED (SELECT part, entry, pos, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k) USING (vec_id) WHERE entry < {ENTRIES}),
{rounds},
{near.format(ROUNDS)},
e AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1),
s AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), s
"""


ORACLE = _oracle()
