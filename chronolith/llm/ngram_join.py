"""N-gram Jaccard join by a count-vector R-tree.

A document's shingles are hashed into groups; the counts per group are a point, and for two documents the sum of the
smaller coordinates bounds their overlap from above. A link needs an overlap of at least T = 75 (|A| + |B|) / 175.

The root of the tree deals the space out. Over fine groups (one for each shingle hash) the bound says that two linked
points share an occupied coordinate among the first |A| - 0.75 |A| + 1 of each in any fixed order of the coordinates, so
a point belongs to the cells of these coordinates and no linked pair is apart. The order is by frequency, the rarest
first, from a sketch of all shingles. Below the root, a cell's points over GROUPS coarse groups are packed by
sort-tile-recursive loading into leaves with upper corners, which are searched with the bound, leaf by leaf and then point by point.
What survives is verified on the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import links, pivots, shared, vec
from .vec import mix

WORDS, NUMER, DENOM = 5, 75, 100
GROUPS, LEAF = 256, 16


def shingle_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows and their sorted sets of shingle hashes."""
    for rows, raw, off in vec.slices(batches, 2 << 20):
        h, _, _, woff = vec.words(raw, off)
        s, soff = vec.shingles(h, woff, k)
        yield rows, [np.unique(s[a:b]) for a, b in zip(soff[:-1], soff[1:])]


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _slot(s: np.ndarray, size: int) -> np.ndarray:
    return (s & np.uint64(size - 1)).astype(np.int64)


def _frequencies(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        for _, raw, off in vec.slices(batches, 2 << 20):
            h, _, _, woff = vec.words(raw, off)
            np.add.at(counts, _slot(vec.shingles(h, woff, k)[0], size), 1)
        yield links.sketch_rows(counts, TaskContext.get().partitionId())

    return run


def prefix_size(n: int, numer: int, denom: int) -> int:
    """How many coordinates of n a point must show: an overlap with any partner is at least ceil(numer n / denom)."""
    return n + (-n * numer // denom) + 1 if n else 0


def vector(s: np.ndarray) -> bytes:
    """Counts of the shingles by group, one byte each; 255 stands for any larger count, and is read as one that no bound is lowered by."""
    return np.minimum(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8).tobytes()


def _entries(k: int, numer: int, denom: int, buckets: int, scale):
    """Per document its node and set size; per bucket the packed prefix coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = scale.value
        seen: set[int] = set()
        for rows, sets in shingle_sets(batches, k):
            node, size, keys, nodes, sizes = [], [], [], [], []
            for s in sets:
                size.append(len(s))
                if not len(s):
                    node.append(None)
                    continue
                own = node_of(s)
                node.append(own)
                if own in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(own)
                often = order_of[_slot(s, len(order_of))]
                p = prefix_size(len(s), numer, denom)
                # Equal frequencies go by hash: the first p by (often, hash), as s is sorted.
                if p < len(s):
                    most = np.partition(often, p - 1)[p - 1]
                    below, equal = np.flatnonzero(often < most), np.flatnonzero(often == most)
                    s = np.concatenate([s[below], s[equal[: p - len(below)]]])
                keys.append(s)
                nodes.append(np.full(p, own, np.int64).view(np.uint64))
                sizes.append(np.full(p, size[-1], np.int64))
            n = len(size)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), *(pa.nulls(n, t) for t in (pa.int32(), *[pa.binary()] * 3))], COLUMNS)
            if keys:
                packed = links.packed_rows(mix(np.concatenate(keys)), np.concatenate(nodes), np.concatenate(sizes), buckets)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(packed.num_rows, pa.int64()) for _ in range(3)), *packed.columns], COLUMNS)

    return run


COLUMNS = ["doc_id", "n_shingles", "node", *links.NAMES]


def _prune(numer: int, denom: int):
    """Pairs of a tile that the summed coordinate minima don't rule out, by a packed tree over the members."""

    def run(table: pa.Table) -> pa.Table:
        node, comp, n, cell = (table.column(c).to_numpy() for c in ("node", "comp", "size", "cell"))
        own = pivots.cell_lists(table)
        points = _points(table.column("vector"))
        out_a, out_b = [], []
        for queries, members in pivots.each_tile(table):
            members = _packed_order(points, n, members)
            edges = np.arange(0, len(members), LEAF)
            corner = np.maximum.reduceat(points[members], edges, axis=0)
            small, large = np.minimum.reduceat(n[members], edges), np.maximum.reduceat(n[members], edges)
            leaf_of = np.arange(len(members)) // LEAF
            for q in queries:
                need = -(-numer * (n[q] + small) // (numer + denom))
                open_ = (np.minimum(corner, points[q]).sum(1) >= need) & (large * denom >= n[q] * numer) & (small * numer <= n[q] * denom)
                m = members[open_[leaf_of]]
                m = m[(comp[m] != comp[q]) & (n[m] * denom >= n[q] * numer) & (n[q] * denom >= n[m] * numer)]
                m = m[np.minimum(points[m], points[q]).sum(1) * (numer + denom) >= numer * (n[q] + n[m])]
                m = m[pivots.first_here(own, q, m, cell[q])]
                out_a.append(np.full(len(m), node[q]))
                out_b.append(node[m])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.table({"a": both[0], "b": both[1]})

    return run


def _packed_order(points: np.ndarray, n: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Sort-tile-recursive order: tiles by size, within them by the coordinates that vary most."""
    if len(members) <= LEAF:
        return members
    own = points[members]
    axes = np.argsort(-own.var(0))[:2]
    tiles = max(1, int(np.ceil((len(members) / LEAF) ** (1 / 3))))
    rank = lambda x: np.argsort(np.argsort(x, kind="stable"), kind="stable")
    first = rank(n[members]) * tiles // len(members)
    second = rank(first * 1_000_000.0 + own[:, axes[0]]) * tiles * tiles // len(members)
    return members[np.lexsort((own[:, axes[1]], second))]


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in shingle_sets(batches, k):
            own = [len(s) > 0 and node_of(s) == n for s, n in zip(sets, rows.column("node").to_pylist())]  # else another text with the same doc_id
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([vector(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["node", "items", "vector", "n_items"]).filter(pa.array(own, pa.bool_()))

    return run


def _points(vectors: pa.Array) -> np.ndarray:
    points = np.frombuffer(b"".join(vectors.to_pylist()), np.uint8).reshape(-1, GROUPS).astype(np.int32)
    points[points == 255] = 1 << 20
    return points


def _bound(numer: int, denom: int):
    """The pairs whose summed coordinate minima don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                both = np.minimum(_points(part.column("x")), _points(part.column("y"))).sum(1)
                m, n = part.column("m").to_numpy(), part.column("n").to_numpy()
                yield part.select(["a", "b"]).filter(pa.array(both * (numer + denom) >= numer * (m + n)))

    return run


def _overlap(numer: int, denom: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(denom * common >= numer * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_documents(docs: DataFrame, k: int = WORDS, numer: int = NUMER, denom: int = DENOM) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs of bytes other than white space (0x20, 0x09-0x0D) after lower-casing A-Z; the set has the distinct
    k-word shingles, or the whole sequence of a text of fewer words. Two documents link when denom * |A and B| >= numer *
    |A or B|; component_id is the least doc_id that links reach. A null or empty text, or one of white space alone, has
    no shingle and links with nothing: its component is its own doc_id. Documents with equal sets are one node. Repeated
    rows get a row each; rows without a doc_id are left out; an empty table gives an empty result. No link is lost: cells, tiles and bounds
    are exact, but for collisions of 64-bit hashes.
    """
    spark = docs.sparkSession
    whole = shared.texts(docs)
    n_bytes = shared.text_bytes(whole)
    buckets, size = shared.buckets_for(n_bytes), links.sketch_size(n_bytes)
    scale = spark.sparkContext.broadcast(links.sketch(whole.select("text").mapInArrow(_frequencies(k, size), links.SKETCHED), size))
    made = shared.written(whole.mapInArrow(_entries(k, numer, denom, buckets, scale), f"doc_id long, n_shingles long, node long, {links.PACKED}"), "entries")
    scale.destroy()
    members = shared.written(made.where("doc_id is not null").select("doc_id", "n_shingles", "node"), "documents")
    cells = links.cells(made.where("bucket is not null").select(*links.NAMES), numer / denom)
    shared.spent(made)
    nodes = shared.written(members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    busy = shared.written(cells.select("node").distinct().join(nodes, "node").select(F.col("rep").alias("doc_id"), "node"), "busy")
    n_busy = busy.count()
    # One row each fetches its set; only where a doc_id is repeated does a set come twice and must be dropped.
    fetched = whole.join(F.broadcast(busy) if n_busy <= shared.BROADCAST_ROWS else busy, "doc_id").select("node", "text")
    sets = shared.written(fetched.mapInArrow(_sets(k), "node long, items binary, vector binary, n_items long"), "sets")
    if sets.count() > n_busy:
        once = shared.written(sets.dropDuplicates(["node"]), "sets")
        shared.spent(sets)
        sets = once

    def verify(pairs: DataFrame) -> DataFrame:
        # Vectors are smaller than most sets, so they go first; then only sets of pairs that are left move.
        x = sets.select(F.col("node").alias("a"), F.col("vector").alias("x"), F.col("n_items").alias("m"))
        y = sets.select(F.col("node").alias("b"), F.col("vector").alias("y"), F.col("n_items").alias("n"))
        pairs = shared.written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(_bound(numer, denom), "a long, b long"), "bounded")
        ends = shared.written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
        asked = shared.semi(sets.select("node", "items"), ends, "node")
        x = asked.select(F.col("node").alias("a"), F.col("items").alias("x"))
        y = asked.select(F.col("node").alias("b"), F.col("items").alias("y"))
        return shared.written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_overlap(numer, denom), "a long, b long"), "links")

    def fits(x: str, y: str):
        return F.expr(f"{x}.size * {denom} >= {y}.size * {numer} and {y}.size * {denom} >= {x}.size * {numer}")

    def prune(tiles: DataFrame) -> DataFrame:
        return pivots.dealt(tiles.join(sets.select("node", "vector"), "node"), _prune(numer, denom), buckets)

    comp = pivots.link(cells.select("cell", "node", "size"), fits, verify, prune)
    shared.spent(cells, busy, sets)
    # Only linked sets have more than themselves in their component.
    named = shared.written(nodes.join(comp, "node").select("node", "comp", "rep"), "named")
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    label = named.join(least, "comp").select("node", "component_id")
    own = shared.written(nodes.join(label, "node", "left").select("node", "n", F.coalesce("component_id", "rep").alias("component_id")), "components")
    linked = shared.hot_join(members.where("node is not null"), own, "node", "doc_id", "n").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(members.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id is their component's least, all columns: one document of each group stays. Of rows with the same doc_id one stays."""
    keep = similar_documents(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(shared.table(spark, sf_dir, "documents"))
