"""Connected groups from candidate cells by pairs, for nodes whose facts are too large to be carried into every cell.

First every node of a cell is compared with one pivot of it. What that has joined into one component needs no more
comparisons among itself; cells that still hold several components are compared across these, in tiles of bounded size with
small facts of the nodes, so that no link between components is lost; the pairs that are left are verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .links import TILE, components

#: So many of a node's cells, the least, are known where it is compared.
KNOWN = 16


def link(cells: DataFrame, fits: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], prune: Callable[[DataFrame], DataFrame], band: Column | None = None) -> DataFrame:
    """(node, comp) of the nodes that have a link.

    cells: (cell, node, size). The pivot of a cell is its member that shares the most cells with others: what a
    group of edited copies has in common lies nearest to it. fits: a cheap condition on the sizes of structs x and y that
    every linked pair meets. verify: (a, b) -> the linked ones. prune: (tile, node, comp, size, query, cell, own) -> pairs (a, b) of
    different comp within a tile that may be linked; own is a node's KNOWN least cells, by which pairs that meet in a lesser cell too are left to that one. band: a whole number of a node's size that differs by one at most
    between linked nodes; a cell is then compared band by band.
    """
    per_cell = cells.groupBy("cell").agg(F.count("*").alias("members"))
    score = cells.join(per_cell, "cell").groupBy("node").agg(F.sum("members").alias("weight"))
    known = shared.written(cells.join(score, "node"), "members")
    top = F.max(F.struct("weight", "node", "size"))
    pivot = shared.written(known.groupBy("cell").agg(top.alias("y"), F.count("*").alias("members")), "pivots")
    star = known.withColumn("x", F.struct("node", "size")).join(pivot, "cell").where("x.node <> y.node").where(fits("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    star = shared.written(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")
    comp = components(verify(star))
    # The pivot has met every member, so it has no part in the second round, and cells of two nodes are done.
    middle = pivot.where("members > 2").select("cell", F.col("y.node").alias("node")).join(comp, "node", "left").select("cell", F.col("node").alias("pivot"), F.coalesce("comp", "node").alias("main"))
    marked = known.join(comp, "node", "left").select("cell", "node", "size", F.coalesce("comp", "node").alias("comp")).join(middle, "cell").where("node <> pivot")
    marked = marked.select("cell", "node", "size", "comp", (F.col("comp") != F.col("main")).alias("minor"))
    several = marked.where("minor").select("cell").distinct()
    marked = shared.written(marked.join(several, "cell").withColumn("band", F.lit(0) if band is None else band), "several")
    shared.spent(known, pivot, star)
    # Two nodes of different components are compared in every cell of `marked` that they share, as one of them is outside the
    # pivot's component there. So the least cell that they share is enough; of a list cut short nothing false is concluded.
    lists = marked.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("cell")), 1, KNOWN).alias("own"))
    asking = marked.where("minor") if band is None else marked.where("minor").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    sizes = asking.groupBy("cell", "band").agg(F.count("*").alias("asking")).join(marked.groupBy("cell", "band").agg(F.count("*").alias("members")), ["cell", "band"])
    sizes = shared.written(sizes.select("cell", "band", F.ceil(F.col("asking") / TILE).alias("rows"), F.ceil(F.col("members") / TILE).alias("parts")), "sizes")
    # Tile (i, j) of a cell and band holds part i of the minor members that may be linked to the band, those outside the
    # pivot's component, and part j of its members: every minor meets every member once, and a tile has at most about 2 TILE rows.
    last = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    member = marked.join(sizes, ["cell", "band"]).withColumn("tile_j", F.pmod(F.xxhash64("node"), "parts")).withColumn("tile_i", F.explode(last("rows"))).withColumn("query", F.lit(False))
    query = asking.join(sizes, ["cell", "band"]).withColumn("tile_i", F.pmod(F.xxhash64(F.lit(1), F.col("node")), "rows")).withColumn("tile_j", F.explode(last("parts"))).withColumn("query", F.lit(True))
    tiles = member.unionByName(query).select(F.xxhash64("cell", "band", "tile_i", "tile_j").alias("tile"), "node", "comp", "size", "query", "cell").join(lists, "node")
    more = shared.written(prune(tiles).distinct(), "across")
    shared.spent(marked, sizes)
    # Links between components: these are the nodes now.
    end = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    across = verify(more).join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    above = components(across)
    if not above.head(1):
        return comp
    up = above.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
    inner = comp.join(up, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"))
    alone = above.join(comp.select("node"), "node", "left_anti")
    return shared.written(inner.unionByName(alone), "groups")


def dealt(tiles: DataFrame, run: Callable[[pa.Table], pa.Table], buckets: int) -> DataFrame:
    """run over tables of whole tiles: pairs (a, b)."""
    return tiles.withColumn("deal", F.pmod("tile", F.lit(buckets))).groupBy("deal").applyInArrow(run, "a long, b long")


def each_tile(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the queries and of the members of each tile that has both."""
    tile, query = table.column("tile").to_numpy(), table.column("query").to_numpy(zero_copy_only=False)
    order = np.lexsort((~query, tile))
    tile, query = tile[order], query[order]
    starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else []
    for a, b in zip(starts, np.append(starts[1:], len(tile)) if len(tile) else []):
        n = int(query[a:b].sum())
        if n and n < b - a:
            yield order[a : a + n], order[a + n : b]


def cell_lists(table: pa.Table) -> np.ndarray:
    """The column own as rows of KNOWN numbers; what a list is short of is filled with its last one."""
    own = table.column("own").combine_chunks()
    long = own.value_lengths().to_numpy()
    start = np.cumsum(long) - long
    at = start[:, None] + np.minimum(np.arange(KNOWN), long[:, None] - 1)
    return own.flatten().to_numpy()[at]


def first_here(own: np.ndarray, q: int, others: np.ndarray, cell: int) -> np.ndarray:
    """Which of the others (rows of own) share no lesser cell than this one with q, as far as their lists tell."""
    mine = np.unique(own[q][own[q] < cell])
    return ~np.isin(own[others], mine).any(1)
