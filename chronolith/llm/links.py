"""Connected groups from candidate cells, without all pairs of a cell.

A cell is a set of nodes any two of which may be linked. Cells of TILE nodes at most are compared whole, in tasks that keep
track of what is connected already, so that a group of linked copies costs about one comparison each; cells that have their
least node in common are in one task. Before, a cell is taken apart into what may be linked by the places of its key, and then by
fingerprints of its nodes, while only numbers have moved. Larger cells are first compared with one pivot, in parts; what is in the pivot's
component by then needs no more comparisons with it, and the rest of the cell is compared with all of it in tiles of bounded
size, so that no link between components is lost. Comparing gives links that span what it has connected, few more of them
than nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .vec import mix

#: Members of a cell in one tile, at most about so many, and tiles to a side of what is dealt out together.
TILE, SIDE = 512, 8


def components(edges: DataFrame) -> DataFrame:
    """(node long, comp long) of every node of the edges (a long, b long).

    Randomised contraction: each round, every node joins the neighbour (or itself) whose hash is the least; the nodes
    joined into are the nodes of the next round. A constant share of nodes goes each round whatever the graph's shape, a
    node with very many neighbours is only ever aggregated, and edges and nodes stay in tables of the shared folder.
    """
    spark = edges.sparkSession
    edges = shared.written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    seed = 0
    while edges.head(1):
        seed += 1
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def order(c: str, seed: int = seed) -> Column:
            return F.struct(F.xxhash64(F.lit(seed), F.col(c)), F.col(c).alias("id"))

        into = both.groupBy("a").agg(F.min(order("b")).alias("near")).select(F.col("a").alias("node"), F.least(order("a"), F.col("near"))["id"].alias("into"))
        into = shared.written(into, "into")
        maps.append(into)
        first = into.select(F.col("node").alias("a"), F.col("into").alias("ia"))
        second = into.select(F.col("node").alias("b"), F.col("into").alias("ib"))
        left = edges.join(first, "a").select("ia", "b").join(second, "b").where("ia <> ib")
        last, edges = edges, shared.written(left.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct(), "edges")
        shared.spent(last)
    shared.spent(edges)
    if not maps:
        return spark.createDataFrame([], "node long, comp long")
    out = maps[-1].select("node", F.col("into").alias("comp"))
    for earlier in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("into"), F.col("comp").alias("far"))
        out = earlier.join(later, "into", "left").select("node", F.coalesce("far", "into").alias("comp"))
    out = shared.written(out, "components")
    shared.spent(*maps)
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket by the upper half of the key; within a bucket the lower half tells keys apart, and what happens to agree there is one candidate more."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: Entries (cell key, node, size), packed by the bucket of the key.
PACKED = "bucket int, keys binary, nodes binary, sizes binary"
NAMES = ["bucket", "keys", "nodes", "sizes"]
_KINDS = (np.uint32, np.uint64, np.uint32)
#: A bucket of more entries than this isn't put together in a task (16 bytes each); its keys are counted row by row instead.
MOST = 2_000_000


def packed_rows(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, buckets: int, marks: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of PACKED; with marks (a whole number of 32 bits for each entry) these are one more column, `marks`."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    own = np.flatnonzero(np.diff(edges))
    columns = [np.ascontiguousarray(x[order].astype(t)) for x, t in zip((keys & np.uint64(0xFFFFFFFF), nodes, sizes), _KINDS)]
    if marks is not None:
        columns.append(marks[order])
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array([c[edges[i] : edges[i + 1]].tobytes() for i in own], pa.binary()) for c in columns)], NAMES if marks is None else [*NAMES, "marks"])


def _names(nodes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Cells are named by the sum of what they hold: cells of the same nodes are one."""
    return mix(np.add.reduceat(mix(nodes), starts) + size.astype(np.uint64))


#: Pairs of entries or of lines that are held together at once.
PAIRS = 1 << 19
#: Cells of more members than this are not taken apart in a task.
WHOLE = 8192


def united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent (of each number the least of its group) after the groups of a and b have been put together, pair by pair."""
    parent = parent.copy()
    while True:
        x, y = parent[a], parent[b]
        on = x != y
        if not on.any():
            return parent
        a, b = a[on], b[on]
        np.minimum.at(parent, np.maximum(x[on], y[on]), np.minimum(x[on], y[on]))
        while len(np.flatnonzero((up := parent[parent]) != parent)):
            parent = up


def partnered(sizes: np.ndarray, marks: np.ndarray, starts: np.ndarray, size: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Which members have another in their cell that fits; in cells of more than TILE all are said to. Cells of one size are looked at side by side."""
    out = np.ones(len(sizes), bool)
    for s in np.unique(size[(size > 1) & (size <= TILE)]).tolist():
        own, step = starts[size == s], max(1, PAIRS // s**2)
        for a in range(0, len(own), step):
            at = own[a : a + step, None] + np.arange(s)
            out[at] = fits(sizes[at], marks[at])
    return out


def _parts(sizes: np.ndarray, places: np.ndarray, first: np.ndarray, gap: float, near: Callable[..., np.ndarray]) -> np.ndarray:
    """Of each entry the number of the least one that it is connected with by near, in its cell; cells begin at first and are sorted by size. Cells of more than WHOLE entries stay one."""
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, len(sizes)))
    end = np.repeat(starts + size, size)
    whole = np.repeat(size > WHOLE, size)
    label = np.where(whole, np.repeat(starts, size), np.arange(len(sizes)))
    live, step, a, b, held = np.flatnonzero(~whole), 1, [], [], 0
    while len(live):
        live = live[live + step < end[live]]
        live = live[sizes[live] >= gap * sizes[live + step] - 1e-9]  # those further on are larger still
        ask = live[label[live] != label[live + step]]
        met = ask[near(sizes[ask], places[ask], sizes[ask + step], places[ask + step])]
        a.append(met)
        b.append(met + step)
        held += len(met)
        if held >= PAIRS:
            label, a, b, held = united(label, np.concatenate(a), np.concatenate(b)), [], [], 0
        step += 1
    return united(label, np.concatenate(a), np.concatenate(b)) if a else label


def _told(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, marks: np.ndarray | None, gap: float, near: Callable[..., np.ndarray] | None) -> pa.Table:
    """Rows of CELLS from entries in any order: a cell is cut where sizes are further apart than gap, and taken apart into what near connects."""
    order = np.lexsort((nodes, sizes, keys))
    keys, nodes, sizes = keys[order], nodes[order], sizes[order].astype(np.int64)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes, sizes = keys[new], nodes[new], sizes[new]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (sizes[1:] * gap > sizes[:-1] + 1e-9)
    if near is not None:
        part = _parts(sizes, marks[order][new], first, gap, near)
        order = np.argsort(part, kind="stable")
        nodes, sizes, part = nodes[order], sizes[order], part[order]
        first[1:] = part[1:] != part[:-1]
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, len(nodes)))
    names = _names(nodes, starts, size) if len(starts) else nodes
    keep = np.zeros(len(starts), bool)
    keep[np.unique(names, return_index=True)[1]] = True
    keep &= size > 1
    on = np.repeat(keep, size)
    each = lambda x: np.repeat(x[keep], size[keep])
    lead = np.minimum.reduceat(nodes, starts) if len(starts) else nodes
    return pa.table({"cell": each(names).view(np.int64), "node": nodes[on].view(np.int64), "size": sizes[on], "lead": each(lead).view(np.int64), "members": each(size).astype(np.int64)})


def _cells(gap: float, near: Callable[..., np.ndarray] | None = None):
    def run(group: pa.Table) -> pa.Table:
        keys, nodes, sizes = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in zip(NAMES[1:], _KINDS))
        places = None if near is None else np.frombuffer(b"".join(group.column("marks").to_pylist()), np.int32).astype(np.int64)
        return _told(keys, nodes, sizes, places, gap, near)

    return run


def _narrow(gap: float, near: Callable[..., np.ndarray], width: int):
    def run(group: pa.Table) -> pa.Table:
        cell, node, size = (group.column(c).to_numpy() for c in ("cell", "node", "size"))
        none = bytes(8 * width)
        marks = np.frombuffer(b"".join(none if x is None else x for x in group.column("print").to_pylist()), np.uint64).reshape(-1, width)
        return _told(cell.view(np.uint64), node.view(np.uint64), size, marks, gap, near)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            keys, nodes, sizes = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in zip(NAMES[1:], _KINDS))
            bucket = int(b.column("bucket")[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array((bucket << 32 | keys.astype(np.int64)), pa.int64()), pa.array(nodes.view(np.int64)), pa.array(sizes.astype(np.int64))], ["cell", "node", "size"])


CELLS = "cell long, node long, size long, lead long, members long"


def cells(packed: DataFrame, gap: float, near: Callable[..., np.ndarray] | None = None, rounds: int = 1) -> DataFrame:
    """Rows of CELLS from a table of PACKED, written: the keys that two nodes or more share, with the least node and the number of nodes; cells of the same nodes are one.

    gap: linked nodes' sizes, the smaller by the larger, are at least this, so a cell is cut where neighbours in the order
    of sizes are further apart. near(sizes, places, sizes, places) says which pairs of entries may be linked, by their places;
    packed has these in a column `marks` then, and a cell is taken apart into what near connects, so that entries near nobody
    are in none. Buckets of more than MOST entries (a key that a large share of all rows has) don't become
    one group: their entries are counted by key, and none is put together with the others of its key. Buckets are put
    together in so many rounds, each of which gives its shuffle files back, so that not all entries are on disk twice.
    """
    big = shared.written(packed.groupBy("bucket").agg(F.sum(F.octet_length("keys")).alias("n")).where(F.col("n") > 4 * MOST).select("bucket"), "big")
    few = big.head(1)
    grouped = packed.join(F.broadcast(big) if big.count() <= shared.BROADCAST_ROWS else big, "bucket", "left_anti") if few else packed
    told = lambda t: t.groupBy("bucket").applyInArrow(_cells(gap, near), CELLS)
    turns = [shared.written(told(grouped.where(F.col("bucket") % rounds == i)), "round") for i in range(rounds)] if rounds > 1 else []
    out = reduce(DataFrame.unionByName, turns) if turns else told(grouped)
    if few:
        rows = shared.written(shared.semi(packed, big, "bucket").mapInArrow(_unpacked, "cell long, node long, size long").distinct(), "entries")
        common = rows.groupBy("cell").agg(F.min("node").alias("lead"), F.count("*").alias("members")).where("members > 1")
        out = out.unionByName(rows.join(shared.written(common, "common"), "cell"))
    out = shared.written(out.distinct(), "cells")
    shared.spent(*turns)
    return out


def narrowed(cells: DataFrame, prints: DataFrame, gap: float, near: Callable[..., np.ndarray], width: int, buckets: int) -> DataFrame:
    """cells (written, rows of CELLS) taken apart once more into what near(sizes, marks, sizes, marks) connects, written.

    prints: (node, print), width words of 64 bits; more rows of a node are alike, and a node without one has zeros. Only
    numbers move here. Cells of more than WHOLE members stay as they are.
    """
    small = cells.where(F.col("members") <= WHOLE).select("cell", "node", "size").join(prints, "node", "left")
    apart = small.withColumn("deal", F.pmod(F.xxhash64("cell"), F.lit(buckets))).groupBy("deal").applyInArrow(_narrow(gap, near, width), CELLS)
    return shared.written(apart.unionByName(cells.where(F.col("members") > WHOLE)).distinct(), "narrowed")


#: Bits of presence(): so many for each row at least, but no more than MOST_BITS (16 MB) whatever the input; and bits of a slice.
BITS_A_ROW, LEAST_BITS, MOST_BITS, SLICE_BITS = 32, 1 << 20, 1 << 27, 1 << 19


def _present(group: pa.Table) -> pa.Table:
    on = np.zeros(SLICE_BITS, bool)
    on[group.column("node").to_numpy() & (SLICE_BITS - 1)] = True
    return pa.table({"slice": group.column("slice").slice(0, 1), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})


def presence(nodes: DataFrame) -> np.ndarray:
    """Bits (packed, a power of two) of which those are set that are the low bits of a node (a hash), see may_be_present()."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_ROW * nodes.count()).bit_length()))
    of = F.shiftright(F.col("node").bitwiseAND(F.lit(bits - 1)), SLICE_BITS.bit_length() - 1)
    out = np.zeros(bits // 8, np.uint8)
    for r in nodes.select("node", of.cast("int").alias("slice")).groupBy("slice").applyInArrow(_present, "slice int, bits binary").collect():
        out[r["slice"] * SLICE_BITS // 8 :][: SLICE_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_be_present(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """False for nodes (int64) that presence() hasn't seen; of others a few, the more the fuller the bits are, get True too."""
    at = nodes & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


#: Counters of the sketch of key frequencies: about one for every 128 bytes of text, within these bounds (four bytes each in a task).
LEAST_SKETCH, MOST_SKETCH = 1 << 22, 1 << 24
#: Counters in a row, and how many tasks' rows one group adds up.
_SLICE, _FAN_IN = 1 << 16, 64


def sketch_size(n_bytes: int) -> int:
    return min(MOST_SKETCH, max(LEAST_SKETCH, 1 << (n_bytes // 128).bit_length()))


def sketch_rows(counts: np.ndarray, task: int) -> pa.RecordBatch:
    """A task's counters (uint32) as rows (task, slice, counts) to be summed."""
    parts = counts.reshape(-1, _SLICE)
    on = [i for i in range(len(parts)) if parts[i].any()]
    small = lambda x: x.astype(np.uint8 if x.max() < 256 else np.uint16 if x.max() < 65536 else np.uint32)
    return pa.RecordBatch.from_arrays([pa.array([task] * len(on), pa.int64()), pa.array(on, pa.int32()), pa.array([small(parts[i]).tobytes() for i in on], pa.binary())], ["task", "slice", "counts"])


SKETCHED = "task long, slice int, counts binary"


def _add(group: pa.Table) -> pa.Table:
    total = np.zeros(_SLICE, np.uint64)
    for x in group.column("counts").to_pylist():
        total += np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(x) // _SLICE])
    total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
    return pa.table({"task": pa.array([group.column("task")[0].as_py() // _FAN_IN], pa.int64()), "slice": group.column("slice").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def sketch(rows: DataFrame, size: int) -> np.ndarray:
    """The summed counters on a log scale (4 steps an octave, rounded down, plus 1), one byte each: MOST_SKETCH bytes at most, whatever the input. Rows are added up in a tree of fan-in _FAN_IN."""
    rows = shared.written(rows, "sketch")
    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    spent = [rows]
    while True:
        level = rows.groupBy(F.floor(F.col("task") / _FAN_IN).alias("group"), "slice").applyInArrow(_add, SKETCHED)
        tasks = -(-tasks // _FAN_IN)
        if tasks == 1:
            break
        rows = shared.written(level, "sketch")
        spent.append(rows)
    out = np.zeros((size // _SLICE, _SLICE), np.uint8)
    for r in level.toLocalIterator():
        total = np.frombuffer(r["counts"], np.uint32)
        on = total > 0
        out[r["slice"], on] = (np.log2(total[on]) * 4).astype(np.uint8) + 1
    shared.spent(*spent)
    return out.ravel()


def link(cells: DataFrame, facts: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], buckets: int, band: Column | None = None) -> DataFrame:
    """(node, comp) of the nodes that have a link.

    cells: rows of CELLS, written. facts: (node, ...), what compare reads of it, written; more rows of a node are alike. compare: a table of tile,
    node, comp, size, query, cell, own, and one of node and the facts -> links (a, b), see spanning(). Tiles are dealt out to
    tasks, and a node's facts move once to each task that it has tiles in. band: a whole number of a node's size that differs
    by one at most between linked nodes; a large cell is then compared band by band.
    """

    def linked(tiles: DataFrame, facts: DataFrame, deal: Column) -> DataFrame:
        facts = facts.groupBy("node").agg(*[F.first(c).alias(c) for c in facts.columns if c != "node"])
        dealt = tiles.withColumn("deal", F.pmod(F.xxhash64(deal), F.lit(buckets)))
        wanted = dealt.groupBy("node").agg(F.collect_set("deal").alias("deals")).join(facts, "node")
        own = wanted.select(F.explode("deals").alias("deal"), *[F.col(c).alias(c) for c in facts.columns])
        return shared.written(dealt.groupBy("deal").cogroup(own.groupBy("deal")).applyInArrow(compare, "a long, b long"), "links")

    columns = ["tile", "node", "comp", "size", "query", "cell", "own"]
    alone = F.array().cast("array<long>").alias("own")
    small = cells.where(F.col("members") <= TILE).select(F.col("cell").alias("tile"), "node", F.col("node").alias("comp"), "size", F.lit(BOTH).alias("query"), "cell", alone, "lead")
    found = linked(small, facts, F.col("lead"))
    large = shared.written(cells.where(F.col("members") > TILE).select("cell", "node", "size", F.ceil(F.col("members") / TILE).alias("parts")), "large")
    if not large.head(1):
        return components(found)
    crowd = shared.written(large.select("node").distinct(), "crowd")
    facts = shared.written(shared.semi(facts, crowd, "node"), "facts")
    # The pivot is the member that shares the most large cells: what a group of edited copies has in common lies nearest to it.
    weight = large.groupBy("node").agg(F.count("*").alias("weight"))
    pivot = large.join(weight, "node").groupBy("cell", "parts").agg(F.max(F.struct("weight", "node", "size")).alias("y"))
    pivot = shared.written(pivot.select("cell", "parts", "y.node", "y.size"), "pivots")
    part = lambda c: F.xxhash64("cell", c)
    star = large.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn("query", F.lit(MEMBER))
    star = star.unionByName(pivot.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("query", F.lit(QUERY)))
    star = shared.written(star.select(part("part").alias("tile"), "node", F.col("node").alias("comp"), "size", "query", "cell", alone), "star")
    near = linked(star, facts, F.col("tile"))
    comp = components(found.unionByName(near))
    named = lambda t: t.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # The pivot has met every member, so it has no part in what follows. Who isn't in its component asks.
    middle = named(pivot.select("cell", "node")).select("cell", F.col("node").alias("pivot"), F.col("comp").alias("main"))
    # Nodes that share several large cells are compared in the least of these, which each node's list of cells tells.
    own = large.groupBy("node").agg(F.sort_array(F.collect_set("cell")).alias("own"))
    marked = named(large).join(middle, "cell").where("node <> pivot").join(own, "node").select("cell", "node", "size", "comp", (F.col("comp") != F.col("main")).alias("minor"), "own")
    several = marked.where("minor").select("cell").distinct()
    marked = shared.written(marked.join(several, "cell").withColumn("band", F.lit(0) if band is None else band), "several")
    asking = marked.where("minor") if band is None else marked.where("minor").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    sizes = asking.groupBy("cell", "band").agg(F.count("*").alias("asking")).join(marked.groupBy("cell", "band").agg(F.count("*").alias("members")), ["cell", "band"])
    sizes = shared.written(sizes.select("cell", "band", F.ceil(F.col("asking") / (TILE // 4)).alias("rows"), F.ceil(F.col("members") / TILE).alias("parts")), "sizes")
    # Tile (i, j) of a cell and band holds part i of those that ask and may be linked to the band, and part j of the band's
    # members: every one that asks meets every member once, and a tile has at most about 1.25 TILE rows.
    last = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    member = marked.join(sizes, ["cell", "band"]).withColumn("tile_j", F.pmod(F.xxhash64("node"), "parts")).withColumn("tile_i", F.explode(last("rows"))).withColumn("query", F.lit(MEMBER))
    query = asking.join(sizes, ["cell", "band"]).withColumn("tile_i", F.pmod(F.xxhash64(F.lit(1), F.col("node")), "rows")).withColumn("tile_j", F.explode(last("parts"))).withColumn("query", F.lit(QUERY))
    # Blocks of SIDE x SIDE tiles of four bands are dealt out together, as they share nodes and so facts.
    block = F.xxhash64("cell", F.floor(F.col("band") / 4), F.floor(F.col("tile_i") / SIDE), F.floor(F.col("tile_j") / SIDE))
    tiles = member.unionByName(query).withColumn("tile", F.xxhash64("cell", "band", "tile_i", "tile_j")).select(*columns, block.alias("block"))
    tiles = shared.written(tiles, "tiles")
    more = linked(tiles, facts, F.col("block"))
    shared.spent(large, crowd, facts, star, pivot, marked, sizes, tiles)
    # Links between components: these are the nodes now.
    end = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    across = more.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    above = components(across)
    if not above.head(1):
        return comp
    up = above.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
    inner = comp.join(up, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"))
    single = above.join(comp.select("node"), "node", "left_anti")
    return shared.written(inner.unionByName(single), "groups")


MEMBER, QUERY, BOTH = 0, 1, 2


def spanning(table: pa.Table, select: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], confirm: Callable[[np.ndarray, np.ndarray], np.ndarray], first: np.ndarray, place: np.ndarray) -> pa.Table:
    """Links (a, b) that connect what is linked in the table's tiles; what is connected by then isn't compared again.

    Nodes are numbered by place (of each row; first: a row of each). In a tile queries meet members, or BOTH each other.
    Nodes that share another cell before this one, by their lists `own`, are compared there. select(x, y) narrows pairs of
    numbers down to those that may be linked and says how far apart they seem; confirm(x, y) says which are linked.
    """
    node, query = table.column("node").to_numpy()[first], table.column("query").to_numpy()
    comp = np.unique(table.column("comp").to_numpy()[first], return_inverse=True)[1]
    parent = np.arange(comp.max(initial=-1) + 1)
    tile, cell = table.column("tile").to_numpy(), table.column("cell").to_numpy()
    lists = table.column("own").take(pa.array(first)).to_pylist()
    long = np.array([len(x) for x in lists], np.int64)
    width = int(long.max(initial=0))
    filled = np.arange(width) >= long[:, None]
    own = np.zeros((len(lists), width), np.int64)
    own[~filled] = [c for x in lists for c in x]

    def elsewhere(x: int, others: np.ndarray, here: int) -> np.ndarray:
        """Which of the others share a cell below this one with x."""
        mine = own[x][~filled[x]]
        mine = mine[mine < here]
        return (np.isin(own[others], mine) & ~filled[others]).any(1) if len(mine) else np.zeros(len(others), bool)

    order = np.lexsort((query == MEMBER, tile))
    starts = np.flatnonzero(np.append(True, tile[order][1:] != tile[order][:-1])) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(order)))

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        both = query[order[starts]] == BOTH
        for s in np.unique(size[both]).tolist():
            at, step = starts[both & (size == s)], max(1, PAIRS // s**2)
            i, j = np.triu_indices(s, 1)
            for a in range(0, len(at), step):
                here = place[order[at[a : a + step, None] + np.arange(s)]]
                yield here[:, i].ravel(), here[:, j].ravel()
        for a, z in zip(starts[~both], (starts + size)[~both]):
            rows = order[a:z]
            asks, members = (np.unique(place[rows[query[rows] == q]]) for q in (QUERY, MEMBER))
            for x in asks:
                others = members[~elsewhere(x, members, cell[rows[0]])] if width else members
                yield np.full(len(others), x), others

    out_a, out_b, held = [], [], []

    def settle() -> None:
        """Of every group the nearest pairs are compared first, then twice as many, until no pair is left that would connect anything."""
        nonlocal parent
        x, y, apart = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
        held.clear()
        order = np.argsort(apart, kind="stable")
        x, y, each = x[order], y[order], 1
        while True:
            on = parent[comp[x]] != parent[comp[y]]
            x, y = x[on], y[on]
            if not len(x):
                return
            now = _foremost(parent[comp[x]], each) | _foremost(parent[comp[y]], each)
            a, b = x[now], y[now]
            good = confirm(a, b)
            out_a.append(node[a[good]])
            out_b.append(node[b[good]])
            parent = united(parent, comp[a[good]], comp[b[good]])
            x, y, each = x[~now], y[~now], 2 * each

    waiting, many = [], 0
    for x, y in pairs():
        waiting.append((x, y))
        many += len(x)
        if many < PAIRS:
            continue
        x, y = (np.concatenate(c) for c in zip(*waiting))
        waiting, many = [], 0
        on = parent[comp[x]] != parent[comp[y]]
        held.append(select(x[on], y[on]))
        if sum(len(h[0]) for h in held) >= PAIRS // 8:
            settle()
    if waiting:
        x, y = (np.concatenate(c) for c in zip(*waiting))
        on = parent[comp[x]] != parent[comp[y]]
        held.append(select(x[on], y[on]))
    settle()
    link = lambda c: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64())
    return pa.table({"a": link(out_a), "b": link(out_b)})


def _foremost(group: np.ndarray, n: int) -> np.ndarray:
    """Which are among the first n of their group."""
    order = np.argsort(group, kind="stable")
    new = np.ones(len(group), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    starts = np.flatnonzero(new)
    out = np.empty(len(group), bool)
    out[order] = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group)))) < n
    return out
