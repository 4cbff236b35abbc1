"""Density clustering of grid cells (DBSCAN on lattice sites).

A slice is cut into square tiles with a halo of two search radii.  Each tile
is labelled on its own (a numpy kernel that takes a bounded number of cells of
many tiles at a time); components that touch a tile
border are then merged by a small graph of component labels.  No task ever
holds more cells than that, and no cell pair is ever emitted.  A tile without
cells of its own says nothing that the owners of its halo do not see.  A tile
returns one row a component, which holds its cells: merging, counting and
numbering move these rows and not the cells.  Only cells at a tile border travel
on their own.

Labels are the smallest core-cell id of a component in (y, x) order, so the
result does not depend on tiling: a border cell joins the first of its
neighbouring clusters in scan order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrespark.session import cut_lineage, spread

_ROW = 1 << 24  # cell id = y * _ROW + x
TILE_ROWS = 200_000  # cells labelled together, a tile more at most


def _changes(column: pa.ChunkedArray):
    """Where a value differs from the one before it."""
    import numpy as np

    values = column.combine_chunks()
    try:
        same = pc.fill_null(pc.equal(values[1:], values[:-1]), False)
    except pa.ArrowNotImplementedError:  # nested keys
        plain = values.to_pylist()
        return np.array([x != y for x, y in zip(plain[1:], plain)], dtype=bool)
    return ~np.asarray(same) & ~(np.asarray(values[1:].is_null()) & np.asarray(values[:-1].is_null()))


def _label_tiles(table: pa.Table, number, by: list[str], eps: float, min_samples: int, tile: int, origin: int = 0) -> pa.Table:
    """Local components of numbered tiles (both signs), all tiles together; tile 0 starts at ``origin``."""
    import numpy as np

    reach = int(math.floor(eps))
    halo = 2 * reach
    sign, y, x, ty, tx, crit = (np.asarray(table.column(c).combine_chunks()) for c in ("_sign", "y", "x", "_ty", "_tx", "crit"))
    y, x = y.astype(np.int64), x.astype(np.int64)
    side, width = tile + 2 * halo, tile + 2 * halo + reach  # empty columns and rows keep neighbours apart
    ly, lx = y - (ty * tile + origin - halo), x - (tx * tile + origin - halo)
    home = (ly >= halo) & (ly < side - halo) & (lx >= halo) & (lx < side - halo)
    owning = np.zeros(int(number[-1]) + 1, dtype=bool)
    owning[number[home]] = True
    if not owning.all():  # tiles that are all halo
        rows = np.flatnonzero(owning[number])
        table, number = table.take(pa.array(rows)), number[rows]
        sign, y, x, crit, ly, lx = (c[rows] for c in (sign, y, x, crit, ly, lx))
    key = ((number * 2 + (sign > 0)) * width + ly) * width + lx
    # the last of the rows of one cell counts
    key, at = np.unique(key[::-1], return_index=True)
    at = len(y) - 1 - at
    n, ly, lx = len(key), ly[at], lx[at]

    def inside(margin):
        return (ly >= halo - margin) & (ly < side - halo + margin) & (lx >= halo - margin) & (lx < side - halo + margin)

    own, known = inside(0), inside(reach)
    near = []
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            if 0 < dy * dy + dx * dx <= eps * eps:
                wanted = key + dy * width + dx
                found = np.minimum(np.searchsorted(key, wanted), n - 1)
                near.append(np.where(key[found] == wanted, found, n))
    count = 1 + sum((k < n).astype(np.int32) for k in near)
    # core flags are exact up to one search radius outside the tile
    core = (count >= min_samples) & known
    label = np.append(np.where(core, np.arange(n), n), n)
    while True:
        best = label[:n].copy()
        for k in near:
            np.minimum(best, label[k], out=best)
        best = np.append(np.where(core, best, n), n)
        best = best[best]
        if np.array_equal(best, label):
            break
        label = best
    cid = y[at] * _ROW + x[at]

    # core cells in a neighbour's halo, and ours that neighbours have in theirs: only their components may go on outside
    seen, shown = np.flatnonzero(core & ~own), np.flatnonzero(core & own & ~inside(-reach))
    goes_on = np.zeros(n, dtype=bool)
    goes_on[label[seen]] = True
    goes_on[label[shown]] = True
    # a border cell joins the first component it is near to; it waits if that may change outside
    edge = own & ~core
    hits = [np.stack([h := np.flatnonzero(edge & (label[k] < n)), label[k[h]]], axis=1) for k in near]
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *hits]), axis=0)
    start = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]][:len(pairs)])
    several = np.diff(np.r_[start, len(pairs)])
    waits = (several > 1) & (np.add.reduceat(goes_on[pairs[:, 1]], start, dtype=np.int64) > 0 if len(start) else False)
    inner = np.flatnonzero(own & core)
    rows, comp = np.r_[inner, pairs[start[~waits], 0]], np.r_[label[inner], pairs[start[~waits], 1]]
    order = np.lexsort((rows, comp))
    rows, comp = rows[order], comp[order]
    begin = np.flatnonzero(np.r_[True, comp[1:] != comp[:-1]][:len(comp)])

    held = [(rows, begin, comp[begin], None, 0),
            (pairs[start[waits], 0], None, pairs[start[waits], 1], (cid[pairs[np.repeat(waits, several), 1]], several[waits]), 0),
            (seen, None, label[seen], None, 1), (shown, None, label[shown], None, 2)]
    frames = []
    for cells, first, comp, choice, kind in held:
        first = np.arange(len(cells)) if first is None else first
        picked = table.select([*by, "_sign"]).take(pa.array(at[cells[first]]))
        sizes = np.diff(np.r_[first, len(cells)])
        content = pa.StructArray.from_arrays([pa.array(cid[cells]), pa.array(crit[at[cells]])], ["cid", "crit"])
        columns = {"kind": pa.array(np.full(len(first), kind, np.int32)), "comp": pa.array(cid[comp]), "first": pa.array(cid[cells[first]]),
                   "others": pa.nulls(len(first), pa.list_(pa.int64())) if choice is None else _lists(pa.array(choice[0]), choice[1]),
                   "cells": _lists(content, sizes) if kind == 0 else pa.nulls(len(first), pa.list_(content.type))}
        for name, values in columns.items():
            picked = picked.append_column(name, values)
        frames.append(picked)
    return pa.concat_tables(frames)


def _lists(values: pa.Array, sizes) -> pa.Array:
    """Values cut into lists of these sizes."""
    import numpy as np

    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def tiles_together(batches: Iterator[pa.RecordBatch], groups: list[str], kernel: Callable) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted by tile, for ``kernel(table, tile numbers)``: many tiles at a time; the last one waits for its rest."""
    import numpy as np

    held, n = [], 0

    def done(last: bool):
        table = pa.Table.from_batches(held)
        new = np.zeros(max(len(table) - 1, 0), dtype=bool)
        for c in groups:
            new |= _changes(table.column(c))
        number = np.r_[0, np.cumsum(new)]
        end = len(table) if last else int(np.searchsorted(number, number[-1]))
        out = kernel(table.slice(0, end), number[:end]) if end else None
        return out, table.slice(end).to_batches()

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= TILE_ROWS:
            out, held = done(False)
            n = 0  # what is held is part of one tile
            if out is not None:
                yield from out.to_batches()
    if held and sum(map(len, held)):
        yield from done(True)[0].to_batches()


def _label_part(batches: Iterator[pa.RecordBatch], by: list[str], eps: float, min_samples: int, tile: int, origin: int = 0) -> Iterator[pa.RecordBatch]:
    """Label the tiles of one partition."""
    kernel = partial(_label_tiles, by=by, eps=eps, min_samples=min_samples, tile=tile, origin=origin)
    yield from tiles_together(batches, [*by, "_ty", "_tx"], kernel)


def in_tiles(rows: DataFrame, halo: int, tile: int, origin: int = 0) -> DataFrame:
    """A copy of each cell for every tile (``_ty``, ``_tx``) that it lies in or near; a missing position has a tile of its own."""
    for name, axis in (("_ty", "y"), ("_tx", "x")):
        rows = rows.withColumn(name, F.explode_outer(F.sequence(F.floor((F.col(axis) - origin - halo) / tile), F.floor((F.col(axis) - origin + halo) / tile))))
    return rows


def connected_labels(edges: DataFrame, by: list[str]) -> DataFrame:
    """Smallest node id of every connected component: columns (by, node, root).

    Minimum labels travel along edges and then jump through their own label,
    so long chains halve at every round.
    """
    both = edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(*by, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    while True:
        seen = labels.select(*by, F.col("node").alias("b"), F.col("root").alias("_near"))
        spread = both.join(seen, [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        step = labels.join(spread, [*by, "node"], "left").withColumn("_to", F.least("root", F.coalesce("_near", "root")))
        jump = labels.select(*by, F.col("node").alias("_to"), F.col("root").alias("_far"))
        step = step.join(jump, [*by, "_to"], "left").select(
            *by, "node", F.least("_to", F.coalesce("_far", "_to")).alias("new"), F.col("root").alias("old"))
        step = cut_lineage(step)
        labels = step.select(*by, "node", F.col("new").alias("root"))
        if step.where(F.col("new") != F.col("old")).isEmpty():
            return labels


def label_cells(cells: DataFrame, by: list[str], crit: str = "crit", eps: float = 1.0, min_samples: int = 4,
                size_filter: int = 10, tile: int = 64, counted: str | None = None) -> DataFrame:
    """Cluster cyclonic and anticyclonic cells of each slice.

    Returns the member cells with ``cluster`` numbered 1..k per slice in order
    of first appearance, negative for anticyclonic clusters.  ``eps`` is in
    cells, ``min_samples`` counts the cell itself, clusters below
    ``size_filter`` cells are dropped before numbering.  ``counted`` names a
    column for the number of cells of the cluster.
    """
    halo = 2 * int(math.floor(eps))
    rows = cells.where(F.col(crit) != 0).select(
        *by, F.signum(crit).cast("int").alias("_sign"), F.col("y").cast("int"), F.col("x").cast("int"),
        F.col(crit).cast("double").alias("crit"))
    origin = -halo  # the first rows and columns of a grid are near no other tile
    tiled = in_tiles(rows.where("y IS NOT NULL AND x IS NOT NULL"), halo, tile, origin)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by)
    schema = f"{kinds}, `_sign` int, kind int, comp long, first long, others array<long>, cells array<struct<cid: long, crit: double>>"
    kernel = partial(_label_part, by=by, eps=eps, min_samples=min_samples, tile=tile, origin=origin)
    groups = [*by, "_ty", "_tx"]
    parts = cut_lineage(spread(tiled, groups).sortWithinPartitions(*groups).mapInArrow(kernel, schema))

    keys = [*by, "_sign"]
    pieces = parts.where("kind = 0").drop("kind")
    # a core cell seen in a neighbour's halo ties that neighbour's component to ours
    links = parts.where("kind = 1").select(*keys, "first", F.col("comp").alias("a"))
    home = parts.where("kind = 2").select(*keys, "first", F.col("comp").alias("b"))
    edges = cut_lineage(links.join(home, [*keys, "first"]).where("a <> b").select(*keys, "a", "b").distinct())
    if edges.isEmpty():  # no component crosses a border: the first one of a cell is known
        member = pieces.drop("others").withColumnRenamed("comp", "_root")
    else:
        roots = connected_labels(edges, keys).select(*keys, F.col("node").alias("comp"), F.col("root").alias("_r"))

        def rooted(rows):
            return rows.join(roots, [*keys, "comp"], "left").withColumn("_root", F.coalesce("_r", "comp")).drop("_r", "comp")

        waiting = rooted(pieces.where("others IS NOT NULL").withColumn("comp", F.explode("others")).drop("others"))
        waiting = waiting.groupBy(*keys, "first").agg(F.first("cells").alias("cells"), F.min("_root").alias("_root"))
        member = rooted(pieces.where("others IS NULL").drop("others")).unionByName(waiting)
    size = member.groupBy(*keys, "_root").agg(F.sum(F.size("cells").cast("long")).alias("_n"), F.min("first").alias("_first"))
    big = size.where(F.col("_n") >= size_filter)
    # one row per cluster of a slice: far fewer than the slice's cells
    big = big.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy("_first")))
    # kept: what comes next reads the cells more than once
    out = cut_lineage(member.drop("first").join(big.drop("_first"), [*keys, "_root"]).select(
        *by, "cells", (F.col("_no") * F.col("_sign")).cast("int").alias("cluster"), "_n"))
    cid = F.col("_cell.cid")
    return out.withColumn("_cell", F.explode("cells")).select(
        *by, F.floor(cid / _ROW).cast("int").alias("y"), F.pmod(cid, F.lit(_ROW)).cast("int").alias("x"), F.col("_cell.crit").alias("crit"), "cluster",
        *([F.col("_n").alias(counted)] if counted else []))
