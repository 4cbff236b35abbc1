"""Statistics over the common life of every pair of two track sets.

The points two sets share in time are quadratic in their number, so pair rows are
never shuffled.  Tracks are dealt over blocks; every block of one set meets every
block of the other in one group, which returns one row a pair of tracks.  What is
shuffled is each point once per block of the other set.  Within a group points meet
in order of time and, under a distance limit, of place; counts and sums of a strip
of tracks are kept as arrays, so memory is bounded by the points of two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyrespark.functions import geo
from gyrespark.functions.text import micros
from gyrespark.operators import joins

BLOCK_TRACKS = 65_536  # at most, on average
BLOCK_POINTS = 1_000_000  # of a block, on average
BLOCK_MATCHES = 1 << 23  # points of one left track times right tracks, where tracks stay whole
SMALL = 2_000  # points below which more blocks do not pay
GRID = 16  # blocks a side that keep the cores busy
WHOLE_TRACKS = 2_048  # of a block, on average, where listed pairs of tracks meet
PAIRS = 1 << 18  # candidates looked at together
STRIP = 1 << 19  # pairs of tracks counted together
POINT = "array<struct<t: bigint, x: double, y: double>>"


def _position(x, y, sphere: bool):
    """Positions whose straight distance orders like the wanted one: as they are, or on the unit sphere."""
    import numpy as np

    if not sphere:
        return [x, y]
    lon, lat = np.radians(x), np.radians(y)
    return [np.cos(lat) * np.cos(lon), np.sin(lat), np.cos(lat) * np.sin(lon)]


def _points(table: pa.Table, sphere: bool):
    """Track number, time, position and whether there is one, of every point."""
    import numpy as np

    lists = table.column("pts").combine_chunks()
    code = np.repeat(np.arange(len(lists), dtype=np.int64), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    items = lists.flatten()
    t, x, y = (items.field(k) for k in range(3))
    known = ~(np.asarray(x.is_null()) | np.asarray(y.is_null()))
    place = _position(x.fill_null(0.0).to_numpy(zero_copy_only=False), y.fill_null(0.0).to_numpy(zero_copy_only=False), sphere)
    return code, t.to_numpy(zero_copy_only=False), place, known


def _index(b_t, b_place, limit, reach: int = 0):
    """Order of the points of b, and a function giving its ranges near points of a in time and, with a limit, in place."""
    import numpy as np

    if reach or limit is None or not len(b_t):
        order = np.argsort(b_t, kind="stable")
        t = b_t[order]
        return order, lambda a_t, _: [(np.searchsorted(t, a_t - reach, "left"), np.searchsorted(t, a_t + reach, "right"))]
    width = max(limit * (1 + 1e-6), 1e-9)  # wider than rounding
    times, rank = np.unique(b_t, return_inverse=True)
    cell = np.floor(b_place[0] / width)
    low, low_y, high_y = cell.min() - 1, b_place[1].min(), b_place[1].max()
    cells = int(cell.max() - low) + 2
    whole = rank * cells + (cell - low).astype(np.int64)
    order = np.lexsort((b_place[1], whole))
    starts = np.flatnonzero(np.r_[True, np.diff(whole[order]) != 0])
    groups = whole[order][starts]
    # one sorted key: the group of time and cell, the place within it; groups lie apart by more than rounding
    span = (high_y - low_y + 4 * width) * (1 + 1e-11 * len(groups))
    slack = 1e-12 * len(groups) * span
    number = np.repeat(np.arange(len(groups)), np.diff(np.r_[starts, len(order)]))
    key = number * span + (b_place[1][order] - low_y) + 2 * width

    def ranges(a_t, a_place):
        at = np.searchsorted(times, a_t)
        met = times[np.minimum(at, len(times) - 1)] == a_t
        out, y = [], a_place[1] - low_y
        edge = [np.clip(y + k * width, -width, high_y - low_y + width) + 2 * width + k * slack for k in (-1, 1)]
        for step in (-1, 0, 1):
            here = np.clip(np.floor(a_place[0] / width) + step - low, 0, cells - 1).astype(np.int64)
            g = np.minimum(np.searchsorted(groups, at * cells + here), len(groups) - 1)
            ok = met & (groups[g] == at * cells + here) & (np.abs(a_place[0] / width - low - here - 0.5) < 2.0)
            lo, hi = (np.searchsorted(key, g * span + e, side) for e, side in zip(edge, ("left", "right")))
            out.append((np.where(ok, lo, 0), np.where(ok, hi, 0)))
        return out

    return order, ranges


def _expanded(ranges, most: int) -> Iterator:
    """(points of a, places in the order of b) of the candidates, ``most`` at a time or one point's."""
    import numpy as np

    for lo, hi in ranges:
        n = hi - lo
        ends = np.cumsum(n)
        first = 0
        while first < len(n):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
            k = n[first:last]
            i = np.repeat(np.arange(first, last), k)
            j = np.arange(len(i)) - np.repeat(ends[first:last] - k - before, k) + np.repeat(lo[first:last], k)
            if len(i):
                yield i, j
            first = last


def _distance(a, i, b, j, sphere: bool):
    import numpy as np

    square = sum((p[i] - q[j]) ** 2 for p, q in zip(a, b))
    if not sphere:
        return np.sqrt(square)
    return 2.0 * geo.EARTH_RADIUS_KM * np.arcsin(np.minimum(np.sqrt(square) / 2.0, 1.0))


def _sides(batches):
    import numpy as np

    table = pa.Table.from_batches(list(batches))
    own = np.asarray(table.column("own").combine_chunks())
    return (table.filter(pa.array(~own)), table.filter(pa.array(own)))


def _strips(a, n_ref: int, n_own: int):
    """(first track, tracks, points) of strips of the left tracks, each of few pairs."""
    import numpy as np

    order = np.argsort(a[0], kind="stable")
    size = max(1, STRIP // max(1, n_own))
    for first in range(0, n_ref, size):
        lo, hi = np.searchsorted(a[0][order], [first, first + size])
        at = order[lo:hi]
        at = at[np.argsort(a[1][at], kind="stable")]  # in time order, so neighbours read neighbours
        yield first, min(size, n_ref - first), (a[0][at] - first, a[1][at], [p[at] for p in a[2]], a[3][at])


def _batch(ref, own, first: int, hit, columns: dict, carried: tuple = ((), ())) -> pa.RecordBatch:
    """Rows of the pairs ``hit`` (left track of the strip times right tracks plus right track)."""
    at, names, ids = (first + hit // len(own), hit % len(own)), [], []
    for table, rows, columns_of in ((ref, at[0], ("id_ref", *carried[0])), (own, at[1], ("id_own", *carried[1]))):
        ids += [table.column(c).combine_chunks().take(pa.array(rows)) for c in columns_of]
        names += columns_of
    return pa.RecordBatch.from_arrays([*ids, *[pa.array(v) for v in columns.values()]], names=[*names, *columns])


def _best_of(hit, n_own: int, n, mean, place, best: str, seen):
    """Of the pairs ``hit`` those that stand for the others, and for how many of their left track each does.

    ``steps`` and ``quality`` keep each left track's first pair in that order, ``some`` one pair of each left
    track and of each right track not ``seen`` yet.  ``place`` ranks the right tracks by id.
    """
    import numpy as np

    ref, own = hit // n_own, hit % n_own
    rank = (place[own], mean / n) if best == "quality" else (place[own], mean, -n)
    order = np.lexsort((*rank, ref))
    starts = np.flatnonzero(np.r_[True, np.diff(ref[order]) != 0]) if len(order) else order
    kept, stands = order[starts], np.diff(np.r_[starts, len(order)])
    if best == "some":
        new, at = np.unique(own, return_index=True)
        at = np.setdiff1d(at[~seen[new]], kept)
        seen[new] = True
        kept, stands = np.r_[kept, at], np.r_[stands, np.zeros(len(at), stands.dtype)]
    return kept, stands


def _best_by(group, score):
    """Rows whose score is the largest of their group, or less by no more than a rounding to nine digits hides."""
    import numpy as np

    order = np.lexsort((-score, group))
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else order
    top = np.repeat(score[order][starts], np.diff(np.r_[starts, len(order)]))
    return np.sort(order[~(score[order] < top - 2e-9)])


def _carried_by(ref, own, first: int, hit, carried: tuple):
    """The further columns of both tracks of the pairs ``hit``; times in microseconds."""
    def values(table, rows, names):
        columns = {c: table.column(c).combine_chunks() for c in names}
        return {c: (v.cast(pa.int64()) if pa.types.is_timestamp(v.type) else v).to_numpy(zero_copy_only=False)[rows] for c, v in columns.items()}

    return values(ref, first + hit // len(own), carried[0]), values(own, hit % len(own), carried[1])


def _common(batches: Iterator[pa.RecordBatch], limits, sphere: bool, scale: float, least: int, mean, reduced: bool,
            best: str | Callable | None, carried: tuple) -> Iterator[pa.RecordBatch]:
    """Equal-time statistics of the pairs of two blocks, strip by strip."""
    import numpy as np

    ref, own = _sides(batches)
    if not len(ref) or not len(own):
        return
    b = _points(own, sphere)
    straight = [None if k is None else 2.0 * math.sin(min(k / geo.EARTH_RADIUS_KM / 2.0, math.pi / 2)) if sphere else k / scale for k in limits]
    found = [(k, *_index(b[1], b[2], s)) for k, s in zip(limits, straight)]
    found = [(k, ranges, b[0][order], [p[order] for p in b[2]], b[3][order]) for k, order, ranges in found]
    if best:
        by_id = pc.sort_indices(own.column("id_own").combine_chunks(), null_placement="at_start").to_numpy()
        id_rank, seen = np.empty(len(own), np.int64), [np.zeros(len(own), bool) for _ in limits]
        id_rank[by_id] = np.arange(len(own))
    for first, tracks, a in _strips(_points(ref, sphere), len(ref), len(own)):
        cells = tracks * len(own)
        for which, (limit, ranges, codes, place, known) in enumerate(found):
            near = ranges(a[1], a[2])

            def walk(near=near, limit=limit, codes=codes, place=place, known=known):
                for i, j in _expanded(near, PAIRS):
                    d = _distance(a[2], i, place, j, sphere) * scale
                    at, ok = a[0][i] * len(own) + codes[j], a[3][i] & known[j]
                    if limit is not None:
                        ok &= d <= limit
                        at, d, ok = at[ok], d[ok], ok[ok]
                    yield at, d, ok

            def folded(kept=None, walk=walk, cells=cells):
                n, valid, total = np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.zeros(cells)
                for at, d, ok in walk():
                    every = np.bincount(at, minlength=cells)
                    n += every
                    ok = ok if kept is None else ok & kept(at, d)
                    if ok.all():
                        valid += every
                        total += np.bincount(at, d, minlength=cells)
                    else:
                        valid += np.bincount(at[ok], minlength=cells)
                        total += np.bincount(at[ok], d[ok], minlength=cells)
                return n, valid, total

            n, valid, total = folded()
            if reduced:
                m = total / np.maximum(valid, 1)
                spread = np.zeros(cells)
                for at, d, ok in walk():
                    spread += np.bincount(at[ok], (d[ok] - m[at[ok]]) ** 2, minlength=cells)
                edge = m + 2.0 * np.sqrt(spread / np.maximum(valid, 1)) + 1e-9  # rounding must not drop a point on the edge
                _, valid, total = folded(lambda at, d: d <= edge[at])
            keep = n >= max(1, least)
            if reduced:
                keep &= valid > 0
            if mean is not None:
                keep &= (valid > 0) & (total <= mean * np.maximum(valid, 1) * (1 + 1e-12))
            hit = np.flatnonzero(keep)
            stands = np.ones(len(hit), np.int64)
            if best:
                average = np.divide(total[hit], valid[hit], out=np.full(len(hit), np.nan), where=valid[hit] > 0)
                if mean is not None:  # what is left out later must not stand for others
                    hit, average = hit[average <= mean], average[average <= mean]
                if callable(best):
                    kept = _best_by(hit // len(own), best(n[hit], average, *_carried_by(ref, own, first, hit, carried)))
                    stands = np.ones(len(kept), np.int64)
                else:
                    kept, stands = _best_of(hit, len(own), n[hit], average, id_rank, best, seen[which])
                hit = hit[kept]
            for start in range(0, len(hit), 500_000):
                h = hit[start:start + 500_000]
                yield _batch(ref, own, first, h, {"which": np.full(len(h), which, np.int32), "n": n[h], "n_valid": valid[h], "total": total[h],
                                                  "n_pairs": stands[start:start + 500_000]}, carried)


def _nearest(batches: Iterator[pa.RecordBatch], limit: float, sphere: bool, reach: int, least: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks by each left point's nearest point in time of the right track."""
    import numpy as np

    ref, own = _sides(batches)
    if not len(ref) or not len(own):
        return
    b = _points(own, sphere)
    order = np.argsort(b[1], kind="stable")
    codes, t, place, known = b[0][order], b[1][order], [p[order] for p in b[2]], b[3][order]
    for first, tracks, a in _strips(_points(ref, sphere), len(ref), len(own)):
        cells, step = tracks * len(own), max(1, PAIRS // len(own))

        def walk(a=a, step=step):
            for at in range(0, len(a[0]), step):
                some = slice(at, at + step)
                when = a[1][some]
                last = np.searchsorted(t, when, "right")
                sides = []
                for lo, hi in ((np.searchsorted(t, when - reach, "left"), last), (last, np.searchsorted(t, when + reach, "right"))):
                    nearest = np.full(len(when) * len(own), -1, np.int64)
                    for i, j in _expanded([(lo, hi)], PAIRS):
                        if sides:  # of the later points a track's first counts, so it is written last
                            i, j = i[::-1], j[::-1]
                        nearest[i * len(own) + codes[j]] = j
                    sides.append(nearest)
                before, after = sides
                slot = np.flatnonzero((before >= 0) | (after >= 0))
                i, before, after = slot // len(own), before[slot], after[slot]
                earlier = (after < 0) | ((before >= 0) & (when[i] - t[before] <= t[after] - when[i]))
                j, i = np.where(earlier, before, after), i + at
                d = _distance(a[2], i, place, j, sphere)
                yield a[0][i] * len(own) + codes[j], d, a[3][i] & known[j] & (d <= limit)

        n, close, total = np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.zeros(cells)
        for at, d, ok in walk():
            n += np.bincount(at, minlength=cells)
            close += np.bincount(at[ok], minlength=cells)
            total += np.bincount(at[ok], d[ok], minlength=cells)
        keep = (n == close) & (n >= max(1, least)) if every else close >= max(1, least)
        hit = np.flatnonzero(keep)
        value = total[hit] / close[hit]
        if every and len(hit):
            seen = [(at[keep[at]], d[keep[at]]) for at, d, _ in walk()]
            at, d = (np.concatenate(c) for c in zip(*seen))
            d = d[np.lexsort((d, at))]  # the distances of one pair after the other, each in order
            middle = np.cumsum(n[hit]) - n[hit] + (n[hit] - 1) / 2.0
            low, high = d[np.floor(middle).astype(np.int64)], d[np.ceil(middle).astype(np.int64)]
            value = low + (high - low) * (middle - np.floor(middle))
        if len(hit):
            yield _batch(ref, own, first, hit, {"n_steps": close[hit], "value": value})


def _size(df: DataFrame, key: str, time: str):
    t = micros(time)
    per = df.where(t.isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"))
    return per.agg(F.count(F.lit(1)).alias("tracks"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"),
                   F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()


def _blocks(size, most: int) -> int:
    enough = max(math.ceil(size["tracks"] / most), math.ceil(size["points"] / BLOCK_POINTS))
    return max(enough, min(GRID, math.ceil(size["points"] / SMALL)), 1)


def _meet(left: DataFrame, right: DataFrame, left_id: str, right_id: str, time: str, x: str, y: str, located: bool,
          whole_tracks: bool = False, within: tuple[float, bool] | None = None,
          carry: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> tuple[DataFrame, bool]:
    """Both sets packed by track and dealt to the blocks of the other one, and whether tracks are cut in time.

    ``within`` (distance, whether on the sphere) leaves out blocks that have no neighbouring cells.
    ``carry`` holds a row of further columns for each track of either set.
    """
    sizes = _size(left, left_id, time), _size(right, right_id, time)
    longest = max(s["longest"] for s in sizes)
    most = max(1, min(BLOCK_TRACKS, BLOCK_MATCHES // max(1, longest))) if whole_tracks else BLOCK_TRACKS
    n_a, n_b = (_blocks(s, most) for s in sizes)
    cuts = 1 if whole_tracks else max(1, math.ceil(longest / BLOCK_POINTS))
    ends = [s[c] for s in sizes for c in ("lo", "hi") if s[c] is not None]
    era = F.floor(F.col("t") / F.lit((max(ends) - min(ends)) // cuts + 1)) if cuts > 1 else F.lit(0).cast("long")

    more = {name: None if df is None else df.withColumnRenamed(key, name) for df, key, name in zip(carry, (left_id, right_id), ("id_ref", "id_own"))}
    extra = {name: [] if df is None else [c for c in df.columns if c != name] for name, df in more.items()}

    def side(df: DataFrame, key: str, name: str, blocks: int) -> DataFrame:
        at = df.select(F.col(key).alias(name), micros(time).alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        at = at.where("t IS NOT NULL AND x - x = 0 AND y - y = 0" if located else "t IS NOT NULL")  # no missing or endless position
        return at.withColumns({"_home": F.pmod(F.xxhash64(name), F.lit(blocks)), "_era": era})

    def packed(at: DataFrame, name: str) -> DataFrame:
        out = at.groupBy("_home", name, "_era").agg(F.collect_list(F.struct("t", "x", "y")).cast(POINT).alias("pts"))
        return out if more[name] is None else out.join(more[name], name)

    a, b = side(left, left_id, "id_ref", n_a), side(right, right_id, "id_own", n_b)
    if within is None:
        others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        a, b = (packed(a, "id_ref").withColumnRenamed("_home", "_i").withColumn("_j", others(n_b)),
                packed(b, "id_own").withColumnRenamed("_home", "_j").withColumn("_i", others(n_a)))
    else:
        near, cell = joins.neighbour_cells("x", "y", *within)
        met = a.select(F.col("_home").alias("_i"), F.explode(near).alias("_cell")).distinct().join(
            b.select(F.col("_home").alias("_j"), cell.alias("_cell")).distinct(), "_cell").select("_i", "_j").distinct()
        a, b = (packed(a, "id_ref").withColumnRenamed("_home", "_i").join(met, "_i"), packed(b, "id_own").withColumnRenamed("_home", "_j").join(met, "_j"))
    a = a.select("_i", "_j", "_era", F.lit(False).alias("own"), "id_ref", "pts", *extra["id_ref"])
    b = b.select("_i", "_j", "_era", F.lit(True).alias("own"), "id_own", "pts", *extra["id_own"])
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n_a * n_b, 1024))
    rows = a.unionByName(b, allowMissingColumns=True).repartition(parts, "_i", "_j", "_era")
    return rows.groupBy("_i", "_j", "_era"), cuts > 1


def _types(left: DataFrame, left_id: str, right: DataFrame, right_id: str) -> str:
    return f"id_ref {left.select(left_id).schema[0].dataType.simpleString()}, id_own {right.select(right_id).schema[0].dataType.simpleString()}"


def common_time(left: DataFrame, right: DataFrame, left_id: str, right_id: str, time: str, x: str, y: str,
                limits: list[float] | None = None, sphere: bool = False, scale: float = 1.0, least: int = 1,
                mean: float | None = None, reduced: bool = False, within: float | None = None,
                best: str | Callable | None = None, carry: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """(id_ref, id_own, which, n, avg_dist) over the equal-time points of every pair of tracks.

    ``limits`` count only points within each of these distances (``which`` is its
    place in the list), else every common time counts and the mean is over those
    where both have a position.  ``least`` points and a ``mean`` of at most that are
    asked for.  Distances are of ``x`` and ``y`` times ``scale``, or in km on the
    ``sphere``.  With ``reduced`` the mean leaves out points beyond mean + 2 sigma.
    Only pairs that come ``within`` a distance at some time are of interest, if given.

    ``best`` leaves pairs out that the caller's selection does not need: of every left track
    the pair of most points, then least mean, then lowest id_own is there (``steps``), or that
    of the least mean by points (``quality``), and a track that has a pair stays in one of each
    set (``some``).  A function of points, mean and the columns carried for both tracks gives a
    score instead, of which the largest to nine digits are there.  More may be; ``n_pairs`` of a left track's rows add up to the number of its
    pairs, if not chosen by score.  ``carry`` holds frames of further columns by ``left_id`` and ``right_id``, one row a
    track; tracks without a row, or an id, drop out.
    """
    close = None if within is None else (within / scale, sphere)
    groups, cut = _meet(left, right, left_id, right_id, time, x, y, limits is not None or reduced, reduced, close, carry)
    if cut or isinstance(right.schema[right_id].dataType, (T.StructType, T.ArrayType, T.MapType)):
        chosen = None
    else:
        chosen = best
    carried = tuple([] if df is None else [f for f in df.schema if f.name != key] for df, key in zip(carry, (left_id, right_id)))
    names = tuple([f.name for f in fields] for fields in carried)
    kernel = partial(_common, limits=limits or [None], sphere=sphere, scale=scale, least=1 if cut else least,
                     mean=None if cut else mean, reduced=reduced, best=chosen, carried=names)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)

    kinds = [", ".join([f"id_{side} {df.schema[key].dataType.simpleString()}", *[f"`{f.name}` {f.dataType.simpleString()}" for f in fields]])
             for side, df, key, fields in (("ref", left, left_id, carried[0]), ("own", right, right_id, carried[1]))]
    out = groups.applyInArrow(pairs, f"{kinds[0]}, {kinds[1]}, which int, n long, n_valid long, total double, n_pairs long")
    more = [c for side in names for c in side]
    if cut:
        out = out.groupBy("id_ref", "id_own", "which").agg(*[F.sum(c).alias(c) for c in ("n", "n_valid", "total")], F.lit(1).cast("long").alias("n_pairs"),
                                                           *[F.first(c).alias(c) for c in more])
    out = out.select("id_ref", "id_own", "which", "n", F.when(F.col("n_valid") > 0, F.col("total") / F.col("n_valid")).alias("avg_dist"),
                     *(["n_pairs"] if best else []), *more)
    if least > 1:
        out = out.where(F.col("n") >= least)
    return out if mean is None else out.where(F.col("avg_dist") <= mean)


def nearest_time(left: DataFrame, right: DataFrame, left_id: str, right_id: str, time: str, x: str, y: str, limit: float,
                 tolerance_hours: float, least: int, sphere: bool = False, every: bool = False) -> DataFrame:
    """(id_ref, id_own, n_steps, value) from each left point's nearest point in time of every right track.

    The earlier one counts on a tie.  A pair needs ``least`` of them (one at least)
    within the distance, and ``value`` is their mean; with ``every`` all of them must
    be, and it is their median.
    """
    groups, _ = _meet(left, right, left_id, right_id, time, x, y, False, True, (limit, sphere))
    kernel = partial(_nearest, limit=limit, sphere=sphere, reach=int(tolerance_hours * 3_600_000_000), least=least, every=every)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)

    return groups.applyInArrow(pairs, f"{_types(left, left_id, right, right_id)}, n_steps long, value double")


def _resampled(tracks: pa.Table, rows, low, high, length: int):
    """x and y of ``length`` steps over the points of each track ``rows`` from ``low`` to ``high``, and how many points there are."""
    import numpy as np

    lists = tracks.column("pts").combine_chunks()
    code = np.repeat(np.arange(len(lists), dtype=np.int64), lists.value_lengths().to_numpy(zero_copy_only=False))
    t, *place = (lists.flatten().field(k) for k in range(3))
    t = t.to_numpy(zero_copy_only=False)
    order = np.lexsort((t, code))
    times, rank = np.unique(t, return_inverse=True)
    key = code[order] * (len(times) + 1) + rank[order]
    start = np.searchsorted(key, rows * (len(times) + 1) + np.searchsorted(times, low, "left"))
    n = np.searchsorted(key, rows * (len(times) + 1) + np.searchsorted(times, high, "right")) - start
    n = np.where(rows >= 0, np.maximum(n, 0), 0)
    last, steps = np.maximum(n - 1, 0)[:, None], np.arange(length)
    i = steps * last // (length - 1)
    part = steps * last / (length - 1.0) - i
    at = np.minimum(start[:, None] + i, max(len(key) - 1, 0))
    after = np.minimum(at + (part > 0), max(len(key) - 1, 0))
    if not len(key):
        return [np.zeros(at.shape)] * 2, np.zeros(at.shape, bool), n
    out, known = [], np.ones(at.shape, bool)
    for column in place:  # where the next value is missing this one holds
        there = ~np.asarray(column.is_null())[order]
        v = column.fill_null(0.0).to_numpy(zero_copy_only=False)[order]
        out.append(v[at] + np.where(there[after], v[after] - v[at], 0.0) * part)
        known &= there[at]
    return out, known, n


def _path_scores(pairs: pa.Table, tracks: pa.Table, length: int) -> pa.Table:
    """The pairs with the mean cosine of the steps of their resampled tracks, scaled to 0 to 1."""
    import numpy as np

    sides, score = [], np.full(len(pairs), 0.5)
    own = np.asarray(tracks.column("own").combine_chunks())
    for name, mine in (("id_ref", ~own), ("id_own", own)):
        table = tracks.filter(pa.array(mine))
        code = {v: k for k, v in enumerate(map(repr, table.column(name).to_pylist()))}
        sides.append((table, np.array([code.get(v, -1) for v in map(repr, pairs.column(name).to_pylist())], np.int64)))
    low, high = (pairs.column(c).fill_null(0).to_numpy() for c in ("_lo", "_hi"))
    for first in range(0, len(pairs), PAIRS // length):
        some = slice(first, first + PAIRS // length)
        (u, at_u, n_u), (v, at_v, n_v) = (_resampled(table, rows[some], low[some], high[some], length) for table, rows in sides)
        ux, uy, vx, vy = (np.diff(c, axis=1) for c in (*u, *v))
        size = np.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
        known = at_u[:, 1:] & at_u[:, :-1] & at_v[:, 1:] & at_v[:, :-1]
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.where(known & ~(size <= 0), (ux * vx + uy * vy) / size, 0.0)  # a step of no length counts as a right angle
        mean = np.fmin(np.maximum(cosine, -1.0), 1.0).mean(axis=1)
        score[some] = np.where((n_u > 0) & (n_v > 0), (mean + 1.0) / 2.0, 0.5)
    return pairs.drop_columns(["_i", "_j", "_lo", "_hi"]).append_column("path_score", pa.array(score))


def resampled_similarity(matches: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, time: str, x: str, y: str,
                         low: Column, high: Column, length: int) -> DataFrame:
    """``matches`` (id_ref, id_own, ...) with ``path_score`` of both tracks between ``low`` and ``high``, resampled to ``length`` positions.

    A listed pair goes once to the group of the blocks of its tracks, where both tracks are whole; its points are not copied for it.
    """
    n_a, n_b = (_blocks(_size(df, key, time), WHOLE_TRACKS) for df, key in ((left, left_id), (right, right_id)))
    home = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    def side(df: DataFrame, key: str, name: str, mine: str, other: str, n: int, others: int) -> DataFrame:
        at = df.select(F.col(key).alias(name), micros(time).alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        out = at.where("t IS NOT NULL").groupBy(name).agg(F.collect_list(F.struct("t", "x", "y")).cast(POINT).alias("pts"))
        return out.where(F.col(name).isNotNull()).select(home(name, n).alias(mine), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
                                                         F.lit(name == "id_own").alias("own"), name, "pts")

    tracks = side(left, left_id, "id_ref", "_i", "_j", n_a, n_b).unionByName(side(right, right_id, "id_own", "_j", "_i", n_b, n_a), allowMissingColumns=True)
    listed = matches.withColumns({"_i": home("id_ref", n_a), "_j": home("id_own", n_b), "_lo": micros(low), "_hi": micros(high)})
    schema = T.StructType([*matches.schema.fields, T.StructField("path_score", T.DoubleType())])

    def scored(pairs: pa.Table, tracks: pa.Table) -> pa.Table:
        return _path_scores(pairs, tracks, length)

    keys, parts = ["_i", "_j"], max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n_a * n_b, 1024))
    return listed.repartition(parts, *keys).groupBy(*keys).cogroup(tracks.repartition(parts, *keys).groupBy(*keys)).applyInArrow(scored, schema)
