"""Linking nodes into tracks.

At every step live tracks are served in order of strength; each takes the
nearest free detection inside its search radius, what is left over starts new
tracks.  Served one by one this is a loop over time; here it is a set of joins:

* Candidate edges are matched by groups of steps: a task serves its ends in order of
  strength, as far as no node outside the group can change the outcome.  What is left
  goes to groups that are cut elsewhere.  The outcome equals serving tracks one by one.
* Where what a track does depends on its past, a task serves the steps of a block in
  turn, from the ends that enter it.  All blocks start at once from assumed ends, and a
  block is served again only when other ends turn out to enter it.  By induction over
  time the fixed point is unique and equals the sequential result.
* Track ids follow from pointer doubling over the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyrespark.functions import geo
from gyrespark.operators import joins, ordered, sequences
from gyrespark.operators.pairs import _expanded
from gyrespark.operators.sets import union_all
from gyrespark.session import cut_lineage, spread


GROUP_EDGES = 1 << 20  # of one group of slots, on average
BLOCK_STEPS = 64  # steps served one after the other in one task
CANDIDATES = 1 << 20  # looked at together


@dataclass(frozen=True)
class ConeStep:
    """What a track slower than ``below`` m/s may do: the largest change of direction
    in degrees, and the sector around the expected position in which it is looked for
    (``full``, ``three_quarters``: not straight back, ``half``: ahead, ``narrow``: within
    half the largest change)."""

    below: float
    turn: float
    sector: str


# The material names the sectors but gives no table; this one is a choice.
CONE = (ConeStep(5.0, 180.0, "full"), ConeStep(10.0, 135.0, "three_quarters"), ConeStep(20.0, 90.0, "half"),
        ConeStep(30.0, 60.0, "narrow"), ConeStep(float("inf"), 45.0, "narrow"))
SECTORS = {"full": 180.0, "three_quarters": 135.0, "half": 90.0}  # half-angle; straight back is 45 degrees wide on each side


@dataclass(frozen=True)
class LinkRule:
    """How tracks are continued.

    ``policy``: ``points`` (a detection is used once), ``centres`` (one node per
    cluster) or ``cluster`` (a used extremum consumes its whole cluster and new
    tracks start only at cluster centres).
    ``predictor``: ``none``, ``adv`` (repeat the last displacement), ``bg``
    (background wind for the first step, then ``adv``) or ``adv_bg`` (mean of both).
    ``metric``: ``index`` (cells, strict radius) or ``km`` (great circle, inclusive).
    ``cone``: speed classes, slowest first.  A track with a past is expected where
    its last displacement leads (on the sphere in km, off the grid too), within that
    displacement plus the scaled radius, both strict; candidates that turn too far
    are left out, and with ``sectors`` those outside the class's sector around the
    expected position.  A candidate at the last or the expected position has no
    direction and passes.  ``step_s`` is the time of a step, ``cell_m`` the size of
    a cell for speeds in the index metric.
    """

    policy: str = "points"
    predictor: str = "none"
    metric: str = "index"
    hw_scale: float = 1.5
    min_points: int = 3
    cone: tuple[ConeStep, ...] | None = None
    sectors: bool = True
    step_s: float = 3600.0
    cell_m: float = 27_750.0


# Tracking variants by name.
RULES = {
    "global_only": LinkRule(policy="centres"),
    "local_extrema": LinkRule(policy="cluster"),
    "local_only": LinkRule(policy="points"),
    "local_2_phase": LinkRule(policy="points"),
    "local_2_phase_cone": LinkRule(policy="points", predictor="adv", cone=CONE),
    "local_2_phase_cone_km": LinkRule(policy="points", predictor="adv", metric="km", cone=CONE, sectors=False),
    "global_only_km": LinkRule(policy="centres", metric="km"),
    "local_extrema_km": LinkRule(policy="cluster", metric="km"),
    "local_only_km": LinkRule(policy="points", metric="km"),
    "local_2_phase_km": LinkRule(policy="points", metric="km"),
}


def register_rule(name: str, rule: LinkRule) -> None:
    RULES[name] = rule


def _rank_keys(column: pa.ChunkedArray) -> list:
    """Sort keys of a struct column, its first field last, as lexsort wants them; nulls come first."""
    import numpy as np

    fields = column.combine_chunks().flatten()
    fields = [f if pa.types.is_floating(f.type) else f.cast(pa.int64()) for f in fields]
    keys = [f.fill_null(-np.inf if pa.types.is_floating(f.type) else np.iinfo(np.int64).min) for f in fields]
    return [k.to_numpy(zero_copy_only=False) for k in reversed(keys)]


def _serve_group(batches: Iterator[pa.RecordBatch], width: int, shift: int, reach: int) -> Iterator[pa.RecordBatch]:
    """Serve the ends of one group of slots in order of priority, as far as the group decides them.

    Where the first free item of an end may be taken by an end of another group, or by an undecided end
    before it, the end is undecided and keeps what is left of its edges.  Rows with ``settled`` are pairs.
    """
    import numpy as np

    table = pa.Table.from_batches(list(batches))
    if not len(table):
        return
    at, to = (table.column(c).to_numpy() for c in ("at", "to"))
    ends, first, end_of = np.unique(table.column("a").to_numpy(), return_index=True, return_inverse=True)
    items, item_of = np.unique(table.column("b").to_numpy(), return_inverse=True)
    turn = np.empty(len(ends), np.int64)
    turn[np.lexsort(_rank_keys(table.column("prio").take(pa.array(first))))] = np.arange(len(ends))
    order = np.lexsort((*_rank_keys(table.column("pref")), turn[end_of]))
    low = (at[0] + shift) // width * width - shift
    outside = np.zeros(len(items), bool)
    outside[item_of[(to - reach < low) | (to > low + width)]] = True
    starts = np.searchsorted(turn[end_of][order], np.arange(len(ends) + 1)).tolist()
    wanted, closed, taken, kept, pairs = item_of[order].tolist(), outside.tolist(), [False] * len(items), [], []
    for k in range(len(ends)):
        for e in range(starts[k], starts[k + 1]):
            item = wanted[e]
            if taken[item]:
                continue
            if not closed[item]:
                taken[item] = True
                pairs.append(e)
                break
            left = [i for i in range(e, starts[k + 1]) if not taken[wanted[i]]]
            for i in left:
                closed[wanted[i]] = True
            kept += left
            break
    rows = table.take(pa.array(order[np.array(pairs + kept, np.int64)]))
    settled = pa.array(np.arange(len(rows)) < len(pairs))
    yield from rows.append_column("settled", settled).to_batches()


def _on_batches(kernel: Callable) -> Callable:
    def served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)

    return served


def dominant_matching(edges: DataFrame) -> DataFrame:
    """Match ``a`` with ``b`` when each is served in order of priority.

    ``edges`` has columns a, b, pref (a struct, smaller is preferred by a), prio (a struct,
    smaller is served first; unique per a), part and the slots at of a and to of b, of which
    to is the later one; only edges of one part share nodes.  Returns (a, b).

    Slots are cut into groups, which settle what does not depend on other groups.  The cuts
    move from round to round, and groups grow as edges get fewer, so every round settles some
    and the last ones, whatever the order of priority, few rounds are needed.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    left, done, turn = cut_lineage(edges.select("part", "a", "b", "pref", "prio", F.col("at").cast("long"), F.col("to").cast("long"))), [], 0
    while True:
        size = left.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("to") - F.col("at")).alias("reach"), F.min("at").alias("lo"), F.max("at").alias("hi")).first()
        if not size["n"]:
            return union_all(done) if done else left.select("a", "b")
        reach, slots = int(size["reach"]), size["hi"] - size["lo"] + 1
        wide = -(-slots * GROUP_EDGES // size["n"])
        width = 1 if reach == 1 else max(2 * reach, wide if done else min(wide, 8 * reach))
        shift = turn % 2 * (width // 2) - size["lo"]
        grouped = left.withColumn("_group", F.floor((F.col("at") + F.lit(shift)) / F.lit(width)))
        kernel = _on_batches(partial(_serve_group, width=width, shift=shift, reach=reach))
        schema = T.StructType([*grouped.schema.fields, T.StructField("settled", T.BooleanType())])
        out = cut_lineage(spread(grouped, ["part", "_group"]).groupBy("part", "_group").applyInArrow(kernel, schema).drop("_group"))
        done.append(out.where("settled").select("a", "b"))
        left, turn = out.where("NOT settled").drop("settled"), turn + 1


def _edges(ends: DataFrame, nodes: DataFrame, by: list[str], rule: LinkRule,
           axes: tuple[float, float, float, float] | None, reach: float) -> DataFrame:
    """Candidate continuations of ends that stay where they are, with preference and priority."""
    a = ends.select(*by, (F.col("t") + 1).alias("t"), F.col("node_id").alias("a"), F.abs("crit").alias("_ca"),
                    F.col("rad").alias("_ra"), F.col("x").cast("double").alias("_px"), F.col("y").cast("double").alias("_py"))
    b = nodes.select(*by, "t", F.col("node_id").alias("b"), F.abs("crit").alias("_cb"), F.col("x").alias("_bx"), F.col("y").alias("_by"))
    if rule.metric == "km":
        lon0, dlon, lat0, dlat = axes
        a = a.withColumn("_plon", F.lit(lon0) + F.col("_px") * dlon).withColumn("_plat", F.lit(lat0) + F.col("_py") * dlat)
        b = b.withColumn("_blon", F.lit(lon0) + F.col("_bx") * dlon).withColumn("_blat", F.lit(lat0) + F.col("_by") * dlat)
        radius = geo.radius_cells_to_km("_ra", "_plat", abs(dlon), abs(dlat))
        a = cut_lineage(a.withColumn("_limit", rule.hw_scale * radius))
        # buckets are as wide as the largest radius of this round
        widest = a.agg(F.max("_limit").alias("m")).first()["m"] or 1.0
        band = max(float(widest), 1e-3) / geo.EARTH_RADIUS_KM * 57.29577951308232
        a = a.withColumn("_cell", F.explode(joins._band_cells("_plon", "_plat", band)["_cells"]))
        b = b.withColumn("_cell", joins._band_cell("_blon", "_blat", band))
        pairs = a.hint("merge").join(b, [*by, "t", "_cell"]).withColumn("_d", geo.haversine_km("_plon", "_plat", "_blon", "_blat"))
        pairs = pairs.where(F.col("_d") <= F.col("_limit"))
    else:
        cell = max(1.0, float(reach))
        a = a.withColumn("_limit", rule.hw_scale * F.col("_ra"))
        for k in "xy":
            a = a.withColumn(f"_g{k}", F.explode(F.sequence(F.floor((F.col(f"_p{k}") - F.col("_limit")) / cell),
                                                            F.floor((F.col(f"_p{k}") + F.col("_limit")) / cell))))
            b = b.withColumn(f"_g{k}", F.floor(F.col(f"_b{k}") / F.lit(cell)))
        pairs = a.hint("merge").join(b, [*by, "t", "_gx", "_gy"]).withColumn("_d", geo.euclid("_px", "_py", "_bx", "_by"))
        pairs = pairs.where(F.col("_d") < F.col("_limit"))
    return pairs.select(_part(by).alias("part"), (F.col("t") - 1).alias("at"), F.col("t").alias("to"), "a", "b",
                        F.struct("_d", (-F.col("_cb")).alias("c"), "b").alias("pref"), F.struct((-F.col("_ca")).alias("c"), "a").alias("prio"))


def _part(by: list[str]) -> Column:
    return F.struct(*by) if by else F.struct(F.lit(0).alias("p"))


def _haversine(lon1, lat1, lon2, lat2):
    import numpy as np

    la1, la2 = np.radians(lat1), np.radians(lat2)
    half = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return 2.0 * geo.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(half, 0.0, 1.0)))


def _bearing(lon1, lat1, lon2, lat2):
    import numpy as np

    la1, la2, dlon = np.radians(lat1), np.radians(lat2), np.radians(lon2) - np.radians(lon1)
    return np.degrees(np.arctan2(np.sin(dlon) * np.cos(la2), np.cos(la1) * np.sin(la2) - np.sin(la1) * np.cos(la2) * np.cos(dlon))) % 360.0


def _apart(a, b):
    import numpy as np

    d = (a - b) % 360.0
    return np.minimum(d, 360.0 - d)


class _Step:
    """Candidates of the ends of one step among the nodes of the next, as ``_edges`` and ``_inside_cone`` have them, with a past."""

    def __init__(self, rule: LinkRule, shape: tuple[int, int], axes: tuple[float, float, float, float] | None):
        self.rule, self.shape, self.axes, self.km = rule, shape, axes, rule.metric == "km"

    def _place(self, x, y):
        return (self.axes[0] + x * self.axes[1], self.axes[2] + y * self.axes[3]) if self.km else (x, y)

    def _direction(self, p, q):
        import numpy as np

        return _bearing(*p, *q) if self.km else np.degrees(np.arctan2(q[0] - p[0], q[1] - p[1]))

    def _distance(self, p, q):
        import numpy as np

        return _haversine(*p, *q) if self.km else np.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))

    def _expected(self, ends: dict) -> dict:
        """Where the ends are looked for, how far, and how they move."""
        import numpy as np

        rule, at, past = self.rule, [ends["x"], ends["y"]], [ends["px"], ends["py"]]
        known = ~np.isnan(past[0])
        if rule.cone is not None:  # not held to the grid
            pos = [np.where(known, 2.0 * a - p, a) for a, p in zip(at, past)]
        elif rule.predictor == "none":
            pos = at
        else:
            held = lambda v, n: np.where(np.isnan(v), 0.0, np.minimum(np.maximum(v, 0.0), n - 1.0))
            moved = [held(2 * a - p, n) for a, p, n in zip(at, past, self.shape[::-1])]
            if rule.predictor == "adv":
                pos = [np.where(known, m, a) for m, a in zip(moved, at)]
            else:
                wind = [held(a + ends[c], n) for a, c, n in zip(at, ("bg_dx", "bg_dy"), self.shape[::-1])]
                pos = [np.where(known, (m + w) / 2 if rule.predictor == "adv_bg" else m, w) for m, w in zip(moved, wind)]
        out = {"want": self._place(*pos)}
        here = out["here"] = self._place(*at)
        scale = 1.0
        if self.km:
            dlon, dlat = abs(self.axes[1]), abs(self.axes[3])
            scale = np.sqrt(np.maximum(geo.KM_PER_DEG * dlon * np.cos(np.radians(here[1])) * (geo.KM_PER_DEG * dlat), 0.0))
        out["limit"] = rule.hw_scale * (ends["rad"] * scale)
        if rule.cone is not None:
            before = self._place(*past)
            moved = out["moved"] = np.nan_to_num(self._distance(before, here))
            way = out["way"] = self._direction(before, here)
            if self.km:
                la, lo, b, d = np.radians(here[1]), np.radians(here[0]), np.radians(way), moved / geo.EARTH_RADIUS_KM
                la2 = np.arcsin(np.clip(np.sin(la) * np.cos(d) + np.cos(la) * np.sin(d) * np.cos(b), -1.0, 1.0))
                lo2 = lo + np.arctan2(np.sin(b) * np.sin(d) * np.cos(la), np.cos(d) - np.sin(la) * np.sin(la2))
                out["want"] = tuple(np.where(moved > 0, v, w) for v, w in zip((np.degrees(lo2) % 360.0, np.degrees(la2)), out["want"]))
            out["speed"] = moved * (1000.0 if self.km else rule.cell_m) / rule.step_s
            out["limit"] = moved + out["limit"]
        return out

    def _allowed(self, e: dict, i, node, d):
        """Which of the candidates the speed classes of the cone allow; see ``_inside_cone``."""
        import numpy as np

        here, want, way = [tuple(v[i] for v in e[c]) for c in ("here", "want")] + [e["way"][i]]
        still = self._distance(here, node) == 0 if self.km else (here[0] == node[0]) & (here[1] == node[1])
        turn, aside = _apart(self._direction(here, node), way), _apart(self._direction(want, node), way)
        inside, tiny = np.zeros(len(i), bool), 5e-10  # half a billionth, as the angles are rounded
        for step in reversed(self.rule.cone):
            ok = still | (turn < step.turn + tiny)
            if self.rule.sectors and step.sector != "full":
                wide = SECTORS.get(step.sector, step.turn / 2)
                ok &= (d == 0) | (aside < wide + (-tiny if step.sector == "three_quarters" else tiny))
            inside = np.where(e["speed"][i] < step.below, ok, inside)
        return (e["moved"][i] == 0) | inside

    def candidates(self, ends: dict, nodes: dict):
        """(end, node, distance) of the candidates."""
        import numpy as np

        e = self._expected(ends)
        where = self._place(nodes["x"], nodes["y"])
        order = np.argsort(where[1], kind="stable")  # missing positions come last
        rows = where[1][order]
        reach = np.nan_to_num(np.degrees(e["limit"] / geo.EARTH_RADIUS_KM) if self.km else e["limit"], nan=-1.0) * (1 + 1e-9) + 1e-9
        lo, hi = np.searchsorted(rows, e["want"][1] - reach), np.searchsorted(rows, e["want"][1] + reach, "right")
        found = []
        for i, j in _expanded([(lo, np.maximum(lo, hi))], CANDIDATES):
            j = order[j]
            node = tuple(v[j] for v in where)
            d = self._distance(tuple(v[i] for v in e["want"]), node)
            near = d <= e["limit"][i] if self.km and self.rule.cone is None else d < e["limit"][i]
            if self.rule.cone is not None:
                near &= self._allowed(e, i, node, d)
            found.append((i[near], j[near], d[near]))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _serve_block(batches: Iterator[pa.RecordBatch], step: _Step, by_cluster: bool) -> Iterator[pa.RecordBatch]:
    """Serve the steps of a block one after the other, from the ends that enter it.

    Rows come back with ``live`` (a member of a track), ``prev_id`` and the position before.
    """
    import numpy as np

    table = pa.Table.from_batches(list(batches))
    number = lambda c: table.column(c).cast(pa.float64()).to_numpy()  # noqa: E731, nulls become NaN
    t, enters = table.column("t").to_numpy(), np.asarray(table.column("enters").combine_chunks())
    ids = table.column("node_id").fill_null(np.iinfo(np.int64).min).to_numpy()
    n, own = len(t), ~enters
    target, birth = (np.asarray(table.column(c).combine_chunks()) for c in ("target", "birth"))
    values = {c: number(c) for c in ("x", "y", "rad", "px", "py", *[c for c in ("bg_dx", "bg_dy") if c in table.column_names])}
    for c in ("bg_dx", "bg_dy"):
        values[c] = np.nan_to_num(values[c], nan=0.0) if c in values else np.zeros(n)
    crit = number("crit")
    strength = np.where(np.asarray(table.column("crit").is_null()), -np.inf, -np.abs(crit))  # a missing one is served first
    cluster = table.column("cluster").cast(pa.int64()).to_pylist() if by_cluster else None
    live, prev = enters | birth, np.full(n, -1, np.int64)  # prev: row of the node before
    rows = np.argsort(t, kind="stable")
    times, starts = np.unique(t[rows], return_index=True)
    bounds = [*starts.tolist(), n]
    last, before = None, None
    for k, now in enumerate(times.tolist()):
        here = rows[bounds[k]:bounds[k + 1]]
        ends = before[live[before]] if last == now - 1 else np.empty(0, np.int64)
        nodes = here[target[here] & own[here]]
        used = set()
        if len(ends) and len(nodes):
            ends = ends[np.lexsort((ids[ends], strength[ends]))]
            i, j, d = step.candidates({c: v[ends] for c, v in values.items()}, {c: values[c][nodes] for c in "xy"})
            order = np.lexsort((ids[nodes][j], strength[nodes][j], d, i))
            served = -1
            for a, b in zip(i[order].tolist(), nodes[j[order]].tolist()):
                item = cluster[b] if by_cluster else b
                if a != served and item not in used:
                    served, prev[b] = a, ends[a]
                    used.add(item)
        mine = here[own[here]]
        hit = mine[prev[mine] >= 0]
        values["px"][hit], values["py"][hit] = values["x"][prev[hit]], values["y"][prev[hit]]
        if by_cluster:
            for r in mine.tolist():
                live[r] = prev[r] >= 0 or (birth[r] and (cluster[r] is None or cluster[r] not in used))
        last, before = now, here
    out = pa.table({**{c: table.column(c) for c in table.column_names if c not in ("px", "py", "enters", "target")}, "live": pa.array(live),
                    "prev_id": pa.array(ids[np.maximum(prev, 0)], mask=prev < 0), "px": pa.array(values["px"], from_pandas=True),
                    "py": pa.array(values["py"], from_pandas=True)})
    yield from out.filter(pa.array(own)).to_batches()


def _heading(x1, y1, x2, y2) -> Column:
    """Direction from the first to the second cell in degrees, clockwise from the second axis."""
    return F.degrees(F.atan2((F.col(x2) - F.col(x1)).cast("double"), (F.col(y2) - F.col(y1)).cast("double")))


def _between(a: Column, b: Column) -> Column:
    """Angle between two directions, 0 to 180 degrees."""
    apart = F.pmod(a - b, F.lit(360.0))
    return F.least(apart, 360.0 - apart)


def _inside_cone(rule: LinkRule) -> Column:
    """Candidates the speed class of a moving track allows (to a billionth of a degree)."""
    inside = F.lit(None).cast("boolean")
    for step in reversed(rule.cone):
        ok = F.col("_still") | (F.round("_turn", 9) <= step.turn)
        if rule.sectors and step.sector != "full":
            wide = SECTORS.get(step.sector, step.turn / 2)
            # straight back is left out with its edge, the other sectors keep theirs
            within = F.round("_aside", 9) < wide if step.sector == "three_quarters" else F.round("_aside", 9) <= wide
            ok = ok & (F.col("_met") | within)
        inside = F.when(F.col("_speed") < step.below, ok).otherwise(inside)
    return (F.col("_moved") == 0) | F.coalesce(inside, F.lit(False))


def link_nodes(nodes: DataFrame, by: list[str], rule: LinkRule | str = "local_2_phase",
               shape: tuple[int, int] = (721, 1440), axes: tuple[float, float, float, float] | None = None,
               centres: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between nodes of consecutive steps.

    ``nodes``: by, t (step number), node_id (unique), x, y, rad, crit and, for
    the cluster policy, cluster; ``bg_dx``/``bg_dy`` (cells per step) feed the
    background predictors.  ``centres`` lists (by, t, cluster) with the centre
    position for the cluster policy; a centre that is no extremum must carry its
    own node_id.  The result has one row per member of a track:
    by, t, node_id, prev_id (null at birth).
    """
    rule = RULES[rule] if isinstance(rule, str) else rule
    columns = [*by, "t", "node_id", "x", "y", "rad", "crit"]
    extra = [c for c in ("cluster", "bg_dx", "bg_dy") if c in nodes.columns]
    targets = cut_lineage(nodes.select(*columns, *extra))
    by_cluster = rule.policy == "cluster"
    if rule.predictor == "none" and rule.cone is None and not by_cluster:
        reach = rule.hw_scale * float(targets.agg(F.max("rad").alias("r")).first()["r"] or 1.0)
        fresh = dominant_matching(_edges(targets, targets, by, rule, axes, reach))
        return targets.join(fresh.select(F.col("b").alias("node_id"), F.col("a").alias("prev_id")), "node_id", "left").select(*by, "t", "node_id", "prev_id")
    pool = targets.withColumns({"target": F.lit(True), "birth": F.lit(not by_cluster)})
    if by_cluster:
        births = centres.select(*columns, *extra)
        inside = births.select("node_id").withColumn("_c", F.lit(True))
        pool = pool.join(inside, "node_id", "left").withColumn("birth", F.coalesce("_c", F.lit(False))).drop("_c")
        pool = pool.unionByName(births.join(targets.select("node_id"), "node_id", "left_anti").withColumns({"target": F.lit(False), "birth": F.lit(True)}))
    return _serve_in_blocks(pool, by, rule, shape, axes)


def _serve_in_blocks(pool: DataFrame, by: list[str], rule: LinkRule, shape: tuple[int, int],
                     axes: tuple[float, float, float, float] | None) -> DataFrame:
    """Members of tracks where what an end does depends on its past.

    A task serves the steps of a block in turn.  All blocks start at once, as if every possible
    birth entered them without a past; one whose entering ends turn out to be others is served
    again, until all fit.
    """
    placed = F.col("t").isNotNull()
    for c in by:
        placed = placed & F.col(c).isNotNull()
    block, step, by_cluster = F.floor(F.col("t") / F.lit(BLOCK_STEPS)), _Step(rule, shape, axes), rule.policy == "cluster"
    keys, past = [*by, "_block"], ["px", "py"]
    blank = {c: F.lit(None).cast("double") for c in past}
    pool = cut_lineage(pool.withColumns({"t": F.col("t").cast("long"), "node_id": F.col("node_id").cast("long"), "_block": block, **blank}))
    unplaced = pool.where(~placed & F.col("birth")).select(*by, "t", "node_id", F.lit(None).cast("long").alias("prev_id"))
    rows = pool.where(placed).withColumn("enters", F.lit(False))
    schema = [f for f in rows.schema if f.name not in (*past, "enters", "target")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", live boolean, prev_id long, px double, py double"

    served = _on_batches(partial(_serve_block, step=step, by_cluster=by_cluster))

    def leaving(df: DataFrame) -> DataFrame:
        """The ends of a block's last step, as they enter the next."""
        at_end = df.where((F.col("t") + 1) % BLOCK_STEPS == 0)
        return at_end.select(*[c for c in rows.columns if c not in ("_block", "target", "enters", "birth")], (F.col("_block") + 1).alias("_block"),
                             F.lit(False).alias("target"), F.lit(False).alias("birth"), F.lit(True).alias("enters"))

    entering, dirty, parts = leaving(rows.where("birth")), None, []
    while True:
        both = rows.unionByName(entering)
        some = both if dirty is None else both.join(dirty, keys, "left_semi")
        found = cut_lineage(spread(some, keys).groupBy(*keys).applyInArrow(served, kinds))
        parts.append(found.withColumn("_round", F.lit(len(parts))))
        fresh = leaving(found.where("live"))
        redone = entering if dirty is None else entering.join(dirty.withColumn("_block", F.col("_block") + 1), keys, "left_semi")
        was, now = (df.select(*keys, "node_id", F.struct(F.lit(1), *past).alias(name)) for df, name in ((redone, "_was"), (fresh, "_now")))
        other = was.join(now, [*keys, "node_id"], "full_outer").where(~F.col("_was").eqNullSafe(F.col("_now"))).select(*keys).distinct()
        other = cut_lineage(other)
        if other.isEmpty():
            break
        kept = entering.join(other, keys, "left_anti")
        entering = cut_lineage(kept.unionByName(fresh.join(other, keys, "left_semi")))
        dirty = other
    found = union_all(parts)
    if len(parts) > 1:
        found = found.join(found.groupBy(*keys).agg(F.max("_round").alias("_round")), [*keys, "_round"])
    members = found.where("live").select(*by, "t", "node_id", "prev_id")
    return members.unionByName(unplaced)


def track_roots(members: DataFrame) -> DataFrame:
    """(node_id, root): first node of each chain, by pointer doubling."""
    ptr = cut_lineage(members.select("node_id", F.coalesce("prev_id", "node_id").alias("root")))
    while True:
        hop = ptr.select(F.col("node_id").alias("root"), F.col("root").alias("_next"))
        step = cut_lineage(ptr.join(hop, "root").select("node_id", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")))
        ptr = step.select("node_id", "root")
        if step.where("_moved").isEmpty():
            return ptr


def build_tracks(members: DataFrame, nodes: DataFrame, by: list[str], columns: list[str], min_points: int = 3) -> DataFrame:
    """Track table from links: track_id, t, node columns and cumulative length."""
    roots = track_roots(members)
    enough = roots.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    kept = roots.join(enough.select("root"), "root", "left_semi").withColumnRenamed("root", "track_id")
    points = kept.join(nodes.select("node_id", *by, "t", "x", "y", *columns), "node_id")
    chunk = ordered.value_chunk("t", 720.0)
    return sequences.path_length(points, "track_id", "t", "x", "y", chunk)


def track_nodes(nodes: DataFrame, by: list[str], rule: LinkRule | str = "local_2_phase",
                shape: tuple[int, int] = (721, 1440), axes=None, centres: DataFrame | None = None,
                columns: list[str] | None = None) -> DataFrame:
    """Nodes to tracks in one call; tracks shorter than the rule's minimum are dropped."""
    chosen = RULES[rule] if isinstance(rule, str) else rule
    members = link_nodes(nodes, by, chosen, shape, axes, centres)
    pool = nodes
    if chosen.policy == "cluster":
        cols = [*by, "t", "node_id", "x", "y", "rad", "crit"]
        pool = nodes.select(*cols).unionByName(
            centres.select(*cols).join(nodes.select("node_id"), "node_id", "left_anti").select(*cols))
    return build_tracks(members, pool, by, columns or ["rad", "crit"], chosen.min_points)


def background_shift(nodes: DataFrame, field: DataFrame, on: list[str], dt_step: float, dist_m: float,
                     box_scale: float = 3.0, bucket: float = 16.0) -> DataFrame:
    """Add ``bg_dx``/``bg_dy``: mean wind of a box around each node (upper edges left out), in cells per step."""
    from gyrespark.operators.aggregate import box_aggregate

    half = F.floor(box_scale * F.round("rad", 0)).cast("double")
    wind = box_aggregate(nodes.withColumn("_half", half), field.select(*on, F.col("x").alias("_gx"), F.col("y").alias("_gy"), "u", "v"),
                         on, "node_id", "x", "y", "_half", "_gx", "_gy",
                         {"_mu": ("u", "mean"), "_mv": ("v", "mean")}, bucket)
    scale = dt_step / dist_m
    return wind.withColumns({"bg_dx": F.col("_mu") * scale, "bg_dy": F.col("_mv") * scale}).drop("_half", "_mu", "_mv", "n_cells")


def stitch_nodes(nodes: DataFrame, by: list[str], time: str, lon: str, lat: str, range_deg: float, mintime_hours: float,
                 maxgap_hours: float, step_hours: float = 1.0, prioritize: str | None = None) -> DataFrame:
    """Link nodes within a great-circle range, tolerating gaps in time.

    A node prefers the earliest following time, then the nearest node.  Contested
    nodes go to the larger ``prioritize`` value if given, else to the nearest.
    Tracks shorter than ``mintime_hours`` are dropped.  Returns nodes with track_id.
    """
    steps = max(1, int(maxgap_hours // step_hours) + (0 if maxgap_hours >= step_hours else 1))
    slot = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(int(step_hours * 3_600_000_000)))
    base = cut_lineage(nodes.withColumn("_slot", slot))
    band = float(range_deg)
    a = base.select(*by, F.col("node_id").alias("a"), F.col("_slot").alias("_sa"), F.col(lon).alias("_lo"), F.col(lat).alias("_la"),
                    (F.col(prioritize) if prioritize else F.lit(0.0)).cast("double").alias("_pr"))
    a = a.withColumn("_gap", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("_slot", F.col("_sa") + F.col("_gap"))
    a = a.withColumn("_cell", F.explode(joins._band_cells("_lo", "_la", band)["_cells"]))
    b = base.select(*by, F.col("node_id").alias("b"), "_slot", F.col(lon).alias("_lo2"), F.col(lat).alias("_la2"))
    b = b.withColumn("_cell", joins._band_cell("_lo2", "_la2", band))
    dist = geo.haversine_km("_lo", "_la", "_lo2", "_la2") / geo.EARTH_RADIUS_KM * 57.29577951308232
    # the estimate of a does not know of its copies: it must not be broadcast
    pairs = a.hint("merge").join(b, [*by, "_slot", "_cell"]).withColumn("_d", dist).where(F.col("_d") <= band)
    prio = F.struct((-F.col("_pr")).alias("p"), "a") if prioritize else F.struct("_dmin", "a")
    part = F.struct(*by) if by else F.struct(F.lit(0).alias("p"))
    if not prioritize:
        # one node's candidates
        pairs = pairs.withColumn("_dmin", F.min("_d").over(Window.partitionBy("a")))
    edges = pairs.select(part.alias("part"), F.col("_sa").alias("at"), F.col("_slot").alias("to"), "a", "b", F.struct("_gap", "_d", "b").alias("pref"), prio.alias("prio"))
    links = dominant_matching(edges).select(F.col("b").alias("node_id"), F.col("a").alias("prev_id"))
    members = base.select("node_id").join(links, "node_id", "left")
    roots = track_roots(members).withColumnRenamed("root", "track_id")
    points = base.join(roots, "node_id")
    span = points.groupBy("track_id").agg(((F.max("_slot") - F.min("_slot")) * step_hours).alias("_h"))
    return points.join(span.where(F.col("_h") >= mintime_hours).select("track_id"), "track_id", "left_semi").drop("_slot")
