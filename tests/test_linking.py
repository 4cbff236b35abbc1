"""Set-based linking against serving the tracks one after another."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrespark.operators import linking

NY = NX = 14


def fixture(seed, steps=9, per_step=7, two_per_cluster=False):
    rng = np.random.default_rng(seed)
    rows, used = [], 0
    for t in range(steps):
        cells = rng.permutation(NY * NX)[:per_step]
        for k, c in enumerate(cells):
            used += 1
            cluster = k // 2 + 1 if two_per_cluster else k + 1
            rows.append(dict(g="a", t=t, node_id=used, x=int(c % NX), y=int(c // NX), rad=float(rng.uniform(1.0, 2.5)),
                             crit=float(rng.uniform(0.1, 9.0)), cluster=cluster, bg_dx=float(rng.normal()), bg_dy=float(rng.normal())))
    return rows


def centres_of(rows):
    best = {}
    for r in rows:
        k = (r["t"], r["cluster"])
        if k not in best or r["crit"] > best[k]["crit"]:
            best[k] = r
    return list(best.values())


def clamp(v, n):
    return min(max(v, 0.0), n - 1.0)


def predict(track, how):
    last = track[-1]
    stay = (last["x"], last["y"])
    if len(track) == 1:
        if how in ("bg", "adv_bg"):
            return clamp(last["x"] + last["bg_dx"], NX), clamp(last["y"] + last["bg_dy"], NY)
        return stay
    prev = track[-2]
    adv = clamp(2 * last["x"] - prev["x"], NX), clamp(2 * last["y"] - prev["y"], NY)
    if how == "none":
        return stay
    if how == "adv_bg":
        wind = clamp(last["x"] + last["bg_dx"], NX), clamp(last["y"] + last["bg_dy"], NY)
        return (adv[0] + wind[0]) / 2, (adv[1] + wind[1]) / 2
    return adv


def sequential(rows, policy, how, scale=1.5):
    live, done = [], []
    for t in range(max(r["t"] for r in rows) + 1):
        pool = sorted((r for r in rows if r["t"] == t), key=lambda r: (-r["crit"], r["node_id"]))
        free = list(pool)
        used_clusters = set()
        nxt = []
        for track in sorted(live, key=lambda tr: (-tr[-1]["crit"], tr[-1]["node_id"])):
            px, py = predict(track, how)
            near = [(math.sqrt((px - r["x"]) ** 2 + (py - r["y"]) ** 2), -r["crit"], r["node_id"], r) for r in free]
            near = [n for n in near if n[0] < scale * track[-1]["rad"]]
            if not near:
                done.append(track)
                continue
            pick = min(near, key=lambda n: n[:3])[3]
            nxt.append(track + [pick])
            if policy == "cluster":
                used_clusters.add(pick["cluster"])
                free = [r for r in free if r["cluster"] != pick["cluster"]]
            else:
                free = [r for r in free if r["node_id"] != pick["node_id"]]
        if policy == "cluster":
            births = [r for r in centres_of(pool) if r["cluster"] not in used_clusters]
        else:
            births = free
        live = nxt + [[r] for r in births]
    return sorted(tuple(r["node_id"] for r in tr) for tr in done + live if len(tr) >= 3)


SCHEMA = "g string, t int, node_id long, x int, y int, rad double, crit double, cluster int, bg_dx double, bg_dy double"


@pytest.mark.parametrize("policy,how,seed", [("points", "none", 1), ("points", "adv", 3), ("points", "adv_bg", 5), ("cluster", "none", 6)])
def test_equals_sequential(spark, policy, how, seed):
    rows = fixture(seed, two_per_cluster=policy == "cluster")
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    centres = None
    if policy == "cluster":
        centres = spark.createDataFrame([tuple(r.values()) for r in centres_of(rows)], SCHEMA)
    rule = linking.LinkRule(policy=policy, predictor=how)
    tracks = linking.track_nodes(df, ["g"], rule, (NY, NX), centres=centres)
    got = tracks.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("t", "node_id"))).alias("p")).collect()
    assert sorted(tuple(s["node_id"] for s in r["p"]) for r in got) == sequential(rows, policy, how)


def great_circle(lon1, lat1, lon2, lat2):
    la1, la2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(a))


def test_great_circle_links_cross_the_date_line(spark):
    rows, axes = fixture(8), (176.0, 0.6, 55.0, 0.6)

    def place(r):
        return axes[0] + r["x"] * axes[1], axes[2] + r["y"] * axes[3]

    live, done = [], []
    for t in range(max(r["t"] for r in rows) + 1):
        free = [r for r in rows if r["t"] == t]
        nxt = []
        for track in sorted(live, key=lambda tr: (-tr[-1]["crit"], tr[-1]["node_id"])):
            last = track[-1]
            lat = place(last)[1]
            cell = math.sqrt(111.0 * axes[1] * math.cos(math.radians(lat)) * 111.0 * axes[3])
            near = [(great_circle(*place(last), *place(r)), -r["crit"], r["node_id"], r) for r in free]
            near = [n for n in near if n[0] <= 1.5 * last["rad"] * cell]
            if not near:
                done.append(track)
                continue
            pick = min(near, key=lambda n: n[:3])[3]
            nxt.append(track + [pick])
            free = [r for r in free if r["node_id"] != pick["node_id"]]
        live = nxt + [[r] for r in free]
    want = sorted(tuple(r["node_id"] for r in tr) for tr in done + live if len(tr) >= 3)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    tracks = linking.track_nodes(df, ["g"], "local_2_phase_km", (NY, NX), axes)
    got = tracks.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("t", "node_id"))).alias("p")).collect()
    assert want and sorted(tuple(s["node_id"] for s in r["p"]) for r in got) == want


def heading(dx, dy):
    return math.degrees(math.atan2(dx, dy))


def bearing(lon1, lat1, lon2, lat2):
    la1, la2, d = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1)
    return heading(math.sin(d) * math.cos(la2), math.cos(la1) * math.sin(la2) - math.sin(la1) * math.cos(la2) * math.cos(d))


def reached(lon, lat, km, direction):
    la, d, b = math.radians(lat), km / 6371.0, math.radians(direction)
    la2 = math.asin(math.sin(la) * math.cos(d) + math.cos(la) * math.sin(d) * math.cos(b))
    return lon + math.degrees(math.atan2(math.sin(b) * math.sin(d) * math.cos(la), math.cos(d) - math.sin(la) * math.sin(la2))), math.degrees(la2)


def apart(a, b):
    d = (a - b) % 360
    return min(d, 360 - d)


def allowed(rule, speed, turn, aside):
    """The speed class of the cone; None stands for no direction."""
    step = next(c for c in rule.cone if speed < c.below)
    if turn is not None and round(turn, 9) > step.turn:
        return False
    if not rule.sectors or aside is None or step.sector == "full":
        return True
    if step.sector == "three_quarters":
        return round(apart(aside, 180), 9) > 45
    return round(aside, 9) <= (90 if step.sector == "half" else step.turn / 2)


def serve_with_cone(rows, rule, axes):
    """Tracks served one by one; ``axes`` None means cells."""
    def place(r):
        return (axes[0] + r["x"] * axes[1], axes[2] + r["y"] * axes[3]) if axes else (r["x"], r["y"])

    def distance(p, q):
        return great_circle(*p, *q) if axes else math.dist(p, q)

    def direction(p, q):
        return bearing(*p, *q) if axes else heading(q[0] - p[0], q[1] - p[1])

    live, done, refused = [], [], 0
    for t in range(max(r["t"] for r in rows) + 1):
        free = [r for r in rows if r["t"] == t]
        nxt = []
        for track in sorted(live, key=lambda tr: (-tr[-1]["crit"], tr[-1]["node_id"])):
            last = place(track[-1])
            limit = 1.5 * track[-1]["rad"] * (math.sqrt(111.0 * axes[1] * math.cos(math.radians(last[1])) * 111.0 * axes[3]) if axes else 1.0)
            moved, want, way = 0.0, last, None
            if len(track) > 1:
                past = place(track[-2])
                moved = distance(past, last)
            if moved:
                way = direction(past, last)
                want = reached(*last, moved, way) if axes else (2 * last[0] - past[0], 2 * last[1] - past[1])
            near = []
            for r in free:
                d = distance(want, place(r))
                if d >= moved + limit:
                    continue
                if moved:
                    turn = apart(direction(last, place(r)), way) if place(r) != last else None
                    aside = apart(direction(want, place(r)), way) if d else None
                    if not allowed(rule, moved * (1000.0 if axes else rule.cell_m) / rule.step_s, turn, aside):
                        refused += 1
                        continue
                near.append((d, -r["crit"], r["node_id"], r))
            if not near:
                done.append(track)
                continue
            pick = min(near, key=lambda n: n[:3])[3]
            nxt.append(track + [pick])
            free = [r for r in free if r["node_id"] != pick["node_id"]]
        live = nxt + [[r] for r in free]
    return sorted(tuple(r["node_id"] for r in tr) for tr in done + live if len(tr) >= 3), refused


@pytest.mark.parametrize("name,axes,seed", [("local_2_phase_cone", None, 11), ("local_2_phase_cone_km", (170.0, 0.9, 60.0, 0.6), 12)])
def test_cone_equals_serving_one_by_one(spark, name, axes, seed):
    from dataclasses import replace

    rule = replace(linking.RULES[name], step_s=10_800.0)  # so that every speed class occurs
    rows = fixture(seed)
    want, refused = serve_with_cone(rows, rule, axes)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    tracks = linking.track_nodes(df, ["g"], rule, (NY, NX), axes)
    got = tracks.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("t", "node_id"))).alias("p")).collect()
    assert want and refused and sorted(tuple(s["node_id"] for s in r["p"]) for r in got) == want


@pytest.mark.parametrize("speed,sector,ahead,side,back", [
    (4.0, "full", True, True, True), (8.0, "three_quarters", True, True, False), (15.0, "half", True, True, False),
    (25.0, "narrow", True, False, False), (99.0, "narrow", True, False, False)])
def test_sectors_of_the_cone(spark, speed, sector, ahead, side, back):
    rule = linking.RULES["local_2_phase_cone"]
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 90.0), (10.0, 180.0)], "_turn double, _aside double").withColumns(
        {"_speed": F.lit(speed), "_moved": F.lit(1.0), "_still": F.lit(False), "_met": F.lit(False)})
    got = [r[0] for r in df.select(linking._inside_cone(rule)).collect()]
    assert next(c for c in rule.cone if speed < c.below).sector == sector and got == [ahead, side, back]


def test_stitching_bridges_gaps_and_drops_short_tracks(spark):
    rows = [(1, "2020-01-01 00:00:00", 10.0, 50.0), (2, "2020-01-01 01:00:00", 10.5, 50.0), (3, "2020-01-01 03:00:00", 11.0, 50.2),
            (4, "2020-01-01 00:00:00", 179.9, 10.0), (5, "2020-01-01 01:00:00", -179.9, 10.0), (6, "2020-01-01 02:00:00", -179.5, 10.0),
            (7, "2020-01-01 00:00:00", 60.0, 0.0), (8, "2020-01-01 05:00:00", 60.0, 0.0)]
    df = spark.createDataFrame(rows, "node_id long, time string, lon double, lat double").withColumn("time", F.col("time").cast("timestamp_ntz"))
    out = linking.stitch_nodes(df, [], "time", "lon", "lat", 1.0, 2.0, 2.0)
    got = {r["track_id"]: r["n"] for r in out.groupBy("track_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 3, 4: 3}


def test_unknown_rule(spark):
    with pytest.raises(KeyError):
        linking.link_nodes(None, [], "no such rule")


def test_background_shift_is_the_mean_wind_of_the_box(spark):
    rng = np.random.default_rng(4)
    cells = [(t, x, y, float(rng.normal()), float(rng.normal())) for t in (0, 1) for x in range(20) for y in range(20) if rng.random() < 0.8]
    points = [(0, 1, 5, 5, 1.2), (0, 2, 0, 19, 0.7), (1, 3, 12, 9, 2.4), (1, 4, 19, 0, 0.2)]
    got = linking.background_shift(spark.createDataFrame(points, "t int, node_id long, x int, y int, rad double"),
                                   spark.createDataFrame(cells, "t int, x int, y int, u double, v double"), ["t"], 3600.0, 27_750.0)
    for r in got.collect():
        half = math.floor(3.0 * round(r.rad))
        box = [(u, v) for t, x, y, u, v in cells if t == r.t and -half <= x - r.x < half and -half <= y - r.y < half]
        if box:
            assert r.bg_dx == pytest.approx(sum(b[0] for b in box) / len(box) * 3600 / 27_750)
            assert r.bg_dy == pytest.approx(sum(b[1] for b in box) / len(box) * 3600 / 27_750)
        else:
            assert r.bg_dx is None and r.bg_dy is None
    assert got.count() == len(points)


@pytest.mark.parametrize("reach,edges_a_group", [(1, 1 << 20), (3, 40), (3, 1 << 20)])
def test_matching_in_groups_of_slots_equals_serving_one_by_one(spark, monkeypatch, reach, edges_a_group):
    rng = np.random.default_rng(reach)
    slot = {k: int(rng.integers(0, 40)) for k in range(240)}
    edges = [(p, slot[a], slot[b], a + 1000 * p, b + 1000 * p, float(rng.integers(0, 4)), float(rng.integers(0, 3)))
             for p in (0, 1) for a in slot for b in slot if 0 < slot[b] - slot[a] <= reach and rng.random() < 0.7]
    prio = {e[3]: e[6] for e in edges}
    want, used = {}, set()
    for a in sorted(prio, key=lambda a: (prio[a], a)):
        free = sorted((e[5], e[4]) for e in edges if e[3] == a and e[4] not in used)
        if free:
            want[a] = free[0][1]
            used.add(free[0][1])
    df = spark.createDataFrame([(*e[:6], prio[e[3]]) for e in edges], "p int, at int, to int, a long, b long, d double, c double")
    df = df.select(F.struct("p").alias("part"), "at", "to", "a", "b", F.struct("d", "b").alias("pref"), F.struct("c", "a").alias("prio"))
    monkeypatch.setattr(linking, "GROUP_EDGES", edges_a_group)
    rounds, cut = [], linking.cut_lineage
    monkeypatch.setattr(linking, "cut_lineage", lambda d: (rounds.append(1), cut(d))[1])
    assert {r.a: r.b for r in linking.dominant_matching(df).collect()} == want
    assert len(rounds) <= (2 if reach == 1 else 12)


def test_a_long_line_of_ends_is_settled_in_few_rounds(spark, monkeypatch):
    # each end wants the item of the end before it: one by one this takes a round an end
    n = 300
    edges = [(0, 0, 1, k, 1000 + b, float(-b), float(k)) for k in range(n) for b in (k, k - 1) if b >= 0]
    df = spark.createDataFrame(edges, "p int, at int, to int, a long, b long, d double, c double")
    df = df.select(F.struct("p").alias("part"), "at", "to", "a", "b", F.struct(F.abs("d").alias("d")).alias("pref"), F.struct("c").alias("prio"))
    rounds, cut = [], linking.cut_lineage
    monkeypatch.setattr(linking, "cut_lineage", lambda d: (rounds.append(1), cut(d))[1])
    got = {r.a: r.b - 1000 for r in linking.dominant_matching(df).collect()}
    assert got == {k: k for k in range(n)} and len(rounds) == 2


@pytest.mark.parametrize("name,axes", [("adv", None), ("adv_bg", None), ("local_extrema", None), ("local_extrema_km", (170.0, 0.9, 60.0, 0.6)),
                                       ("local_2_phase_cone", None), ("local_2_phase_cone_km", (170.0, 0.9, 60.0, 0.6))])
def test_steps_are_served_in_blocks(spark, monkeypatch, name, axes):
    rule = linking.RULES.get(name) or linking.LinkRule(predictor=name)
    rows = fixture(21, steps=24, two_per_cluster=rule.policy == "cluster")
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    centres = spark.createDataFrame([tuple(r.values()) for r in centres_of(rows)], SCHEMA) if rule.policy == "cluster" else None
    odd = df.limit(2).withColumns({"t": F.lit(None).cast("int"), "node_id": F.col("node_id") + 5000})
    cuts, cut, found = [], linking.cut_lineage, []
    monkeypatch.setattr(linking, "cut_lineage", lambda d: (cuts.append(1), cut(d))[1])
    for steps in (64, 5, 1):
        monkeypatch.setattr(linking, "BLOCK_STEPS", steps)
        cuts.clear()
        members = linking.link_nodes(df.unionByName(odd), ["g"], rule, (NY, NX), axes, centres)
        found.append(sorted((r.node_id, r.prev_id or 0) for r in members.collect()))
        if steps == 64:
            assert len(cuts) <= 5  # before, one or more for every step
    assert found[0] == found[1] == found[2] and any(p for _, p in found[0])
    assert (max(found[0])[0] > 5000) == (rule.policy != "cluster")
