"""Text layouts, sinks and streaming forms."""

import datetime as dt

from pyspark.sql import functions as F

from gyrespark import schemas
from gyrespark.plans import sweep
from gyrespark.sources import sinks, tables, text_tracks
from gyrespark.streaming import live


def when(h):
    return dt.datetime(2020, 1, 1) + dt.timedelta(hours=h)


def test_nodes_round_trip(spark, tmp_path):
    rows = [(when(0), 3, 4, 10.5, 50.25, 2.0, 1e-4, 12.5), (when(0), 5, 6, 11.0, 51.0, 3.0, 2e-4, 13.5),
            (when(1), None, None, None, None, None, None, None), (when(2), 7, 8, 12.0, 52.0, 4.0, 3e-4, 14.5)]
    df = spark.createDataFrame(rows, schemas.NODES)
    out = str(tmp_path / "nodes")
    text_tracks.write_node_text(df, out)
    back = text_tracks.read_nodes(spark, out + "/*/", dense_ids=True)
    got = sorted((r["time"], r["lon_idx"], r["lat_idx"], r["lon"], r["crit"], r["point_id"]) for r in back.collect())
    assert got == [(when(0), 3, 4, 10.5, 1e-4, 0), (when(0), 5, 6, 11.0, 2e-4, 1), (when(2), 7, 8, 12.0, 3e-4, 2)]
    heads = sorted((r["time"], r["announced"], r["found"]) for r in text_tracks.node_headers(spark, out + "/*/").collect())
    assert heads == [(when(0), 2, 2), (when(1), 0, 0), (when(2), 1, 1)]


def test_headers_carry_over_file_splits(spark, tmp_path):
    path = tmp_path / "n.txt"
    lines = []
    for h in range(24):
        lines.append(f"2020\t1\t1\t40\t{h}")
        lines += [f"\t{i}\t{h}\t{i}.5\t{h}.25\t1.0\t2.0\t3.0" for i in range(40)]
    path.write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        back = text_tracks.read_nodes(spark, str(path), dense_ids=True)
        assert back.count() == 960
        assert back.where(F.hour("time") != F.col("lat_idx")).count() == 0
        assert back.where(F.col("point_id") != F.col("lat_idx") * 40 + F.col("lon_idx")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tracks_round_trip_and_ids_over_files(spark, tmp_path):
    body = "start\t2\t2020\t1\t1\t0\n\t1\t2\t190.0\t50.0\t2.0\t1.0e-4\t10.0\t2020\t1\t1\t0\n\t2\t2\t191.0\t50.0\t2.0\t1.0e-4\t10.0\t2020\t1\t1\t1\n"
    (tmp_path / "a.txt").write_text(body + body)
    (tmp_path / "b.txt").write_text(body)
    df = text_tracks.read_tracks(spark, str(tmp_path / "*.txt"))
    got = sorted((r["track_id"], r["lon"], r["time"], r["source_file"]) for r in df.collect())
    assert [g[0] for g in got] == [0, 0, 1, 1, 2, 2]
    assert got[0][1:] == (-170.0, when(0), "a.txt") and got[-1][3] == "b.txt"
    counts = {r["file_name"]: r["n_tracks"] for r in text_tracks.count_tracks(spark, str(tmp_path / "*.txt")).collect()}
    assert counts == {"a.txt": 2, "b.txt": 1}
    assert text_tracks.season_tracks(spark, str(tmp_path / "*.txt"), (12, 1), (2, 1), 1).count() == 6


def test_track_text_written(spark, tmp_path):
    rows = [(9, 0, when(0), 1, 2, 50.0, 10.0, 2.0, 1e-4, 0.0), (9, 1, when(1), 2, 2, 50.0, 10.5, 2.0, 1e-4, 1.0)]
    out = str(tmp_path / "tracks")
    text_tracks.write_track_text(spark.createDataFrame(rows, schemas.TRACKS), out)
    lines = [r["value"] for r in spark.read.text(out + "/month=2020-01").collect()]
    assert lines[0] == "start\t2\t2020\t1\t1\t0"
    assert lines[1] == "\t1\t2\t10.000000\t50.000000\t1.000000e-04\t2.000000e+00\t0\t2020\t1\t1\t0"


def test_month_checkpoints_and_resume(spark, tmp_path):
    out = str(tmp_path / "months")
    jan = spark.createDataFrame([(dt.datetime(2020, 1, 5), 1)], "time timestamp_ntz, v int")
    feb = spark.createDataFrame([(dt.datetime(2020, 2, 5), 2)], "time timestamp_ntz, v int")
    sinks.write_months(jan, out)
    assert [r["v"] for r in sinks.resume_months(jan.union(feb), out).collect()] == [2]
    sinks.write_months(feb, out)
    sinks.write_months(jan.withColumn("v", F.lit(7)), out)
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [2, 7]


def test_replace_table_reads_itself(spark, tmp_path):
    out = str(tmp_path / "t")
    spark.range(3).write.parquet(out)
    sinks.replace_table(spark.read.parquet(out).withColumn("id", F.col("id") + 10), out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [10, 11, 12]


def test_catalogue_pushdown(spark, tmp_path):
    out = str(tmp_path / "cat")
    rows = [(1, dt.datetime(2010, 5, 1), 350.0, 40.0, 990.0, 20.0, "a", "TC", 1, 0, "", 1.0), (2, dt.datetime(2011, 5, 1), 350.0, 40.0, 990.0, 20.0, "a", "TC", 1, 0, "", 1.0)]
    spark.createDataFrame(rows, schemas.CATALOGUE).write.parquet(out)
    df = tables.read_catalogue(spark, out, 2010, (-20.0, 10.0), (0.0, 60.0), ["TID", "ISOTIME", "LON", "LAT"])
    assert [r["TID"] for r in df.collect()] == [1]
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "MSLP" not in plan.split("ReadSchema")[1]


def test_storm_catalogue_and_manual_tracks(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Id,Name,datetime,status,lat,lon\n" + "".join(f"A,X,2020-01-01 0{h}:00:00,TS,25.4N,71.2W\n" for h in range(4)))
    df = tables.read_storm_catalogue(spark, str(tmp_path / "s.csv"))
    assert {(r["lat"], r["lon"]) for r in df.collect()} == {(25.4, -71.2)}
    head = ",".join(f.name for f in schemas.MANUAL_TRACKS.fields)
    for i in (1, 2):
        (tmp_path / f"m{i}.csv").write_text(head + f"\n2020-01-01 00:00:00,{i},5,1,1,2,2,3,3,4,4,2.5\n")
    m = tables.read_manual_tracks(spark, str(tmp_path / "m*.csv"))
    assert sorted((r["track_id"], r["x"]) for r in m.collect()) == [(0, 1), (1, 2)]


def test_stages_skip_finished_work(spark, tmp_path):
    stage = sweep.Stage("nodes", lambda s: s.range(2), str(tmp_path / "stage"))
    assert [r["status"] for r in sweep.run_stages(spark, [stage]).collect()] == ["ok"]
    assert [r["status"] for r in sweep.run_stages(spark, [stage]).collect()] == ["skipped"]


def test_streaming_sessions(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("a", when(0)), ("a", when(1)), ("a", when(9)), ("b", when(2)), ("z", when(60))]
    spark.createDataFrame(rows, "k string, time timestamp_ntz").withColumn("time", F.col("time").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("k string, time timestamp").parquet(src)
    q = live.write_by_batch(live.gap_sessions(stream, "k", "time", "3 hours", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = sorted((r["k"], r["n_points"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_log_is_append_only_and_typed(spark, tmp_path):
    out = str(tmp_path / "log")
    names = [f.name for f in schemas.RUN_LOG.fields]
    row = {n: None for n in names} | {"timestamp": "2020-01-01", "eps": 1, "year": 2010, "prioritize": "True", "status": "ok"}
    for year in (2010, 2011):
        sinks.append_log(spark.createDataFrame([tuple({**row, "year": year}.values())], schemas.RUN_LOG), out)
    got = sorted((r["year"], r["eps"], r["prioritize"]) for r in tables.read_run_log(spark, out).collect())
    assert got == [(2010, 1, True), (2011, 1, True)]


def test_newest_catalogue_file_wins(spark, tmp_path):
    import os

    for i, (name, tid) in enumerate([("TC_2010_a.csv", 1), ("TC_2010_b.csv", 2), ("TC_2011.csv", 3)]):
        path = tmp_path / name
        path.write_text(f"TID,LON\n{tid},350.0\n")
        os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))
    df = tables.read_catalogue_csv(spark, str(tmp_path), "TID long, LON double")
    assert sorted((r["TID"], r["LON"]) for r in df.collect()) == [(2, -10.0), (3, -10.0)]


def test_config_and_catalogue_output(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"dist_m": 5.0, "other": 1}')
    assert schemas.dialect("ERA5", tables.load_config(str(tmp_path / "c.json"))).dist_m == 5.0
    out = str(tmp_path / "csv")
    sinks.write_catalogue_csv(spark.createDataFrame([(1, when(3))], "TID long, ISOTIME timestamp_ntz"), out)
    back = spark.read.option("header", True).csv(out).collect()
    assert [(r["TID"], r["ISOTIME"]) for r in back] == [("1", "2020-01-01 03:00:00")]


def test_tracks_written_by_month_and_one_file_a_track(spark, tmp_path):
    rows = [(t, when(700 * t + h), float(h)) for t in range(4) for h in range(30)]
    tracks = spark.createDataFrame(rows, "track_id long, time timestamp, x double").repartition(6)
    sinks.write_tracks(tracks, str(tmp_path / "months"))
    back = spark.read.parquet(str(tmp_path / "months"))
    assert sorted((r.track_id, r.x) for r in back.collect()) == sorted((t, x) for t, _, x in rows)
    # a track lies in the month of its first point
    assert {(r.track_id, r.year, r.month) for r in back.collect()} == {(t, when(700 * t).year, when(700 * t).month) for t in range(4)}
    sinks.write_per_track_csv(tracks, str(tmp_path / "single"))
    files = [list((tmp_path / "single" / f"track_id={t}").glob("*.csv")) for t in range(4)]
    assert [len(f) for f in files] == [1] * 4
    assert sum(1 for _ in files[2][0].open()) == 31
