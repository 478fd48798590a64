import pytest
from pyspark.sql import functions as F

from trackloom.plans import build
from trackloom.sources import corpora, tables


def put(path, header, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *lines]) + "\n")


def test_highd_and_ind(spark, tmp_path):
    ids = "precedingId,followingId,leftPrecedingId,leftAlongsideId,leftFollowingId,rightPrecedingId,rightAlongsideId,rightFollowingId"
    put(tmp_path / "h/01_tracks.csv", f"frame,id,x,y,xVelocity,yVelocity,xAcceleration,yAcceleration,{ids},laneId", "1,7,0.5,2,30,0,0.1,0,0,0,0,0,0,0,0,0,3")
    put(tmp_path / "h/01_tracksMeta.csv", "id,class", "7,Truck")
    put(tmp_path / "h/01_recordingMeta.csv", "id,frameRate,upperLaneMarkings", "1,25,3.5;7;10")
    h = str(tmp_path / "h")
    t = corpora.with_meta(corpora.read_corpus(spark, "HighD", h), corpora.read_meta(spark, h), ["recording", "track_id"])
    r = t.first()
    assert (r.dataset, r.scene_id, r.track_id, r.frame, r.x, r.speed, r.lane_id, r.agent_type) == ("HighD", "HighD_01", "7", 1, 0.5, 30.0, 3, "Truck")
    assert corpora.read_frame_rates(spark, h, 10.0).first().frame_rate == 25.0
    put(tmp_path / "i/04_tracks.csv", "recordingId,trackId,frame,trackLifetime,xCenter,yCenter,heading,width,length,xVelocity,yVelocity,xAcceleration,yAcceleration",
        "4,25,2028,0,1.5,-2,90,1.8,4.2,3,0,0.1,0")
    r = corpora.read_corpus(spark, "inD", str(tmp_path / "i")).first()
    assert (r.scene_id, r.track_id, r.x, r.y, r.heading) == ("inD_04", "25", 1.5, -2.0, 90.0)


def test_other_corpora(spark, tmp_path):
    put(tmp_path / "n/trajectories-0750am.csv", "Vehicle_ID,Frame_ID,Local_X,Local_Y,v_Length,v_Width,v_Class,v_Vel,v_Acc,Lane_ID", "2,13,16.4,35.3,14.5,4.9,2,40,0,2")
    r = corpora.read_corpus(spark, "NGSIM", str(tmp_path / "n")).first()
    assert r.scene_id == "NGSIM_0750am" and r.x == pytest.approx(35.3 * 0.3048) and r.y == pytest.approx(16.4 * 0.3048)
    for scene in ("IntersectionA", "IntersectionC"):
        put(tmp_path / f"c/{scene}/Trajectories/rec-01.csv", "frameNum,carId,carCenterX,carCenterY,carCenterXft,carCenterYft,speed,course,heading,laneId", "0,5,100,200,1,2,3,90,91,1")
    rows = corpora.read_corpus(spark, "CitySim", str(tmp_path / "c")).collect()
    assert [(r.scene_id, r.track_id) for r in rows] == [("CitySim_IntersectionA", "rec-01:5")]
    put(tmp_path / "s/xian/day1/Veh_smoothed_tracks.csv", "track_id,frame_id,agent_type,x,y,vx,vy,ax,ay,heading_rad", "1,0,car,0,0,1,0,0,0,0.5", "1,1,bus,1,0,1,0,0,0,0.5")
    assert {(r.scene_id, r.agent_type) for r in corpora.read_corpus(spark, "sinD", str(tmp_path / "s")).collect()} == {("sinD_xian_day1", "car")}
    put(tmp_path / "x/DR_USA_Roundabout_FT_train.csv", "case_id,track_id,frame_id,timestamp_ms,agent_type,x,y,vx,vy,psi_rad,length,width",
        "1.0,2,3,300,Car,1,2,3,4,0.1,4,2", "1,3,3,300,car,oops,2,3,4,0.1,4,2", "1,4,3,300,pedestrian,1,2,3,4,,,")
    r = corpora.read_corpus(spark, "INTERACTION", str(tmp_path / "x")).collect()
    assert [(q.dataset, q.scene_id, q.track_id, q.file_split) for q in r] == [("INTERACTION_USA", "DR_USA_Roundabout_FT_train/case_1", "1:2", "train")]
    put(tmp_path / "d/DJI_0001/01_tracks.csv", "frame,id,x,y,xVelocity,yVelocity,xAcceleration,yAcceleration,orientation,laneId", "1,9,0,0,1,0,0,0,0.2,4")
    assert corpora.read_corpus(spark, "DJI", str(tmp_path / "d")).first().scene_id == "DJI_DJI_0001_01"
    found = corpora.discover_scenes(spark, {"NGSIM": str(tmp_path / "n"), "CitySim": str(tmp_path / "c"), "sinD": str(tmp_path / "s")}).collect()
    assert {(f.dataset, f.scene_id) for f in found} == {("NGSIM", "NGSIM_0750am"), ("CitySim", "CitySim_IntersectionA"), ("sinD", "sinD_xian_day1")}


def test_lane_centers_and_assignments(spark, tmp_path):
    (tmp_path / "lanes.json").write_text('[{"center_id": "a", "center_points": [[0, 1], [2, 3]]}, {"center_id": "b", "center_points": [[0, 1]]}]')
    assert [r.center_id for r in corpora.read_lane_centers(spark, str(tmp_path / "lanes.json")).collect()] == ["a"]
    (tmp_path / "as/inD").mkdir(parents=True)
    (tmp_path / "as/inD/inD_04.json").write_text(
        '{"dataset": "inD", "scene_id": "inD_04", "assignments": [{"track_id": "1", "status": "assigned", "path_id": null}, {"track_id": "2", "status": "unassigned"}]}')
    assert [r.track_id for r in tables.read_assignments(spark, str(tmp_path / "as")).collect()] == ["1"]
    assert tables.read_assignments(spark, str(tmp_path / "as"), require_path_id=True).isEmpty()
    with pytest.raises(FileNotFoundError):
        tables.read_assignments(spark, str(tmp_path / "as"), scenes=spark.createDataFrame([("inD", "inD_99")], "dataset string, scene_id string"))


def test_column_unions_and_domains(spark):
    a, b = spark.range(1).withColumn("p", F.lit(1)), spark.range(1).withColumn("q", F.lit(2))
    assert tables.union_common([a, b], required=["id"]).columns == ["id"] and tables.union_all([a, b], True).columns == ["id", "p", "q"]
    with pytest.raises(KeyError):
        tables.union_common([a, b])
    assert tables.resolve_datasets(["x"], "CN") == ["x"] and tables.resolve_datasets(None, "DE") == ["HighD", "inD"]
    with pytest.raises(ValueError):
        tables.resolve_datasets(None, "nowhere")


def test_dropped_vehicles_are_invisible_as_neighbours(spark):
    rows = [("inD", "s", "r", t, f, float(f), y, 0.0, 2.0, 4.0, 1.0, 0.0, 0.0, 0.0, "car") for t, y in (("1", 0.0), ("2", 5.0)) for f in range(20)]
    df = spark.createDataFrame(rows, "dataset string, scene_id string, recording string, track_id string, frame long, x double, y double, heading double, width double, "
                                     "length double, xVelocity double, yVelocity double, xAcceleration double, yAcceleration double, agent_type string")
    only = df.where("track_id = '1'").select("dataset", "scene_id", "track_id").distinct()
    both = df.select("dataset", "scene_id", "track_id").distinct()
    gap = lambda a: build.build_transitions("inD", df, a).where("track_id = '1'").select(F.col("state")[0][7].alias("v")).first().v
    assert gap(only) == -1.0 and gap(both) == 5.0


def test_columns_go_by_name_over_files(spark, tmp_path):
    """Two files with the same columns in another order; one with a column less."""
    head = "Vehicle_ID,Frame_ID,Local_X,Local_Y,v_Length,v_Width,v_Class,v_Vel,v_Acc,Lane_ID"
    put(tmp_path / "trajectories-a.csv", head, "2,13,10,100,14,5,2,40,0,2")
    put(tmp_path / "trajectories-b.csv", "Frame_ID,Vehicle_ID,Local_Y,Local_X,v_Length,v_Width,v_Class,v_Vel,v_Acc,Lane_ID", "1,7,100,10,14,5,2,40,0,2")
    put(tmp_path / "trajectories-c.csv", head.replace(",Lane_ID", ""), "3,5,10,100,14,5,2,40,0")
    rows = {r.scene_id: r for r in corpora.read_corpus(spark, "NGSIM", str(tmp_path)).collect()}
    assert [(rows[f"NGSIM_{k}"].track_id, rows[f"NGSIM_{k}"].frame, rows[f"NGSIM_{k}"].lane_id) for k in "abc"] == [("2", 13, 2), ("7", 1, 2), ("3", 5, None)]
    assert all(r.x == pytest.approx(30.48) and r.y == pytest.approx(3.048) for r in rows.values())


def test_files_to_windows_with_classes(spark, tmp_path):
    """Tracks and their metadata file, repeated rows and one walker, through to windows."""
    head = "recordingId,trackId,frame,trackLifetime,xCenter,yCenter,heading,width,length,xVelocity,yVelocity,xAcceleration,yAcceleration"
    rows = [f"4,{t},{f},0,{f * 0.1 + t * 10},0,0,1.8,4.2,2.5,0,0.1,0" for t in (1, 2) for f in range(60)]
    put(tmp_path / "04_tracks.csv", head, *rows, rows[3], rows[40])
    put(tmp_path / "04_tracksMeta.csv", "recordingId,trackId,class", "4,1,car", "4,2,pedestrian")
    tracks = corpora.read_corpus(spark, "inD", str(tmp_path))
    assert {(r.track_id, r.agent_type) for r in tracks.select("track_id", "agent_type").distinct().collect()} == {("1", "car"), ("2", "pedestrian")}
    assigned = tracks.select("dataset", "scene_id", "track_id").distinct()
    found = build.build_transitions("inD", tracks, assigned).collect()
    assert len(found) == 4 and {r.track_id for r in found} == {"1"}


def test_milliseconds(spark):
    rows = [("d", "s", "r", "1", f, float(f), f * 1.0 * 0.001, 0.0) for f in range(20)]
    df = spark.createDataFrame(rows, "dataset string, scene_id string, recording string, track_id string, frame long, timestamp_ms double, vx double, vy double")
    from trackloom.operators import kinematics
    out = kinematics.velocity_derivative(df, ["dataset", "scene_id", "recording", "track_id"]).collect()
    assert all(r.ax == pytest.approx(1.0) for r in out)


def test_rows_travel_with_what_is_read(spark):
    """Columns that no later step reads are left behind before rows are shuffled; others pass through the smoothing once."""
    from trackloom.operators import kinematics
    from trackloom.plans import build
    rows = [("NGSIM", "s", "r", "1", f, float(f), 0.0, 1.0, 1.0, 2, 2.0, 4.0, 3, f, "note") for f in range(40)]
    df = spark.createDataFrame(rows, "dataset string, scene_id string, recording string, track_id string, frame long, x double, y double, speed double, v_Acc double, v_Class long, "
                               "width_m double, length_m double, lane_id long, ordinal long, note string")
    found = build.eligible("NGSIM", df, df.select("dataset", "scene_id", "track_id"))
    assert not {"note", "v_Class", "width_m"} & set(found.columns) and found.count() == 40
    moved = kinematics.add_kinematics(found, ["dataset", "scene_id", "recording", "track_id"], 10.0)
    assert {(r.frame, r.lane_id) for r in moved.collect()} == {(f, 3) for f in range(40)}
    assert "Join" not in moved._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroups")[0]


def test_accelerations_that_are_no_number_are_null(spark):
    from trackloom.operators import kinematics
    rows = [("d", "s", "r", "1", f, float(f), None if f == 30 else 1.0 * f, 0.0) for f in range(40)]
    df = spark.createDataFrame(rows, "dataset string, scene_id string, recording string, track_id string, frame long, timestamp_ms double, vx double, vy double")
    found = {r.frame: r.ax for r in kinematics.velocity_derivative(df, ["dataset", "scene_id", "recording", "track_id"]).collect()}
    assert len(found) == 40 and found[30] is None and found[5] is not None
