"""Rules that must not be lost, on tiny tables and against plain loops."""

import itertools
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trackmill.functions import predicates as P
from trackmill.operators import edits, estimators, pairs, quality, scoring, segments, timebase, windows
from trackmill.streaming import association


def rows(spark, n, **more):
    own = [dict(video_id=1, track_id=1, frame_index=i, t_s=i / 240, x=float(i), y=0.0, radius=20.0, theta=i * 0.005, status="observed", source="observation", identity_status="ok", assignment_ambiguous=None, observable=None, surface_status="inside_floor", measurement_warning=None) for i in range(n)]
    schema = "video_id long, track_id long, frame_index long, t_s double, x double, y double, radius double, theta double, status string, source string, identity_status string, assignment_ambiguous boolean, observable boolean, surface_status string, measurement_warning string"
    for i, change in more.get("changes", {}).items():
        own[i] |= change
    return spark.createDataFrame(own, schema)


def test_blockers_reject_and_warnings_do_not(spark):
    bad = [{"status": "missing"}, {"assignment_ambiguous": True}, {"identity_status": "ambiguous"}, {"observable": False}, {"surface_status": "floor_boundary"}, {"x": None}, {"x": float("nan")}, {"t_s": None}, {"theta": None}, {"source": "physics_prediction"}]
    df = rows(spark, len(bad) + 2, changes={i: b for i, b in enumerate(bad)} | {len(bad): {"measurement_warning": "blurred_edge_review"}})
    ok = [r.ok for r in df.select("frame_index", P.usable(orientation=True).alias("ok")).orderBy("frame_index").collect()]
    assert ok == [False] * len(bad) + [True, True]


def test_chunks_of_265_rows_cover_all_and_250_leave_a_tail(spark):
    for n, chunks, skipped in ((265, 5, []), (250, 5, [(240, 249)])):
        out = segments.chunks(segments.islands(rows(spark, n)), 0.25, 24).orderBy("frame_from").collect()
        assert len(out) == chunks and sum(r.n for r in out) == n
        assert [(r.frame_from, r.frame_to) for r in out if r.skipped] == skipped


def test_chunks_against_a_loop(spark):
    rng = random.Random(3)
    t, own = 0.0, []
    for i in range(300):
        t += rng.random()
        own.append((1, 1, 1, i, t))
    df = spark.createDataFrame(own, "video_id long, track_id long, segment long, frame_index long, t_s double")
    want, chunk = [], []
    for r in own:
        if chunk and r[4] - chunk[0][4] >= 7 - 1e-10:
            want.append((chunk[0][3], chunk[-1][3]))
            chunk = []
        chunk.append(r)
    want.append((chunk[0][3], chunk[-1][3]))
    assert sorted((r.frame_from, r.frame_to) for r in segments.chunks(df, 7.0, 1).collect()) == want


def test_a_contact_cuts_and_a_missing_frame_is_not_bridged(spark):
    bars = spark.createDataFrame([(1, 1, 9.5, 9.5)], "video_id long, track_id long, start double, end double")
    df = rows(spark, 20).where("frame_index <> 15")
    out = segments.islands(df, barriers=bars).groupBy("segment").agg(F.min("frame_index"), F.max("frame_index")).orderBy("segment").collect()
    assert [tuple(r)[1:] for r in out] == [(0, 9), (10, 14), (16, 19)]


def test_local_regression_is_numpys(spark):
    t = [0.0, 0.009, 0.023, 0.030, 0.047, 0.071, 0.1]
    df = spark.createDataFrame([(1, 1, 1, i, x, 2 + 3 * x + 4 * x * x, 1.0, 0.01) for i, x in enumerate(t)], "video_id long, track_id long, segment long, frame_index long, t_s double, x double, y double, sigma double")
    r = windows.local_derivatives(df, window_s=1.0).where("frame_index = 3").first()
    assert math.isclose(r.fit_x.value, 2 + 3 * 0.03 + 4 * 0.03**2, rel_tol=1e-9) and math.isclose(r.fit_x.velocity, 3.24, rel_tol=1e-9) and math.isclose(r.fit_x.acceleration, 8, rel_tol=1e-8)
    few = windows.local_derivatives(df, window_s=0.01).where("frame_index = 6").first()
    assert few.reason == "insufficient_contiguous_samples" and few.fit_x is None


def test_angles_fail_alone(spark):
    df = rows(spark, 30).withColumns({"segment": F.lit(1), "sigma": F.lit(1e-3), "theta_sigma": F.lit(0.01)})
    v = windows.local_derivatives(df, 0.08).where("frame_index = 15").first()
    a = windows.angular_derivatives(df, None, 0.08).where("frame_index = 15").first()
    b = windows.angular_derivatives(df, 30.0, 0.08).where("frame_index = 15").first()
    assert math.isclose(v.fit_x.velocity, 240, rel_tol=1e-9) and a.angle_status == "alias_ambiguous" and a.fit_angle is None
    assert math.isclose(b.fit_angle.velocity, 1.2, rel_tol=1e-6)


def test_one_missing_frame_does_not_split_an_event(spark):
    own = [(1, f, t, 35.0 * t, 0.0, 20.0, "observed") for f in range(4) for t in (0, 1) if (f, t) != (1, 1)]
    df = spark.createDataFrame(own, "video_id long, frame_index long, track_id long, x double, y double, radius double, status string")
    out = pairs.pair_events(df).collect()
    assert len(out) == 1 and out[0].frame_end == 4 and out[0].frame_start == 0


def test_pair_events_against_a_loop(spark):
    rng = random.Random(5)
    own = []
    for video in range(40):
        for f in range(30):
            for t in (0, 1, 2):
                if rng.random() < 0.75:
                    own.append((video, f, t, 45.0 * t if t < 2 else 500.0, 0.0, 20.0, "observed") if rng.random() < 0.5 else (video, f, t, 200.0 * t, 0.0, 20.0, "observed"))
    df = spark.createDataFrame(own, "video_id long, frame_index long, track_id long, x double, y double, radius double, status string")
    near = {(r.video_id, r.frame_index, r.a, r.b): (r.near, r.gap) for r in pairs.frame_pairs(df).collect()}
    there = {(r[0], r[1], r[2]) for r in own}
    want = []
    for video in range(40):
        frames = sorted({r[1] for r in own if r[0] == video})
        for a, b in itertools.combinations(range(3), 2):
            e = None
            for f in frames:
                if near.get((video, f, a, b), (False,))[0]:
                    gap = near[video, f, a, b][1]
                    e = e or [max(0, f - 1), f + 1, f, gap]
                    e[1] = f + 1
                    if gap < e[3]:
                        e[2:] = [f, gap]
                elif e:
                    absent = (video, f, a) not in there or (video, f, b) not in there
                    if absent and f - e[1] <= 2:
                        continue
                    want.append((video, a, b, *e[:3], "persistent_contact" if e[1] - e[0] > 8 else "unmeasurable"))
                    e = None
            if e:
                want.append((video, a, b, *e[:3], "unmeasurable"))
    got = [(r.video_id, r.a, r.b, r.frame_start, r.frame_end, r.closest_frame, r.kind) for r in pairs.pair_events(df).collect()]
    assert sorted(got) == sorted(want) and len(got) > 50


def test_hierarchy_is_not_the_row_mean_and_one_group_has_no_interval(spark):
    own = [("s1", "long", 0.1)] * 10 + [("s1", "short", 0.3), ("s2", "other", 0.6)]
    df = spark.createDataFrame(own, "session_id string, video_id string, value double").withColumn("variance", F.lit(1.0))
    r = estimators.hierarchy(df).first()
    assert math.isclose(r.estimate, 0.4) and not math.isclose(r.row_mean, 0.4)
    one = estimators.bootstrap(df.where("session_id = 's2'"), unit="session_id", n=20).first()
    assert one.low is None and one.high is None and one.groups == 1


def test_time_map_and_profile(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, 0.0, 1.0), (1, 1, 1.0, None, 1.0, 8.0)], "video_id long, seg_no long, p_start double, p_end double, t_start double, slow_factor double")
    f = spark.createDataFrame([(1, 1.0), (1, 9.0), (1, None), (2, 1.0)], "video_id long, p double")
    assert sorted((str(r.p), r.video_id, r.t) for r in timebase.map_time(f, seg).collect()) == [("1.0", 1, 1.0), ("1.0", 2, None), ("9.0", 1, 2.0), ("None", 1, None)]
    bad = seg.withColumn("t_start", F.when(F.col("seg_no") == 1, 5.0).otherwise(0.0))
    assert timebase.validate_profile(seg).count() == 0 and [r.reason for r in timebase.validate_profile(bad).collect()] == ["time_gap"]


def test_edits_against_a_loop(spark):
    rng = random.Random(9)
    obs = [(1, f, t, float(f), float(t), 20.0, 0.1, "observed", "observation") for f in range(30) for t in range(4)]
    schema = "video_id long, frame_index long, track_id long, x double, y double, radius double, theta double, status string, source string"
    log = []
    for seq in range(40):
        a = rng.randrange(30)
        log.append((seq, 1 if seq % 7 else None, a, a + (rng.randrange(8) if seq % 9 else 10**9), rng.choice(["swap_id", "set_id", "center", "angle", "exclude"]), rng.randrange(4), rng.randrange(4), 100.0 + seq, 200.0, None, 0.5))
    want = []
    for r in obs:
        row, ids = list(r), []
        for seq, _, lo, hi, action, track, other, nx, ny, _, theta in log:
            if not lo <= row[1] <= hi:
                continue
            mine = row[2] == track
            if mine or action == "swap_id" and row[2] == other:
                ids.append(seq)
            if action == "swap_id":
                row[8] = "manual_corrected" if mine or row[2] == other else row[8]
                row[2] = other if mine else track if row[2] == other else row[2]
            elif mine and action == "set_id":
                row[2], row[8] = other, "manual_corrected"
            elif mine and action == "center":
                row[3], row[4], row[6], row[7], row[8] = nx, ny, None, "observed", "manual_corrected"
            elif mine and action == "angle":
                row[6], row[8] = theta, "manual_corrected"
            elif mine and action == "exclude":
                row[7], row[8] = "missing", "manual_corrected"
        want.append((*row, tuple(ids)))
    e = spark.createDataFrame(log, "seq long, video_id long, frame_from long, frame_to long, action string, track_id long, other_id long, nx double, ny double, n_radius double, n_theta double")
    out = edits.apply_edits(spark.createDataFrame(obs, schema), e)
    got = [(r.video_id, r.frame_index, r.track_id, r.x, r.y, r.radius, r.theta, r.status, r.source, tuple(r.edit_ids)) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_markers_and_superseded_warnings(spark):
    df = rows(spark, 4, changes={1: {"measurement_warning": "blurred_edge_review", "assignment_ambiguous": True}}).withColumns({"position_sigma": F.lit(None).cast("double"), "theta_sigma": F.lit(0.01), "marker_x": F.col("x"), "marker_y": F.col("y") - 15})
    schema = "seq long, video_id long, frame_from long, frame_to long, action string, track_id long, other_id long, nx double, ny double, n_radius double, n_theta double, n_sigma double"
    log = [(1, 1, 0, 0, "marker", 1, None, 10.0, 0.0, None, None, None), (2, 1, 1, 1, "center", 1, None, 1.0, 2.0, 20.0, None, 2.0), (3, 1, 2, 2, "marker", 1, None, 100.0, 0.0, None, None, None), (4, 1, 3, 3, "center", 1, None, 500.0, 0.0, None, None, None)]
    r = edits.apply_edits(df, spark.createDataFrame(log, schema)).orderBy("frame_index").collect()
    assert r[0].theta == 0.0 and r[0].theta_sigma == max(0.01, 2**0.5 / 10) and r[0].marker_x == 10.0
    assert math.isclose(r[1].theta, math.pi / 2) and r[1].position_sigma == 2.0 and (r[1].measurement_warning, r[1].superseded_warning, r[1].assignment_ambiguous, r[1].status) == (None, "blurred_edge_review", False, "observed")
    assert r[2].theta == 0.01 and r[2].edit_ids == [3]  # too far off the rim
    assert r[3].theta is None and r[3].theta_sigma is None and r[3].marker_x is None and r[3].x == 500.0


def test_log_fold(spark):
    ops = [(1, 0, "edit", 10), (1, 1, "edit", 11), (1, 2, "undo", None), (1, 3, "edit", 12), (1, 4, "undo", None), (1, 5, "undo", None), (1, 6, "undo", None), (1, 7, "redo", None)]
    r = edits.fold_log(spark.createDataFrame(ops, "project_id long, n long, op string, edit long")).first()
    assert (r.active, r.abandoned, r.cursor) == ([10], [11], 1)


def test_inserts_get_later_edits_only(spark):
    schema = "seq long, video_id long, frame_from long, frame_to long, action string, track_id long, other_id long, nx double, ny double, n_radius double, n_theta double"
    log = [(1, 1, 0, 9, "exclude", 5, None, None, None, None, None), (2, 1, 4, 4, "insert", 5, None, 1.0, 2.0, 20.0, None), (3, 1, 0, 9, "set_id", 5, 6, None, None, None, None)]
    e = spark.createDataFrame(log, schema)
    r = edits.insert_edits(rows(spark, 1), e).collect()
    assert len(r) == 1 and (r[0].track_id, r[0].frame_index, r[0].status, r[0].edit_ids) == (6, 4, "observed", [3])


def test_scope_edits(spark):
    log = [(1, 1, 1, "exit", 50), (1, 1, 2, "reentry", 80), (1, 1, 3, "surface_exit", 90)]
    r = edits.replay_scope(spark.createDataFrame(log, "video_id long, track_id long, seq long, kind string, frame long")).first()
    assert [(s.start, s.end, s.fit_enabled) for s in r.segments] == [(0, 50, True), (80, 89, True), (90, None, False)]


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(1, 5, 2)
        cost = np.where(rng.random((n, m)) < 0.6, rng.random((n, m)), np.inf)
        got = scoring._assign(cost)
        best = (0, 0.0)
        for cols in itertools.permutations([*range(m), *[-1] * n], int(n)):
            ok = [(i, j) for i, j in enumerate(cols) if j >= 0 and np.isfinite(cost[i, j])]
            best = min(best, (-len(ok), round(float(sum(cost[i, j] for i, j in ok)), 9)))
        assert (-len(got), round(float(sum(cost[i, j] for i, j in got)), 9)) == best


def test_half_found_labels(spark):
    t = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 20.0), (1, 0, 2, 100.0, 0.0, 20.0)], "video_id long, frame_index long, track_id long, x double, y double, radius double")
    p = spark.createDataFrame([(1, 0, 1, 1.0, 0.0)], "video_id long, frame_index long, track_id long, x double, y double")
    r = scoring.evaluate_labels(t, p, scoring.match_labels(t, p)).first()
    assert r.recall == 0.5 and r.centre_rmse == 1.0 and (r.tp, r.fp, r.fn) == (1, 0, 1)


def test_restitution_outside_bounds_stays(spark):
    e = spark.createDataFrame([(1, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, -1.2, 0.0, 0.0, 0.0)], "event_id long, nx double, ny double, pre_vx1 double, pre_vy1 double, pre_vx2 double, pre_vy2 double, post_vx1 double, post_vy1 double, post_vx2 double, post_vy2 double")
    r = estimators.normal_trials(e).first()
    assert math.isclose(r.e_obs, 1.2) and r.warning == "outside_0_1"


def test_restitution_fit_against_a_fine_grid(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(0.5, 2, 30)
    b = -0.7 * a + rng.normal(0, 0.05, 30)
    df = spark.createDataFrame([(float(x), float(y), 0.05, 0.05) for x, y in zip(a, b)], "a double, b double, sa double, sb double")
    e = estimators.normal_restitution(df).first().e

    def loss(e):
        total = 0.0
        for x0, y0 in zip(a, b):
            x = np.linspace(max(0, x0 - 0.5), x0 + 0.5, 4001)
            total += (np.sqrt(1 + ((y0 + e * x) / 0.05) ** 2) + np.sqrt(1 + ((x - x0) / 0.05) ** 2)).min()
        return total

    grid = np.linspace(0.6, 0.8, 201)
    assert abs(e - grid[np.argmin([loss(g) for g in grid])]) < 2e-3


def test_tangential_fit_finds_what_made_the_trials(spark, small):
    from trackmill.plans import QUERIES

    r = QUERIES["k7_tangential_fit"](spark, small).first()
    assert abs(r.e_t + 0.8) < 0.02 and abs(r.mu - 0.1) < 0.02


def test_suppression_against_a_loop(spark):
    rng = random.Random(4)
    dets = [(g, float(rng.randrange(30)), i, rng.random() * 100, rng.random() * 100, 10.0) for g in range(5) for i in range(25)]
    df = spark.createDataFrame(dets, "g long, residual double, det_id long, x double, y double, radius double")
    want = []
    for g in range(5):
        kept = []
        for d in sorted(r[1:] for r in dets if r[0] == g):
            if all(math.hypot(d[2] - o[2], d[3] - o[3]) >= 0.65 * 20 for o in kept):
                kept.append(d)
        want += [(g, d[1]) for d in kept]
    assert sorted((r.g, r.det_id) for r in quality.suppress(df, 0.65, ["g"]).collect()) == sorted(want)


def test_streamed_tracks_are_the_batch_ones(spark, tmp_path):
    rng = random.Random(8)
    dets = [(v, f, 100 * f + k, 50.0 * k + 3 * f + rng.random(), 10.0 * v, 10.0, None) for v in (1, 2) for f in range(20) for k in range(3) if rng.random() < 0.9]
    schema = "video_id long, frame_index long, det_id long, x double, y double, radius double, marker long"
    for part in range(4):
        spark.createDataFrame([d for d in dets if d[1] // 5 == part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    import os
    import shutil

    os.makedirs(f"{tmp_path}/flat")
    for part in range(4):
        f = next(x for x in os.listdir(f"{tmp_path}/in/p{part}") if x.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/in/p{part}/{f}", f"{tmp_path}/flat/{part}.parquet")
        os.utime(f"{tmp_path}/flat/{part}.parquet", (part + 1, part + 1))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")
    q = association.associate_stream(stream).writeStream.format("memory").queryName("tracks").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(repr, (tuple(r) for r in spark.sql("SELECT * FROM tracks").collect())))
    want = sorted(map(repr, (tuple(r) for r in association.associate(spark.createDataFrame(dets, schema)).collect())))
    assert got == want and len(got) >= len(dets)
    assert {r.track for r in spark.sql("SELECT * FROM tracks").collect()} == {0, 1, 2}


def test_ingest_that_runs_again_is_a_clean_one(spark, tmp_path):
    from trackmill.streaming import ingest

    df = spark.createDataFrame([(i % 10, i, float(i)) for i in range(100)], "k long, seq long, v double")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    run = lambda: ingest.ingest_stream(ingest.read_stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", f"{tmp_path}/c", ["k"], "seq").awaitTermination()
    run()
    first = sorted(map(tuple, ingest.ingested(spark, f"{tmp_path}/out", ["k"], "seq").collect()))
    import shutil

    shutil.rmtree(f"{tmp_path}/c/commits")  # the last steps are not known to be done
    run()
    again = sorted(map(tuple, ingest.ingested(spark, f"{tmp_path}/out", ["k"], "seq").collect()))
    assert first == again == [(k, 90 + k, 90.0 + k) for k in range(10)]


def test_frame_pandas_state_is_small():
    state = association.Tracks()
    for f in range(200):
        association.step(state, f, [(f, 3.0 * f, 0.0, 10.0, None)], association.Gate())
    assert len(state.own) == 1 and isinstance(pd.DataFrame(state.own), pd.DataFrame)
