"""Readers and writers, gates, submissions, bootstraps and streams, on tables small enough to check by hand or by a loop."""

import hashlib
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.functions import predicates as P
from trackmill.operators import edits, estimators, merge, pairs, quality, scoring, segments, trials, windows
from trackmill.sources import tables
from trackmill.streaming import association, timing

# ---- sources and sinks


def test_json_lines_in_and_out(spark, tmp_path):
    (tmp_path / "in/run7").mkdir(parents=True)
    (tmp_path / "in/run7/a.jsonl").write_text('{"k": 1, "v": 2.5}\n\n{"k": 2}\n')
    schema = spark.createDataFrame([], "k long, v double, w string").schema
    rows = sorted((r.k, r.v, r.w, r.run_id) for r in tables.read_table(spark, f"{tmp_path}/in/run7", schema).collect())
    assert rows == [(1, 2.5, None, "run7"), (2, None, None, "run7")]
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, 0.5, None)], "b long, a double, c string")
    tables.write_jsonl(df, f"{tmp_path}/out")
    lines = sorted(json.loads(x)["b"] for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines())
    assert lines == [1, 2] and not any("NaN" in f.read_text() for f in (tmp_path / "out").glob("*.json"))


def test_csv_is_guarded(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", [1, 2], 3), ("plain", None, 4)], "note string, nested array<int>, n long")
    tables.write_csv(df, ["n", "note", "nested", "absent"], f"{tmp_path}/csv")
    text = sorted(x for f in (tmp_path / "csv").glob("*.csv") for x in f.read_text().splitlines())
    assert "n,note,nested,absent" in text and any(x.startswith("3,'=1+1") for x in text) and any(x.startswith("4,plain") for x in text)


def test_fingerprints_and_dictionary(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"some bytes")
    r = tables.fingerprint(spark, f"{tmp_path}/f.bin").first()
    assert (r.length, r.sha256) == (10, hashlib.sha256(b"some bytes").hexdigest())
    d = {(r.table, r.column): r.unit for r in tables.data_dictionary(spark, {"t": spark.createDataFrame([], "v_m_s double, theta_rad double, n long")}).collect()}
    assert d == {("t", "v_m_s"): "m/s", ("t", "theta_rad"): "rad", ("t", "n"): None}


# ---- gates and trials


def test_included_direction_and_weak_signal(spark):
    df = spark.createDataFrame([(True, "excluded", False), (True, None, None), (False, None, True), (False, None, None)], "eligible boolean, status string, approved boolean")
    assert [r.x for r in df.select(pairs.included().alias("x")).collect()] == [False, True, True, False]
    v = spark.createDataFrame([(3.0, 4.0, 0.1, 0.1), (0.1, 0.1, 1.0, 1.0)], "vx double, vy double, sx double, sy double")
    a, b = [r.x for r in v.select(P.direction(F.col("vx"), F.col("vy"), F.col("sx"), F.col("sy")).alias("x")).collect()]
    assert math.isclose(a, math.atan2(4, 3)) and b is None
    s = spark.createDataFrame([(1, 0.01, 0.5), (1, None, -0.9), (2, 0.2, 0.0)], "g long, speed double, omega double")
    assert {r.g: r.x for r in s.groupBy("g").agg(segments.weak_signal(None).alias("x")).collect()} == {1: True, 2: False}


def test_noncontact_needs_a_gap_and_a_still_track(spark):
    own = [(1, t, f, (0.0 if t == 1 else 0.01 * f) if t < 3 else 0.0, 1.0 * t) for t in (1, 2, 3) for f in range(40)]
    obs = spark.createDataFrame(own, "video_id long, track_id long, frame_index long, x double, y double").withColumns(
        {"status": F.lit("observed"), "source": F.lit("observation"), "identity_status": F.lit("ok"), "assignment_ambiguous": F.lit(False), "observable": F.lit(True), "surface_status": F.lit("inside_floor"), "t_s": F.col("frame_index") / 100, "theta": F.lit(0.0)}
    )
    e = spark.createDataFrame([(1, 1, 1, 2, 18, 20, 0.5, "unmeasurable"), (1, 2, 1, 2, 18, 20, 0.001, "unmeasurable"), (1, 3, 2, 2, 18, 20, 0.5, "unmeasurable"), (1, 4, 1, 2, 0, 2, 0.5, "unmeasurable")], "video_id long, event_id long, a long, b long, frame_start long, frame_end long, min_gap double, kind string")
    out = {r.event_id: r.kind for r in trials.reject_noncontact(e, obs, 1e-4).collect()}
    assert out == {1: "noncontact_pass", 2: "unmeasurable", 3: "unmeasurable", 4: "unmeasurable"}


def test_impact_trials_and_preflight(spark):
    state = "array<struct<velocity:array<double>,omega:double,velocity_sigma:double,omega_sigma:double>>"
    ok, none = [([1.0, 0.0], 2.0, 0.001, None), ([0.0, 1.0], 3.0, 0.5, 4.0)], [([1.0, 0.0], None, 0.1, 0.1), ([0.0, 1.0], 3.0, 0.5, 4.0)]
    e = spark.createDataFrame([(1, ok, ok, True), (2, ok, none, True), (3, ok, ok, None)], f"event_id long, pre {state}, post {state}, reviewed boolean")
    out = {r.event_id: r for r in trials.impact_trials(e).collect()}
    assert set(out) == {1, 3} and out[1].approved and not out[3].approved and (out[1].sigmas[0].velocity, out[1].sigmas[0].omega, out[1].sigmas[1].omega) == (0.01, 1.0, 4.0)
    free = spark.createDataFrame([(1,), (1,), (2,)], "video_id long")
    ev = spark.createDataFrame([(1, "isolated_binary", None, 1.0), (1, "isolated_binary", "excluded", 1.0), (3, "isolated_binary", None, 0.0), (4, "near_simultaneous", None, 1.0)], "video_id long, kind string, status string, a double")
    assert {r.video_id: (r.free_segments, r.candidates, r.normal_eligible, r.usable) for r in trials.preflight(free, ev).collect()} == {1: (2, 1, 1, True), 2: (1, 0, 0, True), 3: (0, 1, 0, False), 4: (0, 0, 0, False)}


def test_settings(spark):
    good = (1, 0.25, 200, 0, None, 0.0, 0.1, 5, 161, 0.08)
    bad = [(2, 0.0, 200, 0, None, 0.0, 0.1, 5, 161, 0.08), (3, 0.25, 10_001, 0, None, 0.0, 0.1, 5, 161, 0.08), (4, 0.25, 200, 0, -1.0, 0.0, 0.1, 5, 161, 0.08), (5, 0.25, 200, 0, None, -0.1, 0.1, 5, 161, 0.08), (6, 0.25, 200, 0, None, 0.0, 0.1, 2, 161, 0.08), (7, 0.25, 200, 0, None, 0.0, 0.1, 9, 8, None)]
    s = spark.createDataFrame([good, *bad], "video_id long, duration double, normal_draws long, tangential_draws long, omega_bound double, shared_scale double, shared_clock double, min_samples long, max_samples long, window_s double")
    assert sorted(map(tuple, trials.validate_numbers(s).collect())) == [("2", "duration"), ("3", "draws"), ("4", "omega_bound"), ("5", "shared_sigma"), ("6", "samples"), ("7", "samples"), ("7", "window")]
    t = spark.createDataFrame([(i, 1.0, 1.0) for i in range(40)], "track_id long, mass double, radius double")
    v = spark.createDataFrame([(1, [0], 0, 5)], "video_id long, participants array<bigint>, start long, end long")
    assert [tuple(r) for r in trials.validate_settings(v, t, 32).collect()] == [("project", "track_count")] and trials.validate_settings(v, t.limit(9), 32).count() == 0
    now = spark.createDataFrame([(1, "new", "today"), (2, "new", "today")], "video_id long, measure string, bodies string")
    was = spark.createDataFrame([(1, "old")], "video_id long, measure string")
    assert sorted(map(tuple, trials.with_frozen(now, was, ["measure"]).select("video_id", "measure", "bodies").collect())) == [(1, "old", "today"), (2, "new", "today")]


def test_pixels_speak_where_metres_are_missing(spark):
    own = [(1, 1, 1, i, i / 240, 0.001 * i if i >= 20 else None, 0.0, 2.0 * i, 0.0, 1e-3) for i in range(40)]
    df = spark.createDataFrame(own, "video_id long, track_id long, segment long, frame_index long, t_s double, x double, y double, px double, py double, sigma double")
    out = {r.frame_index: r for r in windows.pixel_fallback(df).collect()}
    assert out[5].unit == "px" and math.isclose(out[5].fit_px.velocity, 480, rel_tol=1e-6) and out[30].unit == "m" and math.isclose(out[30].fit_x.velocity, 0.24, rel_tol=1e-6)


def test_frozen_bank(spark):
    t = spark.createDataFrame([(1.0, -0.5, 0.4, 0.1), (2.0, -1.2, -0.4, -0.1)], "a double, b double, c double, c_obs double")
    t = t.withColumns({n: F.lit(v) for n, v in (("m1", 0.012), ("m2", 0.02), ("r1", 0.02), ("r2", 0.025), ("i1", 2.4e-6), ("i2", 6.25e-6))})
    free = spark.createDataFrame([], "trial_id string, video_id long, track_id long, frame_from long, frame_to long, x0 double, vx double, y0 double, vy double")
    rows = spark.createDataFrame([], "video_id long, track_id long, frame_index long, t_s double, x double, y double")
    bank = lambda *v: spark.createDataFrame([v], "e_n double, e_t double, mu double")
    r = trials.evaluate_fixed(bank(0.6, -0.7, 0.1), free, rows, t).first()
    assert r.n_free == 0 and r.free_rmse is None and r.n_normal == 2 and math.isclose(r.normal_rmse, math.sqrt((0.1**2 + 0) / 2), abs_tol=1e-9) and r.n_tangential == 2 and r.tangential_reason is None
    less = trials.evaluate_fixed(bank(0.6, None, 0.1), free, rows, t).first()
    assert (less.n_tangential, less.tangential_rmse, less.tangential_reason) == (0, None, "coefficient_missing") and less.parameter_hash != r.parameter_hash


# ---- submissions

ENTRY = "key long, source long, role string, review string, settings string, code string, parent long, parent_from long, parent_to long"


def entries(spark, rows):
    return spark.createDataFrame([tuple(r) + (None,) * (9 - len(r)) for r in rows], ENTRY)


def test_duplicates(spark):
    own = [
        (1, 1, "train", "a", "s", "c"), (2, 1, "train", "a", "s", "c"),  # alike
        (3, 2, "train", "a", "s", "c"), (4, 2, "train", None, "s", "c"),  # a missing review is another review
        (5, 3, "train", "a", "s", "c"), (6, 3, "train", "a", "s", "d"),  # another code
        (7, 4, "train", "a", "s", "c"), (8, 4, "test", "a", "s", "c"),  # both roles
        (9, 5, "train", "a", "s", "c"), (10, 5, "test", "b", "s", "c"),  # chosen
        (11, 6, "train", "a", "s", "c"), (12, 6, "train", "a", "s", "c"),  # chosen, but not of this source
        (13, 7, "test", None, None, None), (14, None, "train", None, None, None), (15, None, "train", None, None, None),
    ]
    chosen = spark.createDataFrame([(5, 10), (6, 99)], "source long, key long")
    out = {r.key: (r.selected, r.conflict) for r in merge.resolve_duplicates(entries(spark, own), chosen).collect()}
    assert {k for k, (s, _) in out.items() if s} == {1, 10, 13, 14}
    assert {k: c for k, (_, c) in out.items() if c} == {3: "review_conflict", 4: "review_conflict", 5: "review_conflict", 6: "review_conflict", 7: "split_leakage,review_conflict", 8: "split_leakage,review_conflict", 11: "review_conflict", 12: "review_conflict"}


def test_adopted_pairs_against_a_self_join(spark):
    rng = random.Random(3)
    own = [(i, i, rng.choice(["train", "test", None]), "r", "s", "c", rng.choice([None, 1, 2, 3]), a, None if a is None else a + rng.randrange(200)) for i in range(60) for a in [rng.choice([None, *range(0, 900, 7)])]]
    own += [(100, 1, "train", "r", "t", "c", 9, 0, 100), (101, 1, "train", "r", "t", "c", 9, 10, 20), (102, 1, "train", "r", "t", "c", 9, 15, 18), (103, 1, "train", "r", "t", "c", 9, 100, 130)]
    want = [(None, "settings_mismatch", None, None)]
    for a, b in itertools.combinations(own, 2):
        if a[6] is None or a[6] != b[6]:
            continue
        if {a[2], b[2]} == {"train", "test"}:
            want.append((a[6], "parent_split_leakage", a[0], b[0]))
        if None in (a[7], b[7], a[8], b[8]) or max(a[7], b[7]) <= min(a[8], b[8]):
            want.append((a[6], "parent_overlap", a[0], b[0]))
    got = [tuple(r) for r in merge.check_adopted(entries(spark, own)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert merge.check_adopted(entries(spark, own).limit(0)).count() == 0


def test_inspection(spark):
    rows = [(1, "a", "s", "h", "run1", "complete", "k", "k", False), (2, None, " ", "h", "run2", "failed", "k", "j", False), (3, "a", "s", None, None, None, None, None, False), (4, None, None, None, None, None, None, None, True)]
    e = spark.createDataFrame(rows, "key long, analyst_id string, session_id string, source string, run string, run_status string, recorded_key string, current_key string, excluded boolean")
    assert sorted(map(tuple, merge.inspect(e).collect())) == [(2, "incomplete_run"), (2, "missing_analyst"), (2, "missing_session"), (2, "reanalyze_required"), (3, "missing_run")]


def test_review_basis_changes_with_what_it_covers(spark):
    rows = spark.createDataFrame([(1, t, f, 10 * f + t) for t in (1, 2, 3) for f in range(400)], "video_id long, track_id long, frame_index long, x long")
    e = spark.createDataFrame([(1, 1, 1, 2, 180, 185, "cal"), (1, 2, 1, 3, 10, 12, "cal")], "video_id long, event_id long, a long, b long, frame_start long, frame_end long, settings string")
    base = {r.event_id: r.basis for r in pairs.review_basis(e, rows, ("x",)).collect()}
    moved = lambda track, frame: {r.event_id: r.basis for r in pairs.review_basis(e, rows.withColumn("x", F.when((F.col("track_id") == track) & (F.col("frame_index") == frame), -1).otherwise(F.col("x"))), ("x",)).collect()}
    assert moved(1, 30)[1] != base[1] and moved(1, 30)[2] != base[2] and moved(3, 30)[1] == base[1] and moved(1, 390)[1] == base[1]
    other = {r.event_id: r.basis for r in pairs.review_basis(e.withColumn("settings", F.lit("new")), rows, ("x",)).collect()}
    assert other[1] != base[1]


# ---- bootstraps


def test_draws_are_spread_like_draws_with_replacement(spark):
    for size in (10, 50, 300):
        groups = estimators.numbered_groups(spark.range(size).select(F.concat(F.lit("g"), "id").alias("group_id")))
        assert sorted(r.place for r in groups.collect()) == list(range(size)) and groups.first().size == size
        d = estimators.draws(groups, 200, 5)
        each = d.groupBy("boot_id").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("k")).collect()
        assert all(r.n == size for r in each) and len(each) == 200
        assert abs(np.mean([r.k for r in each]) - size * (1 - (1 - 1 / size) ** size)) < 0.02 * size
        used = d.groupBy("group_id").count().agg(F.min("count"), F.max("count")).first()
        assert used[0] > 120 and used[1] < 290


def test_bootstrap_interval_is_as_wide_as_theory_says(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(10, 2, 60)
    df = spark.createDataFrame([(f"s{i}", f"v{i}", float(v)) for i, v in enumerate(x)], "session_id string, video_id string, value double").withColumn("variance", F.lit(1.0))
    r = estimators.bootstrap(df, n=400, seed=1).first()
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert r.unit == "session_id" and r.groups == 60 and r.failed == 0 and abs((r.high - r.low) / (2 * half) - 1) < 0.15 and abs(r.group_std - x.std(ddof=1)) < 1e-9
    one = estimators.bootstrap(df.withColumn("session_id", F.lit("s")), n=50, seed=1).first()
    assert one.unit == "video_id" and one.scope == "within_single_session_between_videos" and one.low < one.estimate < one.high
    none = estimators.bootstrap(df.limit(1), n=20).first()
    assert none.low is None and none.high is None and none.groups == 1


def test_python_estimators_may_fail(spark):
    df = spark.createDataFrame([(f"s{i}", f"v{i}", float(i)) for i in range(6)], "session_id string, video_id string, value double").withColumn("variance", F.lit(1.0))

    def spread(group):
        if group["value"].nunique() < 4:
            raise ValueError("too few")
        return group["value"].max() - group["value"].min()

    r = estimators.bootstrap(df, estimators.python_estimator(spread), n=100, seed=2).first()
    assert r.estimate == 5.0 and 0 < r.failed < 100 and r.low < r.high <= 5.0


def test_leave_one_out_against_a_loop(spark):
    rng = random.Random(7)
    own = [(rng.choice("abc"), f"v{rng.randrange(7)}", rng.random()) for _ in range(60)] + [("d", "v99", 0.3)]
    df = spark.createDataFrame(own, "session_id string, video_id string, value double")
    got = {r.excluded: r.estimate for r in estimators.leave_one_out(df).collect()}
    for v in {o[1] for o in own}:
        means = {}
        for s, w in {(o[0], o[1]) for o in own if o[1] != v}:
            means.setdefault(s, []).append(np.mean([o[2] for o in own if o[:2] == (s, w)]))
        assert math.isclose(got[v], np.mean([np.mean(m) for m in means.values()]))


def test_staged_draws_are_single_fits_of_the_drawn_rows(spark):
    own = [(s, v, 1.0 + 0.1 * v, -(0.6 + 0.05 * s) * (1.0 + 0.1 * v), 0.05, 0.05, 0.3 if v % 2 else -0.5) for s in range(4) for v in range(5)]
    t = spark.createDataFrame(own, "session_id long, video_id long, a double, b double, sa double, sb double, c double")
    t = t.withColumns({n: F.lit(v) for n, v in (("m1", 0.012), ("m2", 0.02), ("r1", 0.02), ("r2", 0.025), ("i1", 2.4e-6), ("i2", 6.25e-6), ("sc", 0.01))})
    t = estimators.predict_impacts(t, F.lit(0.7), F.lit(-0.5), F.lit(0.2)).select(*t.columns, F.col("c_after").alias("c_obs"))
    mu = spark.createDataFrame([(s, v, 0.1 + 0.01 * s + 0.001 * v) for s in range(3) for v in range(5)], "session_id long, video_id long, value double")
    draws = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 2, 2), (0, 3, 3), (1, 0, 3)], "boot_id long, slot long, group_id long")
    out = {r.boot_id: r for r in trials.staged_bootstrap(mu, t, draws, 9, 3).collect()}
    assert math.isclose(out[0].mu, (0.102 + 0.102 + 0.122) / 3) and out[0].failure is None and out[1].mu is None and out[1].failure == "no_segments"
    drawn = t.where("session_id = 0").unionByName(t.where("session_id = 0")).unionByName(t.where("session_id IN (2, 3)"))
    assert math.isclose(out[0].e_n, estimators.normal_restitution(drawn).first().e, abs_tol=1e-9)
    pair, _ = estimators.tangential_fit(drawn, out[0].e_n, 9, 3)
    assert math.isclose(out[0].e_t, pair.first().e_t, abs_tol=1e-9) and math.isclose(out[0].mu_c, pair.first().mu, abs_tol=1e-9)


def test_staged_bootstrap_reads_its_tables_once(spark, monkeypatch):
    """No draw multiplies rows: each table is scanned once however many draws there are, and 200 draws equal their sums by hand."""
    own = [(s, v, 1.0 + 0.1 * v, -(0.55 + 0.04 * s + 0.01 * v) * (1.0 + 0.1 * v), 0.05, 0.05, 0.4 if v % 2 else -0.5) for s in range(6) for v in range(5)]
    t = spark.createDataFrame(own, "session_id long, video_id long, a double, b double, sa double, sb double, c double")
    t = t.withColumns({n: F.lit(v) for n, v in (("m1", 0.012), ("m2", 0.02), ("r1", 0.02), ("r2", 0.025), ("i1", 2.4e-6), ("i2", 6.25e-6), ("sc", 0.01))})
    t = estimators.predict_impacts(t, F.lit(0.7), F.lit(-0.5), F.lit(0.2)).select("session_id", "video_id", F.col("c_after").alias("c_obs")).join(t, ["session_id", "video_id"])  # b as observed
    mu = spark.createDataFrame([(s, v, 0.1 + 0.01 * s + 0.001 * v) for s in range(6) for v in range(5)], "session_id long, video_id long, value double")
    draws = estimators.draws(estimators.numbered_groups(t.select(F.col("session_id").alias("group_id"))), 200, 5)
    asked = []
    real = trials.written
    monkeypatch.setattr(trials, "written", lambda df, name: asked.append(name) or real(df, name))
    out = {r.boot_id: r for r in trials.staged_bootstrap(mu, t, draws).collect()}
    assert len(out) == 200 and asked.count("impacts") == 1 and not [r for r in out.values() if r.failure]
    times = {}
    for r in draws.collect():
        times.setdefault(r.boot_id, []).append(r.group_id)
    means = {s: 0.1 + 0.01 * s + 0.002 for s in range(6)}
    assert all(math.isclose(out[b].mu, sum(means[s] for s in own) / len(own)) for b, own in times.items())

    def loss(e, sessions):
        a, b = np.array([[x[2], x[3]] for s in sessions for x in own if x[0] == s]).T / 0.05
        x = np.maximum(0, (a - b * e) / (1 + e * e))
        for _ in range(6):
            w1, w2 = 1 / np.sqrt(1 + (b + e * x) ** 2), 1 / np.sqrt(1 + (x - a) ** 2)
            x = np.maximum(0, (w2 * a - w1 * b * e) / (w2 + w1 * e * e))
        return np.sum(np.sqrt(1 + (b + e * x) ** 2) + np.sqrt(1 + (x - a) ** 2) - 2)

    for b in range(0, 200, 23):
        low, high = 0.0, 1.0
        for _ in range(3):
            step = (high - low) / 40
            e = min((low + i / 40 * (high - low) for i in range(41)), key=lambda e: loss(e, times[b]))
            low, high = max(0.0, e - step), min(1.0, e + step)
        assert abs(loss(out[b].e_n, times[b]) - loss(e, times[b])) < 1e-9 and abs(out[b].e_n - e) < 1e-3


def test_tangential_pairs_are_withheld(spark):
    t = spark.createDataFrame([(g, 1.0 + 0.1 * v, 2.0 if v % 2 else -3.0) for g, n in (("ok", 6), ("few", 2), ("bound", 6)) for v in range(n)], "g string, a double, c double")
    t = t.withColumns({n: F.lit(v) for n, v in (("m1", 0.012), ("m2", 0.02), ("r1", 0.02), ("r2", 0.025), ("i1", 2.4e-6), ("i2", 6.25e-6), ("sc", 0.01))})
    made = estimators.predict_impacts(t, F.lit(0.7), F.when(F.col("g") == "bound", -1.0).otherwise(-0.5), F.when(F.col("g") == "bound", 0.0).otherwise(0.2)).select(*t.columns, F.col("c_after").alias("c_obs"))
    out = {r.g: r for r in estimators.tangential_fit(made, 0.7, by=["g"])[0].collect()}
    assert (out["ok"].withheld, out["few"].withheld, out["bound"].withheld) == (None, "fewer_than_3_trials", "on_bound") and out["ok"].n == 6
    assert abs(out["ok"].e_t + 0.5) < 0.02 and abs(out["ok"].mu - 0.2) < 0.02


def test_shared_draws_scale_a_group_alike(spark):
    rows = spark.createDataFrame([("g", 1.0, 2.0, 3.0, 0.1, 0.2, 0.1, 4.0, 5.0, 6.0), ("g", 2.0, 4.0, 6.0, 0.1, 0.2, 0.1, 4.0, 5.0, 6.0)], "group_id string, t double, x double, y double, sigma double, shared_scale double, shared_clock double, vx double, vy double, omega double")
    d = spark.range(400).select(F.col("id").alias("boot_id"), F.lit(0).cast("long").alias("slot"), F.lit("g").alias("group_id"))
    out = trials.bootstrap_shared(rows, d, 3).toPandas()
    assert np.allclose(out.x / out.y, 2 / 3) and np.allclose(out.vx, 4 * out.scale / out.clock) and np.allclose(out.omega * out.clock, 6)
    scale = np.log(out.groupby("boot_id")["scale"].first())
    assert abs(scale.mean()) < 0.04 and abs(scale.std() - 0.2) < 0.03 and out.groupby("boot_id")["scale"].nunique().max() == 1


def test_monte_carlo_moments(spark):
    df = spark.createDataFrame([("k", 10.0, 0.3)], "key string, v double, own double")
    r = estimators.monte_carlo(df, lambda c: 2 * c, "v", 0.05, "own", 4000, 1, second=lambda c: 3 * c).first()
    sd = math.hypot(10 * 0.05, 0.3)
    assert abs(r.mean - 20) < 0.1 and abs(r.std - 2 * sd) < 0.05 and abs(r.covariance - 6 * sd * sd) < 0.15 and abs((r.high - r.low) / (2 * 1.96 * 2 * sd) - 1) < 0.08


def test_diagnostics_are_numpys(spark):
    j = np.random.default_rng(1).normal(size=(30, 2)) * [1.0, 3.0]
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in j] + [("b", 1.0, 2.0), ("b", 2.0, 4.0)], "k string, j1 double, j2 double")
    out = {r.k: r for r in estimators.diagnostics(df, ["k"]).collect()}
    cov = np.linalg.inv(j.T @ j)
    assert np.allclose([out["a"].var1, out["a"].var2, out["a"].covariance], [cov[0, 0], cov[1, 1], cov[0, 1]]) and np.isclose(out["a"].condition, np.linalg.cond(j)) and np.isclose(out["a"].norm2, np.linalg.norm(j[:, 1]))
    assert out["b"].rank == 1 and out["b"].covariance is None and out["b"].condition is None
    e = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (0.4, 0.0, 1.0)], "value double, low double, high double")
    assert [r.active_bound for r in estimators.active_bounds(e).collect()] == ["low", "high", None]


def test_locked_labels_show_changes(spark):
    own = [(v, f, t, 1.0 * t) for v in (1, 2, 3) for f in range(5) for t in (1, 2)]
    df = spark.createDataFrame(own, "video_id long, frame_index long, track_id long, radius double")
    columns = ["frame_index", "track_id", "radius"]
    locks = trials.lock_labels(df, columns).select("video_id", "lock")
    changed = df.where("video_id <> 3").withColumn("radius", F.when((F.col("video_id") == 2) & (F.col("frame_index") == 4), 9.0).otherwise(F.col("radius")))
    assert trials.broken_locks(df.repartition(5), locks, columns).count() == 0
    assert sorted(r.video_id for r in trials.broken_locks(changed, locks, columns).collect()) == [2, 3]
    t = spark.createDataFrame([(s, v, 0.1 * s + 0.01 * v, 1.0) for s in range(6) for v in range(4)], "session_id long, video_id long, value double, variance double")
    r = trials.fit_dataset(t, spark.createDataFrame([(5,)], "session_id long"), draws=60, seed=1).first()
    assert r.ready and r.n_train == 20 and r.low < r.estimate < r.high


# ---- plans that must grow with their input only


def test_long_tracks_in_one_pass(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.lit(1).cast("long").alias("track_id"), F.lit(1).cast("long").alias("segment"), F.col("id").alias("frame_index"), (F.col("id") / 240).alias("t_s"))
    out = segments.chunks(df, 0.25, 24)
    assert out.agg(F.sum("n")).first()[0] == n and out.count() == math.ceil(n / 60)
    anchors = spark.range(0, n, 7).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("anchor_id"), (F.col("id") + 1).alias("frame"))
    near = scoring.nearest_anchor(df.where("frame_index % 5 = 0"), anchors)
    assert near.where("abs(nearest - frame) > 2 AND frame < %d" % (n - 5)).count() == 0
    plan = estimators.leave_one_out(df.select(F.col("frame_index").alias("video_id"), (F.col("frame_index") % 3).alias("session_id"), F.col("t_s").alias("value")))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_contested_frames_are_matched_at_the_least_distance(spark):
    rng = random.Random(4)
    t = [(v, f, k, 10.0 * k + rng.random(), 0.0, 40.0) for v in (1, 2) for f in range(30) for k in range(3)]
    p = [(v, f, k, 10.0 * k + 6 * rng.random(), 0.0) for v in (1, 2) for f in range(30) for k in range(3) if rng.random() < 0.9]
    T = spark.createDataFrame(t, "video_id long, frame_index long, track_id long, x double, y double, radius double")
    Q = spark.createDataFrame(p, "video_id long, frame_index long, track_id long, x double, y double")
    got = {}
    for r in scoring.match_labels(T, Q).collect():
        got.setdefault((r.video_id, r.frame_index), []).append(r.distance)
    for v, f in {(r[0], r[1]) for r in t}:
        a, b = [r for r in t if r[:2] == (v, f)], [r for r in p if r[:2] == (v, f)]
        best = (0, 0.0)
        for cols in itertools.permutations([*range(len(b)), *[-1] * len(a)], len(a)):
            d = [abs(a[i][3] - b[j][3]) for i, j in enumerate(cols) if j >= 0 and abs(a[i][3] - b[j][3]) <= 20]
            best = min(best, (-len(d), round(sum(d), 9)))
        own = got.get((v, f), [])
        assert (-len(own), round(sum(own), 9)) == best


# ---- streams


def test_links_against_a_loop(spark):
    rng = random.Random(6)
    dets = [(v, 4 * f, 100 * f + k, 100.0 * k + 5 * f + rng.random() * 20, 0.0, 10.0) for v in (1, 2) for f in range(25) for k in range(3) if rng.random() < 0.7]
    df = spark.createDataFrame(dets, "video_id long, frame_index long, det_id long, x double, y double, radius double")
    got = {(r.video_id, r.det_id): r.track for r in association.link_tracks(df).collect()}
    want = {}
    for v in (1, 2):
        live, serial = [], 0
        for f in sorted({d[1] for d in dets if d[0] == v}):
            own = sorted(d for d in dets if d[0] == v and d[1] == f)
            live = [t for t in live if f - t[2] <= 12]
            best, n = (math.inf, []), min(len(live), len(own))
            for rows_ in itertools.permutations(range(len(live)), n):
                for cols in itertools.combinations(range(len(own)), n):
                    best = min(best, (round(sum(abs(live[i][1] - own[j][3]) / 10 for i, j in zip(rows_, cols)), 9), list(zip(rows_, cols))))
            hit = {j: i for i, j in best[1]}
            for j, d in enumerate(own):
                i = hit.get(j)
                if i is None or abs(live[i][1] - d[3]) / 10 >= 3:
                    live.append([serial, 0, 0])
                    i, serial = len(live) - 1, serial + 1
                live[i][1:] = [d[3], f]
                want[v, d[2]] = live[i][0]
    assert got == want


@pytest.mark.parametrize("idle", [None, 2_000])
def test_the_last_event_of_a_pair_is_sent_when_it_is_idle(spark, tmp_path, idle):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    schema = "video_id long, a long, b long, frame_index long, gap double, near boolean"
    parts = [[(1, 1, 2, f, 0.5, True) for f in range(3)], [(1, 5, 6, 100, 9.0, False)], [(1, 5, 6, 101, 9.0, False)]]
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, schema).withColumn("ts", at(F.col("frame_index")))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "1 second")
    name = f"idle_{idle}"
    q = timing.pair_events_stream(stream, idle_ms=idle).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r)[1:6] for r in spark.sql(f"SELECT * FROM {name}").collect()]
    assert got == ([] if idle is None else [(1, 2, 0, 3, 0)])


def test_frame_issues_and_angles_of_labels(spark):
    o = spark.createDataFrame([(1, 0, "a", "observed"), (1, 1, "unknown_1", "observed"), (1, 1, "b", "missing")], "video_id long, frame_index long, track_id string, status string")
    f = spark.createDataFrame([(1, 0, 1, 2, 2, False, None), (1, 1, 2, 2, 3, True, True), (1, 2, 1, 2, 2, None, False)], "video_id long, frame_index long, expected long, participants long, chip_count_proposal long, missing_frame_suspected boolean, drift_suspected boolean")
    got = sorted((r.frame_index, r.reason) for r in quality.frame_issues(o, f).collect())
    assert got == [(1, "camera_drift"), (1, "irregular_time_gap"), (1, "more_proposed_than_participants"), (1, "observed_below_expected"), (1, "unknown_track"), (2, "observed_below_expected")]
    t = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 20.0, 3.1), (1, 0, 2, 100.0, 0.0, 20.0, 0.0)], "video_id long, frame_index long, track_id long, x double, y double, radius double, theta double")
    p = spark.createDataFrame([(1, 0, 1, 1.0, 0.0, -3.1), (1, 0, 2, 100.0, 0.0, 0.1)], "video_id long, frame_index long, track_id long, x double, y double, theta double")
    r = scoring.evaluate_labels(t, p, scoring.match_labels(t, p)).first()
    assert math.isclose(r.angle_mae, math.degrees((2 * math.pi - 6.2 + 0.1) / 2))


def test_edits_of_one_video_do_not_reach_another(spark):
    o = spark.createDataFrame([(v, f, 1, 0.0, 0.0, 1.0, 0.0, "observed", "observation") for v in (1, 2) for f in (0, 300, 30_000)], "video_id long, frame_index long, track_id long, x double, y double, radius double, theta double, status string, source string")
    schema = "seq long, video_id long, frame_from long, frame_to long, action string, track_id long, other_id long, nx double, ny double, n_radius double, n_theta double"
    log = [(1, 1, 250, 310, "exclude", 1, None, None, None, None, None), (2, 2, 0, 10**12, "angle", 1, None, None, None, None, 0.5), (3, None, 0, 0, "set_id", 1, 9, None, None, None, None)]
    out = {(r.video_id, r.frame_index): (r.track_id, r.theta, r.status, r.edit_ids) for r in edits.apply_edits(o, spark.createDataFrame(log, schema)).collect()}
    assert out == {(1, 0): (9, 0.0, "observed", [3]), (1, 300): (1, 0.0, "missing", [1]), (1, 30_000): (1, 0.0, "observed", []), (2, 0): (9, 0.5, "observed", [2, 3]), (2, 300): (1, 0.5, "observed", [2]), (2, 30_000): (1, 0.5, "observed", [2])}
