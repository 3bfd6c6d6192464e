"""Sweeps, grids and closed forms against plain loops and numpy."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from trackmill.functions import predicates as P
from trackmill.operators import estimators, intake, quality, segments


def test_the_sweep_finds_the_seed_of_all_pairs(spark):
    rng = random.Random(5)
    dets = [(v, s, round(rng.choice([10.0, 14.4, 20.0, 7.2, 13.8]) * rng.choice([1, 1, rng.uniform(0.7, 1.4)]), 3)) for v in range(6) for s in range(25) for _ in range(rng.randrange(5))]
    got = {(r.video_id, r.seed) for r in intake.size_cluster(spark.createDataFrame(dets, "video_id long, sample long, radius double")).collect()}
    want = set()
    for v in range(6):
        own = [(s, r) for w, s, r in dets if w == v]
        hits = {seed: len({s for s, r in own if 0.72 * seed < r < 1.38 * seed}) for seed in {r for _, r in own}}
        want.add((v, min(hits, key=lambda seed: (-hits[seed], seed))))
    assert got == want


def test_the_grid_finds_the_consensus_of_all_pairs(spark):
    rng = random.Random(6)
    cands = []
    for v in range(5):
        centres = [[rng.uniform(-1, 1) * 10 ** rng.randrange(-3, 4) for _ in range(4)] for _ in range(6)]
        for i in range(150):
            c, noise = rng.choice(centres), rng.choice([0, 0.01, 0.03, 0.06])
            size = sum(x * x for x in c) ** 0.5
            cands.append((v, i, rng.randrange(2), *[x + rng.uniform(-1, 1) * noise * size for x in c]))
        cands += [(v, 900 + i, 0, 0.0, 0.0, 0.0, 0.0) for i in range(2)]
    df = spark.createDataFrame(cands, "video_id long, cand_id long, orientation long, v0 double, v1 double, v2 double, v3 double")
    got = {r.video_id: (r.members, r.cand_id) for r in intake.consensus(df).collect()}
    for v in range(5):
        own = [(c[1], c[2], np.array(c[3:])) for c in cands if c[0] == v]
        near = {i: [j for j in own if j[1] == o and np.linalg.norm(x - j[2]) / max(np.linalg.norm(x), 1e-9) < 0.03] for i, o, x in own}
        first = collections.OrderedDict()
        for i, o, x in own:  # of equal vectors the first stands for all
            first.setdefault((o, tuple(x)), i)
        best = min(first.values(), key=lambda i: (-len(near[i]), i))
        assert got[v][0] == len(near[best])
        middle = np.median([x for _, _, x in near[best]], axis=0)
        far = {i: np.linalg.norm(x - middle) for i, _, x in near[best]}
        assert far[got[v][1]] <= min(far.values()) + 1e-9


def test_whitened_residuals_of_three(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        root = rng.normal(size=(3, 3))
        cov = root @ root.T - (3 * np.eye(3) if i % 9 == 0 else 0)
        r = [None if rng.random() < 0.25 else float(x) for x in rng.normal(size=3)]
        rows.append((i, *r, *[float(cov[a, b]) for a in range(3) for b in range(3)]))
    names = ["r0", "r1", "r2", *[f"c{a}{b}" for a in range(3) for b in range(3)]]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{n} double" for n in names))
    w = P.whiten([F.col(n) for n in names[:3]], [[F.col(f"c{a}{b}") for b in range(3)] for a in range(3)])
    got = {r.i: (r.w.q, r.w.problem) for r in df.select("i", w.alias("w")).collect()}
    for i, *x in rows:
        r, cov = x[:3], np.array(x[3:]).reshape(3, 3)
        own = [k for k in range(3) if r[k] is not None]
        sub, z = cov[np.ix_(own, own)], np.array([r[k] for k in own])
        if not own:
            assert got[i] == (None, "no_component")
        elif np.linalg.eigvalsh(sub).min() <= 0:
            assert got[i] == (None, "not_positive_definite")
        else:
            assert np.isclose(got[i][0], z @ np.linalg.solve(sub, z)) and got[i][1] is None


def test_three_parameter_diagnostics_are_numpys(spark):
    rng = np.random.default_rng(3)
    sets = {"a": rng.normal(size=(30, 3)) * [1.0, 3.0, 0.5], "b": np.outer(rng.normal(size=9), [1.0, 2.0, 3.0]), "c": np.column_stack([*rng.normal(size=(2, 12)), np.zeros(12)]), "d": np.zeros((3, 3)), "e": np.eye(3)}
    df = spark.createDataFrame([(k, *map(float, x)) for k, j in sets.items() for x in j], "k string, j1 double, j2 double, j3 double")
    out = {r.k: r for r in estimators.diagnostics3(df, ["k"]).collect()}
    assert [out[k].rank for k in "abcde"] == [3, 1, 2, 0, 3]
    for k in "ae":
        cov, r = np.linalg.inv(sets[k].T @ sets[k]), out[k]
        assert np.allclose([r.var1, r.var2, r.var3, r.covariance12, r.covariance13, r.covariance23], [cov[0, 0], cov[1, 1], cov[2, 2], cov[0, 1], cov[0, 2], cov[1, 2]])
        assert np.isclose(r.condition, np.linalg.cond(sets[k])) and np.isclose(r.correlation23, cov[1, 2] / np.sqrt(cov[1, 1] * cov[2, 2])) and np.isclose(r.norm3, np.linalg.norm(sets[k][:, 2]))
    assert all(out[k].condition is None and out[k].var1 is None and out[k].correlation12 is None for k in "bcd")


def test_proposals_are_suppressed_by_the_smaller_radius(spark):
    rng = random.Random(8)
    dets = [(f, i, float(rng.randrange(9)), rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(3, 20)) for f in range(8) for i in range(20)]
    df = spark.createDataFrame(dets, "frame_index long, det_id long, residual double, x double, y double, radius double")
    got = {(r.frame_index, r.det_id) for r in quality.suppress(df, 0.8, ["frame_index"], of_smaller=True).collect()}
    want = set()
    for f in range(8):
        kept = []
        for d in sorted((d for d in dets if d[0] == f), key=lambda d: (d[2], d[1])):
            if all(((d[3] - o[3]) ** 2 + (d[4] - o[4]) ** 2) ** 0.5 >= 0.8 * min(d[5], o[5]) for o in kept):
                kept.append(d)
        want |= {(f, d[1]) for d in kept}
    assert got == want


def test_last_values_are_the_last_of_a_video(spark):
    rng = random.Random(9)
    rows = [(v, f, t, rng.random() if rng.random() < 0.8 else None) for v in range(3) for f in range(90) for t in range(3)]
    df = spark.createDataFrame(rows, "video_id long, frame_index long, track_id long, e double")
    got = {r.video_id: (r.median, r.n) for r in quality.residual_median(df, "e", 50, parts=4).collect()}
    for v in range(3):
        last = [e for _, _, _, e in sorted((r for r in rows if r[0] == v and r[3] is not None), key=lambda r: r[1:3])][-50:]
        assert np.isclose(got[v][0], np.median(last)) and got[v][1] == 50


def test_decimated_rows_break_where_the_scope_changes(spark):
    df = spark.createDataFrame([(1, 1, f, None if f < 4 else f // 10) for f in range(40) if f not in (21, 22, 23)], "video_id long, track_id long, frame_index long, scope long")
    got = {r.frame_index: r.breaks for r in segments.decimate(df, 100, "scope").collect()}
    assert {f for f, b in got.items() if b} == {4, 10, 20, 24, 30}
    assert {r.frame_index for r in segments.decimate(df, 100).where("breaks").collect()} == {24}


def test_moving_rows(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.05, 0.05), (None, 1.0), (-0.2, 0.1)], "vx double, vy double")
    assert [r[0] for r in df.select(segments.moving()).collect()] == [True, False, False, True]


def test_segment_coefficients_are_numpys(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(4):
        t = np.arange(2 if k == 3 else 30) / 100
        s = 0.2 + 0.5 * t - (-0.3 if k == 2 else 0.6) * t * t + rng.normal(scale=3e-4 if k == 1 else 1e-4, size=len(t))
        rows += [(k, 5 + float(x), float(y), 1e-4, k == 1 and i == 7) for i, (x, y) in enumerate(zip(t, s))]
    df = spark.createDataFrame(rows, "k long, t_s double, s double, sigma double, warned boolean")
    out = {r.k: r for r in estimators.segment_coefficient(df, ["k"]).collect()}
    for k in range(3):
        t, s = np.array([[r[1] - 5, r[2]] for r in rows if r[0] == k]).T
        j = np.column_stack([np.ones_like(t), t, t * t]) / 1e-4
        beta = np.linalg.lstsq(j, s / 1e-4, rcond=None)[0]
        chi2 = float(np.sum((s / 1e-4 - j @ beta) ** 2))
        variance = np.linalg.inv(j.T @ j)[2, 2] * max(1, chi2 / (len(t) - 3)) * 4 / estimators.G**2
        assert np.isclose(out[k].mu, -2 * beta[2] / estimators.G, rtol=1e-6) and np.isclose(out[k].mu_variance, variance, rtol=1e-4)
        assert np.isclose(out[k].position_rmse, np.sqrt(chi2 / len(t)) * 1e-4, rtol=1e-3) and not out[k].rank_deficient
    assert [out[k].status for k in range(4)] == ["computed", "computed_with_warnings", "candidate_only", "not_computed"]
    assert [out[k].active_bound for k in range(4)] == [None, None, "low", None] and out[3].rank_deficient and out[3].mu_variance is None


def test_normal_trials_have_sigmas_with_a_floor(spark):
    names = [f"{side}_{s}v{axis}{i}" for s in ("", "s") for side in ("pre", "post") for axis in "xy" for i in (1, 2)]
    own = [(0, 3.0, 4.0, *[1.0, -1.0, 0.5, 0.0], *[-0.5, 0.5, 0.0, 0.1], *[0.01, 0.02, 0.03, 0.04], *[1e-5] * 4), (1, 1.0, 0.0, *[1.0, 0.0, 0.0, 0.0], *[-0.5, 0.0, 0.0, 0.0], *[0.01] * 4, *[None] * 4)]
    out = {r.event_id: r for r in estimators.normal_trials(spark.createDataFrame(own, "event_id long, nx double, ny double, " + ", ".join(f"{n} double" for n in names))).collect()}
    assert np.isclose(out[0].a, (2.0 * 3 + 0.5 * 4) / 5) and np.isclose(out[0].sa, np.sqrt(0.36 * (0.01**2 + 0.02**2) + 0.64 * (0.03**2 + 0.04**2))) and out[0].sb == 0.003 and out[0].warning is None
    assert np.isclose(out[1].e_obs, 0.5) and out[1].sb is None and out[1].warning == "sigma_missing" and out[1].skip_reason is None
