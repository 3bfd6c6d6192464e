"""Trials from trajectories and events, their gates, and the release and frozen scoring of coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import finite, usable
from ..sources.shared import written
from . import cells, estimators, pairs, segments

TRACK = segments.TRACK


def trial_gate(exploratory: bool = False) -> Column:
    """Why a trial (time_status, geometry_status, source, sigmas) may not be fitted; null if it may."""
    time = ("declared", "verified", "synthetic_known_clock") if exploratory else ("verified", "synthetic_known_clock")
    space = ("provisional", "verified", "synthetic") if exploratory else ("verified", "synthetic")
    fit = F.coalesce(F.forall("sigmas", lambda s: finite(s) & (s > 0)) & (F.size("sigmas") > 0), F.lit(False))
    return (
        F.when(~F.coalesce(F.col("time_status").isin(*time), F.lit(False)), "time_not_verified")
        .when(~F.coalesce(F.col("geometry_status").isin(*space), F.lit(False)), "geometry_not_verified")
        .when(F.col("source").isin("physics_prediction", "tracking_prediction"), "prediction_is_no_observation")
        .when(~fit, "sigma_not_positive")
    )


def free_trials(traj: DataFrame, barriers: DataFrame | None = None, duration: float = 0.25, min_rows: int = 24, prefix: int = 12) -> DataFrame:
    """One row for each trial: trial_id, video_id, track_id, session_id, frame_from, frame_to, n, and the state x0, vx, y0, vy at the prefix's last time.

    Usable rows with orientation outside barriers, in contiguous segments, cut greedily into chunks of `duration`; chunks of under
    min_rows rows are no trials. The state comes from the first `prefix` rows alone, never from rows that are scored later."""
    rows = segments.islands(traj.where(usable(orientation=True)), barriers=barriers)
    cuts = segments.chunks(rows, duration, min_rows).where("NOT skipped")
    cuts = cuts.withColumn("frame_index", F.explode(F.sequence("frame_from", "frame_to"))).drop("segment")
    own = rows.drop("segment").join(cuts, [*TRACK, "frame_index"])
    own = own.withColumn("segment", F.col("frame_from"))
    state = segments.prefix_state(own, prefix).withColumnRenamed("segment", "frame_from")
    out = own.groupBy(*TRACK, "session_id", "frame_from", "frame_to").agg(F.count("*").alias("n"))
    out = out.join(state, [*TRACK, "frame_from"])
    trial = F.concat_ws("_", F.col("video_id").cast("string"), F.col("track_id").cast("string"), F.concat(F.lit("f"), "frame_from"))
    return out.withColumn("trial_id", trial)


def score_frozen(trials: DataFrame, rows: DataFrame, prefix: int = 12) -> DataFrame:
    """(trial_id, scored, rmse): straight-line prediction from a trial's frozen state against its rows after the prefix. Nothing is fitted
    again."""
    own = trials.withColumn("frame_index", F.explode(F.sequence("frame_from", "frame_to")))
    own = own.join(rows.select(*TRACK, "frame_index", "t_s", "x", "y"), [*TRACK, "frame_index"])
    place = F.row_number().over(Window.partitionBy("trial_id").orderBy("frame_index"))
    own = own.withColumn("place", place)
    own = own.withColumn("t0", F.max(F.when(F.col("place") <= prefix, F.col("t_s"))).over(Window.partitionBy("trial_id")))
    ex = F.col("x") - (F.col("x0") + F.col("vx") * (F.col("t_s") - F.col("t0")))
    ey = F.col("y") - (F.col("y0") + F.col("vy") * (F.col("t_s") - F.col("t0")))
    return own.where(F.col("place") > prefix).groupBy("trial_id").agg(F.count("*").alias("scored"), F.sqrt(F.avg(ex * ex + ey * ey)).alias("rmse"))


def evaluate_fixed(bank: DataFrame, free: DataFrame, rows: DataFrame, impacts: DataFrame, prefix: int = 12) -> DataFrame:
    """One row: how a frozen bank (one row, e_n, e_t, mu) predicts trials that it has not seen; nothing is fitted. n_free and free_rmse of rows after
    each free trial's prefix; n_normal and normal_rmse of -e_n a against b; n_tangential and tangential_rmse of the slip after (c_obs, of trials
    as for predict_impacts), only if all three coefficients exist, else tangential_reason; and a digest of the coefficients, which a later
    run compares. Coefficients that are null give null scores."""
    digest = F.sha2(F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.coalesce(F.format_number(c, 9), F.lit("null"))) for c in ("e_n", "e_t", "mu")]), 256)
    bank = F.broadcast(bank.select("e_n", "e_t", "mu", digest.alias("parameter_hash")).limit(1))
    f = score_frozen(free, rows, prefix).agg(F.sum("scored").alias("n_free"), F.sqrt(F.try_divide(F.sum(F.col("scored") * F.col("rmse") * F.col("rmse")), F.sum("scored"))).alias("free_rmse"))
    own = impacts.crossJoin(bank.select(F.col("e_n").alias("b_n"), F.col("e_t").alias("b_t"), F.col("mu").alias("b_mu")))
    off = -F.col("b_n") * F.col("a") - F.col("b")
    normal = own.where(F.col("a") > 1e-12).agg(F.count(off).alias("n_normal"), F.sqrt(F.avg(off * off)).alias("normal_rmse"))
    whole = F.col("b_n").isNotNull() & F.col("b_t").isNotNull() & F.col("b_mu").isNotNull()
    told = estimators.predict_impacts(own.where(whole & F.col("c_obs").isNotNull()).drop("b"), F.col("b_n"), F.col("b_t"), F.col("b_mu"))
    slip = F.col("c_after") - F.col("c_obs")
    pair = told.where("status = 'ok'").agg(F.count(slip).alias("n_tangential"), F.sqrt(F.avg(slip * slip)).alias("tangential_rmse"))
    missing = F.when(F.col("e_n").isNull() | F.col("e_t").isNull() | F.col("mu").isNull(), "coefficient_missing").when(F.col("n_tangential") == 0, "no_trials")
    out = bank.crossJoin(f).crossJoin(normal).crossJoin(pair)  # one row each
    return out.select(F.coalesce("n_free", F.lit(0)).alias("n_free"), "free_rmse", "n_normal", "normal_rmse", "n_tangential", "tangential_rmse", missing.alias("tangential_reason"), "parameter_hash")


def impact_trials(events: DataFrame) -> DataFrame:
    """events (event_id, pre, post: two states each with velocity, omega and sigmas; reviewed) that are tangential trials: all four spins known, with
    sigma floors 0.01 and 1.0; approved only if a person reviewed them."""
    states = F.concat("pre", "post")
    known = (F.size(states) == 4) & F.forall(states, lambda s: F.coalesce(finite(s["omega"]) & finite(s["velocity"][0]) & finite(s["velocity"][1]), F.lit(False)))
    floors = F.transform(states, lambda s: F.struct(F.greatest(F.coalesce(s["velocity_sigma"], F.lit(0.01)), F.lit(0.01)).alias("velocity"), F.greatest(F.coalesce(s["omega_sigma"], F.lit(1.0)), F.lit(1.0)).alias("omega")))
    return events.where(known).withColumns({"sigmas": floors, "approved": F.coalesce("reviewed", F.lit(False))})


def reject_noncontact(events: DataFrame, obs: DataFrame, radius_sigma: float, quiet: float = 1e-3, around: int = 10) -> DataFrame:
    """events (video_id, event_id, a, b, frame_start, frame_end, min_gap, kind) with kind noncontact_pass where the gap is over max(3 mm, 4 root sum of sigma^2) and
    one track stays within `quiet` of its medians through `around` frames before and after, five rows each side."""
    own = events.where(_far(radius_sigma)).select("video_id", "event_id", F.explode(F.array("a", "b")).alias("track_id"), "frame_start", "frame_end")
    still = _still(own, obs, ["video_id", "event_id", "track_id"], quiet, around).select("video_id", "event_id").distinct().withColumn("still", F.lit(True))
    out = events.join(still, ["video_id", "event_id"], "left")
    return out.withColumn("kind", F.when(F.col("still"), "noncontact_pass").otherwise(F.col("kind"))).drop("still")


def reject_pair_noncontact(obs: DataFrame, radius_sigma: float, quiet: float = 1e-3, around: int = 10) -> DataFrame:
    """The pair events of obs with kinds of reject_noncontact. Whether a track is still is told once for all its events of one range."""
    keys = ["video_id", "track_id", *cells.NUMBERS]
    own = cells.frame_ranges(obs, cells.chain_events(obs)).select(*keys)
    out = cells.events(obs, values=own.join(_still_ranges(own, obs, quiet, around).withColumn("still", F.lit(1)), keys, "left"))
    passes = _far(radius_sigma) & F.coalesce("a_still", "b_still").isNotNull()
    return out.withColumn("kind", F.when(passes, "noncontact_pass").otherwise(F.col("kind"))).drop("a_still", "b_still")


def count_pair_noncontact(obs: DataFrame, radius_sigma: float, quiet: float = 1e-3, around: int = 10) -> DataFrame:
    """(video_id, kind, n): how many events reject_pair_noncontact gives. Those of one frame are counted where they are found; which rows could be one that is still is told before."""
    chains = cells.chain_events(obs)
    lone = cells._one_frame(cells.ready(obs).where("track_id IS NOT NULL").select("video_id", "track_id", F.col("frame_index").alias("closest_frame")))
    keys = ["video_id", "track_id", *cells.NUMBERS]
    far = written(chains.where(_far(radius_sigma)), "far-events")  # few, and wanted more than once
    still = written(_still_ranges(lone.select(*keys).unionByName(cells.ranges(far).select(*keys)).distinct(), obs, quiet, around), "still-ranges")
    single = cells.count_by_frame(obs, still, _gap(radius_sigma)).select("video_id", F.when(F.col("told"), "noncontact_pass").otherwise("unmeasurable").alias("kind"), "n")
    told = still.withColumn("still", F.lit(1))
    for side in "ab":
        far = far.join(told.withColumnsRenamed({"track_id": side, "still": f"{side}_still"}), ["video_id", side, *cells.NUMBERS], "left")
    far = far.withColumn("kind", F.when(F.coalesce("a_still", "b_still").isNotNull(), "noncontact_pass").otherwise(F.col("kind")))
    several = [rows.groupBy("video_id", "kind").agg(F.count("*").alias("n")) for rows in (far, chains.where(~_far(radius_sigma)))]
    return single.unionByName(several[0]).unionByName(several[1]).groupBy("video_id", "kind").agg(F.sum("n").alias("n"))


def _still_ranges(ranges: DataFrame, obs: DataFrame, quiet: float, around: int) -> DataFrame:
    keys = ["video_id", "track_id", *cells.NUMBERS]
    return _still(ranges.select(*keys), obs, keys, quiet, around).select(*keys)


def _gap(radius_sigma: float) -> float:
    return max(0.003, 4 * (2 * radius_sigma**2) ** 0.5)


def _far(radius_sigma: float) -> Column:
    return F.col("min_gap") > _gap(radius_sigma)


def _still(own: DataFrame, obs: DataFrame, keys: list[str], quiet: float, around: int) -> DataFrame:
    """Those of the ranges (video_id, track_id, frame_start, frame_end, and keys) whose track is still about them."""
    cut = own.withColumns({"lo": F.greatest(F.lit(0), F.col("frame_start") - around), "hi": F.col("frame_end") + around})
    rows = pairs.rows_in_ranges(cut, obs.where(usable(time=False)).select("video_id", "track_id", "frame_index", "x", "y"), [c for c in dict.fromkeys([*keys, "frame_start", "frame_end"]) if c not in ("video_id", "track_id")], 32)
    of = Window.partitionBy(*keys)
    rows = rows.withColumns({"before": F.count_if(F.col("frame_index") < F.col("frame_start")).over(of), "after": F.count_if(F.col("frame_index") > F.col("frame_end")).over(of)}).where("before >= 5 AND after >= 5")
    rows = rows.withColumns({"mx": F.percentile("x", F.lit(0.5)).over(of), "my": F.percentile("y", F.lit(0.5)).over(of)})
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return rows.groupBy(*keys).agg(F.max(F.sqrt(dx * dx + dy * dy)).alias("off")).where(F.col("off") < quiet)


def coefficient_status(trials: DataFrame, refs: DataFrame) -> DataFrame:
    """(coefficient, trials, videos, sessions, used, warned, fraction, reasons) of trials (coefficient, trial_id, video_id, session_id) and their references
    (trial_id, video_id, track_id, frame_index, reason or null): references of several trials count once."""
    n = trials.groupBy("coefficient").agg(F.count_distinct("trial_id").alias("trials"), F.count_distinct("video_id").alias("videos"), F.count_distinct("session_id").alias("sessions"))
    own = refs.join(trials.select("trial_id", "coefficient"), "trial_id").groupBy("coefficient", "video_id", "track_id", "frame_index").agg(F.max(F.col("reason").isNotNull()).alias("warned"), F.collect_set("reason").alias("reasons"))
    own = own.groupBy("coefficient").agg(F.count("*").alias("used"), F.count_if("warned").alias("warned"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))
    return n.join(own, "coefficient", "left").withColumn("fraction", F.try_divide("warned", "used"))


def build_bank(estimates: DataFrame, status: DataFrame) -> DataFrame:
    """(coefficient, value, release, reason, digest): an estimate is provisional; one without a value, on its bound, or from under three trials is
    withheld. digest covers all released values, so that a change of any of them shows."""
    out = estimates.join(status.select("coefficient", "trials"), "coefficient", "left")
    reason = F.when(F.col("value").isNull(), "not_estimable").when(F.coalesce("trials", F.lit(0)) < 3, "too_few_trials").when(F.col("on_bound"), "on_bound")
    out = out.withColumn("reason", reason).withColumn("release", F.when(F.col("reason").isNull(), "provisional").otherwise("withheld"))
    text = F.concat_ws("=", "coefficient", F.format_number("value", 9))
    whole = out.where("reason IS NULL").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ";"), 256).alias("digest"))
    return out.select("coefficient", "value", "release", "reason").crossJoin(whole)


def split_roles(videos: DataFrame, locked: DataFrame) -> DataFrame:
    """videos (video_id, session_id, role) and problem: a locked session among training or holdout videos."""
    own = locked.select("session_id").distinct().withColumn("is_locked", F.lit(True))
    out = videos.join(own, "session_id", "left")
    bad = F.coalesce(F.col("is_locked"), F.lit(False)) & F.col("role").isin("train", "holdout")
    return out.withColumn("problem", F.when(bad, "locked_session")).drop("is_locked")


def preflight(free: DataFrame, events: DataFrame) -> DataFrame:
    """(video_id, free_segments, candidates, normal_eligible, usable) of trials (video_id) and events (video_id, kind, status, a)."""
    f = free.groupBy("video_id").agg(F.count("*").alias("free_segments"))
    pair = (F.col("kind") == "isolated_binary") & ~F.coalesce(F.col("status") == "excluded", F.lit(False))
    e = events.groupBy("video_id").agg(F.count_if(pair).alias("candidates"), F.count_if(pair & (F.col("a") > 1e-12)).alias("normal_eligible"))
    out = f.join(e, "video_id", "full_outer").fillna(0)
    return out.withColumn("usable", (F.col("free_segments") > 0) | (F.col("normal_eligible") > 0))


def readout_bound(max_speed: Column, readout: Column, omega_bound: Column) -> tuple[Column, Column, Column]:
    """Position and angle bias at most, and the status: bound_only_not_corrected, or unmeasured without a readout time."""
    return max_speed * readout, omega_bound * readout, F.when(readout.isNull(), "unmeasured").otherwise("bound_only_not_corrected")


def with_frozen(current: DataFrame, frozen: DataFrame, blocks: list[str]) -> DataFrame:
    """current settings (video_id, ...) for a coefficient: the given blocks as they were when the video was measured (frozen, video_id and the
    blocks), all others, of bodies and models, as they are today. A video without frozen blocks keeps today's."""
    f = frozen.select("video_id", F.lit(True).alias("was_frozen"), *[F.col(b).alias(f"f_{b}") for b in blocks])
    out = current.join(f, "video_id", "left")
    return out.withColumns({b: F.when(F.col("was_frozen"), F.col(f"f_{b}")).otherwise(F.col(b)) for b in blocks}).drop("was_frozen", *[f"f_{b}" for b in blocks])


def effective(videos: DataFrame, project: DataFrame, blocks: list[str]) -> DataFrame:
    """videos with each block of settings its own where it has one, else the project's, whole: blocks are never merged. The project is one row."""
    p = project.select(*[F.col(b).alias(f"p_{b}") for b in blocks])
    return videos.crossJoin(F.broadcast(p)).withColumns({b: F.coalesce(b, f"p_{b}") for b in blocks}).drop(*[f"p_{b}" for b in blocks])


def validate_numbers(settings: DataFrame) -> DataFrame:
    """Violations (subject, problem) of settings (video_id, duration, normal_draws, tangential_draws, omega_bound, shared_scale, shared_clock, min_samples,
    max_samples, window_s): a duration or window that is no positive number, draws outside 0 to 10,000, a turning bound that is neither null nor
    positive, shared sigmas under 0, and samples outside 3 <= min <= max <= 1001."""
    c = F.col
    good = lambda x: F.coalesce(finite(x) & (x > 0), F.lit(False))
    found = F.array_compact(F.array(
        F.when(~good(c("duration")), "duration"), F.when(~good(c("window_s")), "window"),
        F.when(~F.coalesce(c("normal_draws").between(0, 10_000) & c("tangential_draws").between(0, 10_000), F.lit(False)), "draws"),
        F.when(c("omega_bound").isNotNull() & ~good(c("omega_bound")), "omega_bound"),
        F.when(~F.coalesce(finite(c("shared_scale")) & finite(c("shared_clock")) & (F.least("shared_scale", "shared_clock") >= 0), F.lit(False)), "shared_sigma"),
        F.when(~F.coalesce((c("min_samples") >= 3) & (c("min_samples") <= c("max_samples")) & (c("max_samples") <= 1001), F.lit(False)), "samples"),
    ))
    return settings.select(F.col("video_id").cast("string").alias("subject"), F.explode(found).alias("problem"))


def validate_settings(videos: DataFrame, tracks: DataFrame, most_tracks: int | None = None) -> DataFrame:
    """Violations (subject, problem): track ids that repeat, none or more than most_tracks (32 for one project), properties that are not positive, participants
    that don't exist or repeat, and empty intervals."""
    repeat = tracks.groupBy("track_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("track_id").cast("string").alias("subject"), F.lit("repeated_track").alias("problem"))
    bad = tracks.where(F.least("mass", "radius") <= 0).select(F.col("track_id").cast("string").alias("subject"), F.lit("not_positive").alias("problem"))
    part = videos.select("video_id", F.explode("participants").alias("track_id"))
    gone = part.join(tracks.select("track_id").distinct(), "track_id", "left_anti").select(F.col("video_id").cast("string").alias("subject"), F.lit("unknown_participant").alias("problem")).distinct()
    twice = videos.where(F.size("participants") != F.size(F.array_distinct("participants"))).select(F.col("video_id").cast("string").alias("subject"), F.lit("repeated_participant").alias("problem"))
    empty = videos.where(F.col("end") < F.col("start")).select(F.col("video_id").cast("string").alias("subject"), F.lit("empty_interval").alias("problem"))
    out = repeat.unionByName(bad).unionByName(gone).unionByName(twice).unionByName(empty)
    if most_tracks is None:
        return out
    return out.unionByName(tracks.agg(F.count("*").alias("n")).where(~F.col("n").between(1, most_tracks)).select(F.lit("project").alias("subject"), F.lit("track_count").alias("problem")))


def compatible(frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    """frames (video_id, width, height, mode) with compatible: the calibration's size is equal if it has one, and its mode too unless it is null or pending."""
    c = calibrations.select("video_id", *[F.col(x).alias(f"c_{x}") for x in ("width", "height", "mode")])
    out = frames.join(c, "video_id", "left")
    size = (F.coalesce("c_width", "width") == F.col("width")) & (F.coalesce("c_height", "height") == F.col("height"))
    mode = F.col("c_mode").isNull() | (F.col("c_mode") == "pending") | (F.col("c_mode") == F.col("mode"))
    return out.withColumn("compatible", F.coalesce(size & mode, F.lit(False))).drop("c_width", "c_height", "c_mode")


def staged_bootstrap(segments_mu: DataFrame, impacts: DataFrame, draws: DataFrame, points: int = 9, zooms: int = 3, normal_points: int = 41, normal_zooms: int = 3) -> DataFrame:
    """(boot_id, mu, e_n, e_t, mu_c, failure): all stages estimated again for each draw (boot_id, slot, group_id) of sessions: the
    segments' coefficient (rows session_id, video_id, value) by the hierarchy, normal restitution from impacts (session_id, a, b, sa,
    sb), and with it the tangential pair from those that have c_obs, sc and bodies. A drawn session counts as often as it is drawn. A stage that has nothing to go on gives null, and
    failure says which.

    A draw never multiplies rows. It is its sessions' counts, and every estimate here is a sum over sessions: of means for the segments, of losses at a
    cell of a grid for the others. So the segments are read once, and the impacts once to a narrow table; a zoom sums that table's losses for each
    session and cell, over the cells that any draw asks for, and a draw's losses are its counts times its sessions'. Draws that
    look at the same window share it: the cells are a broadcast of draws x cells rows at most."""
    counts = written(draws.groupBy("boot_id", "group_id").agg(F.count("*").alias("times")), "draws")
    video = segments_mu.groupBy("session_id", "video_id").agg(F.avg("value").alias("value"))
    session = video.groupBy(F.col("session_id").alias("group_id")).agg(F.avg("value").alias("mean"))
    mu = counts.join(session, "group_id").groupBy("boot_id").agg((F.sum(F.col("times") * F.col("mean")) / F.sum("times")).alias("mu"))
    columns = ["a", "b", "sa", "sb", "c", "c_obs", "sc", "m1", "m2", "r1", "r2", "i1", "i2"]
    own = written(impacts.select(F.col("session_id").alias("group_id"), *columns), "impacts")

    def searched(rows: DataFrame, start: DataFrame, window: list[str], cell: list[str], grid, cost, narrowed, rounds: int) -> DataFrame:
        """start (boot_id and window) with the best cell of the last of so many rounds."""
        best = start
        for _ in range(rounds):
            asked = written(grid(best.select(*window).distinct()), "cells")
            sums = cost(estimators.on_grid(rows, asked, [], asked.count())).groupBy("group_id", *window, *cell).agg(F.sum("cost").alias("cost"))
            sums = written(sums, "losses")
            drawn = counts.join(best.select("boot_id", *window), "boot_id").join(sums, ["group_id", *window])
            drawn = drawn.groupBy("boot_id", *window, *cell).agg(F.sum(F.col("times") * F.col("cost")).alias("cost"))
            top = drawn.groupBy("boot_id").agg(F.min_by(F.struct(*cell, *window), F.struct("cost", *cell)).alias("t")).select("boot_id", "t.*")
            best = written(narrowed(top), "best")
        return best

    every = counts.select("boot_id").distinct()
    normal = searched(
        own.where((F.col("a") > 1e-12) & F.col("b").isNotNull()).select("group_id", "a", "b", "sa", "sb"), every.withColumns({"low": F.lit(0.0), "high": F.lit(1.0)}), ["low", "high"], ["e"],
        lambda w: estimators._restitution_grid(w, normal_points), estimators.restitution_cost,
        lambda t: t.withColumns(estimators._restitution_window(normal_points)).select("boot_id", "e", F.col("new_low").alias("low"), F.col("new_high").alias("high")),
        normal_zooms,
    ).select("boot_id", F.col("e").alias("fit_e"))
    window = estimators.TANGENTIAL_WINDOW
    pair = searched(
        own.where("c_obs IS NOT NULL AND sc > 0"), normal.select("boot_id", "fit_e", *[F.lit(v).alias(n) for n, v in estimators.TANGENTIAL_START]), ["fit_e", *window], ["gt", "gm"],
        lambda w: estimators._tangential_grid(w, points), lambda rows: estimators.tangential_cost(rows, F.col("fit_e")),
        lambda t: t.select("boot_id", "fit_e", "gt", "gm", *estimators._tangential_window(points)),
        zooms,
    ).select("boot_id", F.col("gt").alias("e_t"), F.col("gm").alias("mu_c"))
    out = every.join(mu, "boot_id", "left").join(normal, "boot_id", "left").join(pair, "boot_id", "left")
    failure = F.when(F.col("mu").isNull(), "no_segments").when(F.col("fit_e").isNull(), "no_normal_trials").when(F.col("e_t").isNull(), "no_tangential_trials")
    return out.select("boot_id", "mu", F.col("fit_e").alias("e_n"), "e_t", "mu_c", failure.alias("failure"))


def free_trial_range(rows: DataFrame, ranges: DataFrame, barriers: DataFrame, least: int = 6, most: int = 5_000) -> DataFrame:
    """(range_id, n, problem) of ranges (range_id, video_id, track_id, frame_from, frame_to) chosen by hand: every frame must be a usable row with rising time,
    least to most of them, and no barrier may lie within."""
    own = ranges.withColumn("frame_index", F.explode(F.sequence("frame_from", "frame_to")))
    own = own.join(rows.where(usable(orientation=True)).select(*TRACK, "frame_index", "t_s"), [*TRACK, "frame_index"], "left")
    order = Window.partitionBy("range_id").orderBy("frame_index")
    own = own.withColumn("falls", F.coalesce(F.col("t_s") <= F.lag("t_s").over(order), F.lit(False)))
    n = own.groupBy("range_id").agg(F.count("t_s").alias("n"), F.count("*").alias("frames"), F.bool_or("falls").alias("falls"))
    cut = barriers.select(*TRACK, "start", "end").join(ranges, [*TRACK]).where("start <= frame_to AND end >= frame_from").select("range_id").distinct().withColumn("cut", F.lit(True))
    out = n.join(cut, "range_id", "left")
    problem = F.when(F.col("cut"), "event_in_range").when(F.col("n") < F.col("frames"), "missing_rows").when(F.col("falls"), "time_falls").when((F.col("n") < least) | (F.col("n") > most), "row_count")
    return out.select("range_id", "n", problem.alias("problem"))


def bootstrap_shared(rows: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """rows (group_id, t, x, y, sigma, shared_scale, shared_clock) of each draw (boot_id, slot, group_id), with one log-normal scale and one clock factor for each drawn group:
    positions and sigmas are scaled, times stretched; where rows have velocities (vx, vy) these are scaled and slowed, and spins (omega) slowed. Factors are
    counter based, so any task can repeat them."""

    def normal(kind: int) -> Column:
        return sum((F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), F.lit(i), "boot_id", "slot"), F.lit(1 << 30)) / float(1 << 30) for i in range(12)), F.lit(-6.0))

    own = draws.withColumns({"z_scale": normal(0), "z_clock": normal(1)}).join(rows, "group_id")
    scale, clock = F.exp(F.col("z_scale") * F.col("shared_scale")), F.exp(F.col("z_clock") * F.col("shared_clock"))
    own = own.withColumns({"scale": scale, "clock": clock})
    speeds = {c: F.col(c) * F.col("scale") / F.col("clock") for c in ("vx", "vy") if c in rows.columns} | {c: F.col(c) / F.col("clock") for c in ("omega",) if c in rows.columns}
    return own.withColumns(speeds | {"t": F.col("t") * F.col("clock"), "x": F.col("x") * F.col("scale"), "y": F.col("y") * F.col("scale"), "sigma": F.col("sigma") * F.col("scale")}).drop("z_scale", "z_clock")


def fit_dataset(trials: DataFrame, holdout: DataFrame, least: int = 3, draws: int = 0, seed: int = 0) -> DataFrame:
    """(estimate, n_train, n_holdout, rmse, ready, and with draws low and high of a bootstrap of the training side): the hierarchical estimate of the trials (session_id, video_id, value, variance) outside the holdout sessions, scored on
    those within; ready if both sides have `least` trials and at least two training sessions."""
    held = trials.join(holdout.select("session_id").distinct(), "session_id", "left_semi")
    train = trials.join(holdout.select("session_id").distinct(), "session_id", "left_anti")
    e = estimators.hierarchy(train).select("estimate", F.col("n_rows").alias("n_train"), "n_sessions")
    scored = held.crossJoin(F.broadcast(e)).agg(F.count("*").alias("n_holdout"), F.sqrt(F.avg((F.col("value") - F.col("estimate")) * (F.col("value") - F.col("estimate")))).alias("rmse"))
    out = e.crossJoin(scored)
    if draws:
        out = out.crossJoin(estimators.bootstrap(train, n=draws, seed=seed).select("low", "high"))
    return out.withColumn("ready", (F.col("n_train") >= least) & (F.col("n_holdout") >= least) & (F.col("n_sessions") >= 2)).drop("n_sessions")


def lock_labels(labels: DataFrame, columns: list[str], by: str = "video_id") -> DataFrame:
    """(by, n, lock) of each video's labels: a digest of the sums and exclusive ors of its rows' hashes, in whatever order they come, so that a task
    holds three numbers for a video."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns)])
    own = labels.groupBy(by).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    return own.select(by, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("x").cast("string"), F.col("s").cast("string")), 256).alias("lock"))


def broken_locks(labels: DataFrame, locks: DataFrame, columns: list[str], by: str = "video_id") -> DataFrame:
    """(by) of locked videos (by, lock) whose labels are no longer those that were locked, or are gone."""
    now = lock_labels(labels, columns, by).select(by, F.col("lock").alias("now"))
    return locks.join(now, by, "left").where(~F.col("lock").eqNullSafe(F.col("now"))).select(by)


def save_labels(labels: DataFrame, new: DataFrame, locked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, refused): new rows (video_id, frame_index, track_id, radius, ...) replace all of their frame's. Frames of locked videos, ids that repeat in a frame, and radii that
    are not positive are refused, whole frames at a time."""
    frame = ["video_id", "frame_index"]
    twice = new.groupBy(*frame, "track_id").agg(F.count("*").alias("n")).where("n > 1").select(*frame, F.lit("repeated_id").alias("problem"))
    flat = new.where("radius IS NULL OR radius <= 0").select(*frame, F.lit("not_positive").alias("problem"))
    shut = new.join(locked.select("video_id"), "video_id", "left_semi").select(*frame, F.lit("locked").alias("problem"))
    refused = twice.unionByName(flat).unionByName(shut).distinct()
    good = new.join(refused.select(*frame).distinct(), frame, "left_anti")
    kept = labels.join(good.select(*frame).distinct(), frame, "left_anti")
    return kept.unionByName(good, allowMissingColumns=True), refused


def project_status(videos: DataFrame, project: DataFrame) -> DataFrame:
    """(time_state, geometry_state, n_stale, n_review, next_action) of one project row (time_status, geometry_status) and its videos (status, review_frames, stale)."""
    v = videos.agg(F.count("*").alias("n"), F.count_if("stale").alias("n_stale"), F.count_if(F.col("review_frames") > 0).alias("n_review"), F.coalesce(F.bool_and(F.col("status") == "complete"), F.lit(False)).alias("all_done"))
    time = F.when(F.col("time_status").isin("verified", "synthetic_known_clock"), "done").when(F.col("time_status") == "declared", "provisional").otherwise("needed")
    space = F.when(F.col("geometry_status").isin("verified", "synthetic"), "done").otherwise("needed")
    action = (
        F.when(F.col("n_stale") > 0, "analyse_again").when(space != "done", "calibrate").when((F.col("n") > 0) & F.col("all_done") & (F.col("n_review") == 0), "split_and_fit").when(F.col("n_review") > 0, "review_frames").otherwise("analyse")
    )
    return project.crossJoin(v).select(time.alias("time_state"), space.alias("geometry_state"), "n_stale", "n_review", action.alias("next_action"))
