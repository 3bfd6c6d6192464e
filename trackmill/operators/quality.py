"""Counts, coverage, issues and summaries of each video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import finite, live, usable


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of rows with equal keys the one with the largest seq, delta's before base's if equal."""
    both = base.withColumn("is_delta", F.lit(0)).unionByName(delta.withColumn("is_delta", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc(seq), F.desc("is_delta"))
    return both.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "is_delta")


def observable_grid(frames: DataFrame, tracks: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(video_id, frame_index, track_id): each frame with each of its video's tracks, where scope (video_id, track_id, start,
    end, observable) lets it be seen; all without scope."""
    grid = frames.select("video_id", "frame_index").join(tracks.select("video_id", "track_id"), "video_id")
    return grid if scope is None else annotate_scope(grid, scope).where("observable").select("video_id", "frame_index", "track_id")


def annotate_scope(rows: DataFrame, segments: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """rows and observable, fit_enabled, scope_reason, scope_segment from the first segment (by start) that contains the
    frame; an open end is allowed, null flags are true. No segment: not observable. After a track's first stop fitting is
    off.

    Segments are grouped into one sorted array for each track and joined by key, so that rows stay one each."""
    seg = F.struct("start", "end", F.coalesce("observable", F.lit(True)).alias("observable"), F.coalesce("fit_enabled", F.lit(True)).alias("fit_enabled"), "reason")
    own = segments.groupBy("video_id", "track_id").agg(F.array_sort(F.collect_list(seg)).alias("own"))
    out = rows.drop("observable", "fit_enabled").join(own, ["video_id", "track_id"], "left")
    frame = F.col("frame_index")
    hit = F.get(F.filter("own", lambda s: (s["start"] <= frame) & (s["end"].isNull() | (s["end"] >= frame))), 0)
    out = out.withColumn("hit", hit)
    after = F.lit(False)
    if stops is not None:
        out = out.join(stops.where("kind = 'stopped'").groupBy("video_id", "track_id").agg(F.min("frame").alias("stop")), ["video_id", "track_id"], "left")
        after = F.coalesce(F.col("stop") < frame, F.lit(False))
    return out.withColumns({
        "observable": F.coalesce(F.col("hit.observable"), F.lit(False)), "fit_enabled": F.coalesce(F.col("hit.fit_enabled"), F.lit(False)) & ~after,
        "scope_reason": F.col("hit.reason"), "scope_segment": F.col("hit.start"),
    }).drop("own", "hit", "stop")


def validate_segments(segments: DataFrame) -> DataFrame:
    """Violations (video_id, track_id, start, reason): out of order or overlapping, or outside the video (columns
    video_start, video_end)."""
    order = Window.partitionBy("video_id", "track_id").orderBy("start", "end")
    before = F.lag("end").over(order)
    first = F.row_number().over(order) == 1
    reason = (
        F.when(F.col("end") < F.col("start"), "reversed")
        .when(~first & (before.isNull() | (before >= F.col("start"))), "overlap")
        .when((F.col("start") < F.col("video_start")) | (F.coalesce("end", "video_end") > F.col("video_end")), "outside_video")
    )
    return segments.withColumn("reason", reason).where("reason IS NOT NULL").select("video_id", "track_id", "start", "reason")


def coverage(obs: DataFrame, grid: DataFrame) -> DataFrame:
    """(video_id, expected, observed, coverage): only observable track-frames are expected."""
    seen = obs.where(live()).select("video_id", "frame_index", "track_id").distinct()
    n = grid.groupBy("video_id").agg(F.count("*").alias("expected"))
    k = seen.groupBy("video_id").agg(F.count("*").alias("observed"))
    return n.join(k, "video_id", "left").fillna(0, ["observed"]).withColumn("coverage", F.try_divide("observed", "expected"))


def run_quality(obs: DataFrame) -> DataFrame:
    """Counts of each video in one pass."""
    s = F.col("status")
    return obs.groupBy("video_id").agg(
        F.count_distinct("frame_index").alias("frames"), F.count_distinct("track_id").alias("tracks"), F.count("*").alias("rows"),
        F.count_if(live()).alias("live_rows"), F.count_if(usable()).alias("usable_rows"), F.count_if(s == "low_confidence").alias("low_confidence"),
        F.count_if(F.col("source") == "manual_corrected").alias("manual_rows"), F.count_if(F.col("measurement_warning") == "blurred_edge_review").alias("blur_rows"),
        F.count_if(F.col("surface_status") == "floor_boundary").alias("floor_rows"), F.count_if(F.col("frame_index") < 30).alias("first_30"),
    )


def issues(obs: DataFrame, cap: int | None = 10_000) -> DataFrame:
    """(video_id, frame_index, track_id, reason, truncated): what a person should look at, in frame order, the first `cap` of
    each video; truncated where there were more."""
    s = F.col("status")
    found = F.array_compact(F.array(
        F.when((F.col("identity_status") == "ambiguous") | F.col("assignment_ambiguous"), "ambiguous_identity"),
        F.when(s == "low_confidence", "low_contour"),
        F.when(live() & ~finite(F.col("theta")), "missing_orientation"),
        F.when(F.col("measurement_warning").isNotNull(), F.col("measurement_warning")),
        F.when(F.col("surface_status") == "floor_boundary", "floor_boundary"),
    ))
    out = obs.select("video_id", "frame_index", "track_id", F.explode(found).alias("reason"))
    if cap is None:
        return out.withColumn("truncated", F.lit(False))
    of = Window.partitionBy("video_id")
    out = out.withColumns({"place": F.row_number().over(of.orderBy("frame_index", "track_id", "reason")), "n": F.count("*").over(of)})
    return out.where(F.col("place") <= cap).withColumn("truncated", F.col("n") > cap).drop("place", "n")


def run_report(obs: DataFrame, trajectories: DataFrame, events: DataFrame) -> DataFrame:
    """The counts of run_quality and, for each video, expected_track_frames (frames times tracks), observed_fraction, rows of trajectories
    (vx, omega, uses_warned) with a velocity, with a turning rate and from warned observations, and events (fit_eligible; n: for how many a row stands, one
    without it)."""
    q = run_quality(obs).withColumn("expected_track_frames", F.col("frames") * F.col("tracks"))
    q = q.withColumn("observed_fraction", F.coalesce(F.try_divide("rows", "expected_track_frames"), F.lit(0.0)))
    t = trajectories.groupBy("video_id").agg(F.count("vx").alias("velocity_rows"), F.count("omega").alias("angular_rows"), F.count_if(F.coalesce("uses_warned", F.lit(False))).alias("warned_calculation_rows"))
    n = F.col("n") if "n" in events.columns else F.lit(1)
    e = events.groupBy("video_id").agg(F.sum(n).alias("event_candidates"), F.sum(F.when(F.col("fit_eligible"), n)).alias("eligible_events"))
    out = q.join(t, "video_id", "left").join(e, "video_id", "left")
    return out.fillna(0, ["velocity_rows", "angular_rows", "warned_calculation_rows", "event_candidates", "eligible_events"])


def frame_issues(obs: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, frame_index, track_id, reason) of whole frames (video_id, frame_index, expected, participants, chip_count_proposal,
    missing_frame_suspected, drift_suspected), track_id null: fewer rows seen than expected, more objects proposed than take part, an
    irregular step of time, a camera that moved; and rows of tracks that are unknown."""
    seen = obs.where(live() & ~F.coalesce(F.col("status") == "outside_interval", F.lit(False))).groupBy("video_id", "frame_index").agg(F.count("*").alias("seen"))
    own = frames.join(seen, ["video_id", "frame_index"], "left").fillna(0, ["seen"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    found = F.array_compact(F.array(
        F.when(yes(F.col("seen") < F.col("expected")), "observed_below_expected"),
        F.when(yes((F.col("expected") > 0) & (F.col("chip_count_proposal") > F.col("participants"))), "more_proposed_than_participants"),
        F.when(yes(F.col("missing_frame_suspected")), "irregular_time_gap"), F.when(yes(F.col("drift_suspected")), "camera_drift"),
    ))
    whole = own.select("video_id", "frame_index", F.lit(None).cast(obs.schema["track_id"].dataType).alias("track_id"), F.explode(found).alias("reason"))
    unknown = obs.where(F.col("track_id").cast("string").startswith("unknown")).select("video_id", "frame_index", "track_id", F.lit("unknown_track").alias("reason"))
    return whole.unionByName(unknown)


def residual_median(obs: DataFrame, value: str, last: int = 4096, parts: int = 64) -> DataFrame:
    """Median of the last `last` non-null values of each video, in frame and track order. The last ones of each of so many hashed parts of a video are found first, and of
    those the video's, so that no task sorts a whole video: parts x last rows at most."""
    order = [F.desc("frame_index"), F.desc("track_id")]
    own = obs.where(F.col(value).isNotNull()).select("video_id", "frame_index", "track_id", value)
    own = own.withColumn("part", F.pmod(F.xxhash64("frame_index", "track_id"), F.lit(parts)))
    for keys in (["video_id", "part"], ["video_id"]):
        own = own.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= last)
    return own.groupBy("video_id").agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count("*").alias("n"))


def max_speed(obs: DataFrame) -> DataFrame:
    """(video_id, max_speed) between consecutive rows of a track with rising time, neither ambiguous, and no
    outside_interval row between them."""
    order = Window.partitionBy("video_id", "track_id").orderBy("frame_index")
    own = obs.withColumn("part", F.sum((F.col("status") == "outside_interval").cast("int")).over(order)).where(live())
    line = Window.partitionBy("video_id", "track_id", "part").orderBy("frame_index")
    sure = ~F.coalesce(F.col("assignment_ambiguous"), F.lit(False))
    was = F.lag(F.struct("x", "y", "t_s", sure.alias("sure"))).over(line)
    own = own.withColumns({"was": was, "sure": sure})
    dt = F.col("t_s") - F.col("was.t_s")
    dx, dy = F.col("x") - F.col("was.x"), F.col("y") - F.col("was.y")
    ok = (dt > 0) & F.col("sure") & F.col("was.sure")
    return own.groupBy("video_id").agg(F.max(F.when(ok, F.sqrt(dx * dx + dy * dy) / dt)).alias("max_speed"))


def warning_audit(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, used, warned, fraction, uses_warned) over distinct (track, frame) references: a reference is warned if any of
    its rows has a warning."""
    refs = rows.groupBy(*group, "track_id", "frame_index").agg(F.max(F.size("row_warnings") > 0).alias("warned"))
    out = refs.groupBy(*group).agg(F.count("*").alias("used"), F.count_if("warned").alias("warned"))
    return out.withColumns({"fraction": F.coalesce(F.try_divide("warned", "used"), F.lit(0.0)), "uses_warned": F.col("warned") > 0})


def vote_count(samples: DataFrame) -> DataFrame:
    """(video_id, answer, support, stable) from rows (video_id, count): the largest count seen in max(2, 10 %) of the samples,
    else the largest seen."""
    n = samples.groupBy("video_id", "count").agg(F.count("*").alias("k"))
    n = n.withColumn("total", F.sum("k").over(Window.partitionBy("video_id")))
    supported = (F.col("count") > 0) & (F.col("k") >= F.greatest(F.lit(2), F.ceil(F.col("total") * 0.1)))
    best = n.groupBy("video_id").agg(F.max(F.when(supported, F.col("count"))).alias("s"), F.max("count").alias("m"), F.max("total").alias("total"))
    best = best.select("video_id", F.coalesce("s", "m").alias("answer"), "total")
    own = n.select("video_id", F.col("count").alias("answer"), "k")
    out = best.join(own, ["video_id", "answer"]).withColumn("support", F.col("k") / F.col("total"))
    return out.select("video_id", "answer", "support", (F.col("support") >= 0.75).alias("stable"))


def suppress(dets: DataFrame, k: float, keys: list[str], of_smaller: bool = False) -> DataFrame:
    """Detections of each group that stay after greedy suppression: by residual (then id), one is dropped if it is nearer than
    k (r1 + r2), or with of_smaller (for proposals, k = 0.8) k times the smaller radius, to one that stays. A fold over the group's sorted detections."""
    item = F.struct("residual", "det_id", "x", "y", "radius")
    own = dets.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("own"))
    none = F.slice("own", 1, 0)

    def close(a, b):  # noqa: ANN001, ANN202
        dx, dy = a["x"] - b["x"], a["y"] - b["y"]
        reach = F.least(a["radius"], b["radius"]) if of_smaller else a["radius"] + b["radius"]
        return F.sqrt(dx * dx + dy * dy) < k * reach

    kept = F.aggregate("own", none, lambda out, d: F.when(F.exists(out, lambda o: close(o, d)), out).otherwise(F.concat(out, F.array(d))))
    return own.select(*keys, F.explode(kept).alias("d")).select(*keys, "d.*")


def rank_detections(dets: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """The best `cap` detections of a group: confirmed first, then longer arcs, then smaller residuals."""
    order = Window.partitionBy(*keys).orderBy(F.desc("confirmed"), F.desc("arc"), "residual", "det_id")
    return dets.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def guard(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Keys with more than `most` rows, as violations."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)


def scan(rows: DataFrame, track: object = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of a track in a range of frames, ends included. The conditions reach the Parquet scan."""
    if track is not None:
        rows = rows.where(F.col("track_id") == track)
    if start is not None:
        rows = rows.where(F.col("frame_index") >= start)
    if end is not None:
        rows = rows.where(F.col("frame_index") <= end)
    return rows
