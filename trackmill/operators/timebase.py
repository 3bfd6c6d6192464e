"""From presentation time to physical time, and checks of clocks and cadence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import finite


def map_time(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """frames (video_id, p) and t: through the first segment (video_id, seg_no, p_start, p_end, t_start, slow_factor) with
    p_start <= p <= p_end, an open end allowed; null where none fits or p is not finite. A video's segments are one small
    sorted array, so rows stay one each."""
    item = F.struct("seg_no", "p_start", "p_end", "t_start", "slow_factor")
    own = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("own"))
    p = F.col("p")
    hit = F.get(F.filter("own", lambda s: (s["p_start"] <= p) & (s["p_end"].isNull() | (p <= s["p_end"]))), 0)
    out = frames.join(own, "video_id", "left").withColumn("hit", hit)
    t = F.when(finite(p), F.col("hit.t_start") + (p - F.col("hit.p_start")) / F.col("hit.slow_factor"))
    return out.withColumn("t", t).drop("own", "hit")


def timing(frames: DataFrame) -> DataFrame:
    """frames (video_id, frame_index, p, frame_type, t) with t null, and a time_status, where p does not exceed the frame
    before's (a null one passes) or the frame is not an independent one."""
    before = F.lag("p").over(Window.partitionBy("video_id").orderBy("frame_index"))
    status = (
        F.when(F.col("frame_type").isin("duplicate", "interpolated", "missing"), "not_independent")
        .when(F.col("p") <= before, "not_increasing")
        .when(F.col("t").isNull(), "unmapped")
        .otherwise("mapped")
    )
    out = frames.withColumn("time_status", status)
    return out.withColumn("t", F.when(F.col("time_status") == "mapped", F.col("t")))


def validate_profile(segments: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Violations (video_id, seg_no, reason): a factor that is not positive and finite, an open end before the last segment,
    or a gap in p or in mapped time."""
    order = Window.partitionBy("video_id").orderBy("seg_no")
    end, start, t, slow = (F.lag(c).over(order) for c in ("p_end", "p_start", "t_start", "slow_factor"))
    follows = F.lag("seg_no").over(order).isNotNull()
    mapped = t + (end - start) / slow
    reason = (
        F.when(~(finite(F.col("slow_factor")) & (F.col("slow_factor") > 0)), "bad_factor")
        .when(follows & end.isNull(), "open_before_last")
        .when(follows & (F.abs(F.col("p_start") - end) > tolerance), "presentation_gap")
        .when(follows & (F.abs(F.col("t_start") - mapped) > tolerance), "time_gap")
    )
    return segments.withColumn("reason", reason).where("reason IS NOT NULL").select("video_id", "seg_no", "reason")


def verify_clock(points: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(video_id, n, max_error, rmse, passed) from points (video_id, p, t, reference): mapped against reference time elapsed
    since the first point. At least 3 points, with rising references, are needed to pass."""
    order = Window.partitionBy("video_id").orderBy("p")
    e = (F.col("t") - F.first("t").over(order)) - (F.col("reference") - F.first("reference").over(order))
    falls = F.coalesce(F.col("reference") <= F.lag("reference").over(order), F.lit(False))
    own = points.withColumns({"e": e, "falls": falls})
    out = own.groupBy("video_id").agg(F.count("e").alias("n"), F.max(F.abs("e")).alias("max_error"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.bool_or("falls").alias("falls"))
    return out.withColumn("passed", (F.col("n") >= 3) & ~F.col("falls") & (F.col("max_error") <= tolerance)).drop("falls")


def cadence(frames: DataFrame, fps: float = 240.0) -> DataFrame:
    """(video_id, n, non_positive, gaps, median_dt, consistent) of the steps between non-null times."""
    dt = F.col("t") - F.lag("t").over(Window.partitionBy("video_id").orderBy("frame_index"))
    own = frames.where(F.col("t").isNotNull()).withColumn("dt", dt).where("dt IS NOT NULL")
    out = own.groupBy("video_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("dt") <= 0).alias("non_positive"), F.count_if(F.col("dt") > 1.5 / fps).alias("gaps"),
        F.percentile(F.when(F.col("dt") > 0, F.col("dt")), F.lit(0.5)).alias("median_dt"),
    )
    return out.withColumn("consistent", F.coalesce(F.abs(1 / F.col("median_dt") / fps - 1) < 0.03, F.lit(False)))


def frame_anomalies(frames: DataFrame, positive: bool = True) -> DataFrame:
    """frames (video_id, frame_index, p, content_hash) and duplicate (same hash as the frame before) and missing (a step over
    1.6 times the median of the last 31 positive steps before it; unless `positive`, of all known steps of the last 31 frames)."""
    order = Window.partitionBy("video_id").orderBy("frame_index")
    own = frames.withColumns({"dt": F.col("p") - F.lag("p").over(order), "duplicate": F.coalesce(F.col("content_hash") == F.lag("content_hash").over(order), F.lit(False))})
    if not positive:
        own = own.withColumn("median", F.percentile("dt", F.lit(0.5)).over(order.rowsBetween(-31, -1)))
        return own.withColumn("missing", F.coalesce(F.col("dt") > 1.6 * F.col("median"), F.lit(False))).drop("median", "dt")
    # the number of positive steps so far names each state of the median; steps that are not positive keep the last one
    own = own.withColumn("k", F.sum(F.coalesce((F.col("dt") > 0).cast("int"), F.lit(0))).over(order))
    steps = own.where("dt > 0").select("video_id", "k", "dt")
    recent = Window.partitionBy("video_id").orderBy("k").rowsBetween(-30, 0)
    states = steps.select("video_id", (F.col("k")).alias("state"), F.percentile("dt", F.lit(0.5)).over(recent).alias("median"))
    own = own.withColumn("state", F.lag("k").over(order)).join(states, ["video_id", "state"], "left")
    return own.withColumn("missing", F.coalesce(F.col("dt") > 1.6 * F.col("median"), F.lit(False))).drop("k", "state", "median", "dt")
