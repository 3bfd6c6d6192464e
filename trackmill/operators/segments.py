"""Runs of contiguous frames, chunks of them, barriers, and angles carried along them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACK = ("video_id", "track_id")


def islands(rows: DataFrame, scope: str | None = None, barriers: DataFrame | None = None) -> DataFrame:
    """rows and segment: a new one where the frame is not the previous one's plus 1, where the scope changes, or where a
    barrier (rows video_id, track_id, start, end) starts in (previous, current]. Rows within a barrier are left out.

    Barriers are looked up as of each row: both are merged into one timeline for each track, so that no row is paired
    with every barrier."""
    order = Window.partitionBy(*TRACK).orderBy("frame_index")
    cut = F.lit(False)
    if barriers is not None:
        marks = barriers.select(*TRACK, F.col("start").cast("double").alias("at"), F.lit(0).alias("is_row"), F.col("end").cast("double").alias("closes"))
        own = rows.withColumns({"at": F.col("frame_index").cast("double"), "is_row": F.lit(1)})
        line = Window.partitionBy(*TRACK).orderBy("at", "is_row")
        both = own.unionByName(marks, allowMissingColumns=True)
        both = both.withColumns({"opened": F.max(F.when(F.col("is_row") == 0, F.col("at"))).over(line), "closed": F.max("closes").over(line)})
        rows = both.where((F.col("is_row") == 1) & ~F.coalesce(F.col("closed") >= F.col("at"), F.lit(False))).drop("at", "is_row", "closes", "closed")
        cut = F.coalesce(F.col("opened") > F.lag("frame_index").over(order), F.lit(False))
    new = F.coalesce(F.col("frame_index") != F.lag("frame_index").over(order) + 1, F.lit(True)) | cut
    if scope:
        new = new | ~F.col(scope).eqNullSafe(F.lag(scope).over(order))
    out = rows.withColumn("is_new", new.cast("int"))
    out = out.withColumn("segment", F.sum("is_new").over(order)).drop("is_new")
    return out.drop("opened") if barriers is not None else out


def chunks(rows: DataFrame, duration: float, min_rows: int) -> DataFrame:
    """rows of segments cut into chunks of a fixed duration, anchored at each chunk's actual first time: (video_id,
    track_id, segment, chunk, frame_from, frame_to, n, skipped).

    Greedy, so it is a fold over the segment's ordered times, inside the JVM, which keeps only where chunks begin. A chunk
    with under min_rows rows is reported as skipped."""
    seg = rows.groupBy(*TRACK, "segment").agg(F.array_sort(F.collect_list(F.struct("frame_index", "t_s"))).alias("own"))
    none = F.array().cast("array<struct<at:int,frame:bigint,before:bigint>>")
    start = F.struct(F.lit(None).cast("double").alias("since"), F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("last"), none.alias("starts"))

    def walk(s: Column, r: Column) -> Column:
        new = s["since"].isNull() | (r["t_s"] - s["since"] >= duration - 1e-10)
        here = F.array(F.struct(s["n"].alias("at"), r["frame_index"].cast("bigint").alias("frame"), s["last"].alias("before")))
        return F.struct(
            F.when(new, r["t_s"]).otherwise(s["since"]).alias("since"), (s["n"] + 1).alias("n"), r["frame_index"].cast("bigint").alias("last"),
            F.when(new, F.concat(s["starts"], here)).otherwise(s["starts"]).alias("starts"),
        )

    seg = seg.withColumn("s", F.aggregate("own", start, walk)).select(*TRACK, "segment", "s")
    each = seg.select(*TRACK, "segment", "s", F.posexplode("s.starts").alias("i", "c"))
    after = F.get("s.starts", F.col("i") + 1)
    out = each.select(
        *TRACK, "segment", (F.col("i") + 1).cast("long").alias("chunk"), F.col("c.frame").alias("frame_from"), F.coalesce(after["before"], F.col("s.last")).alias("frame_to"),
        (F.coalesce(after["at"], F.col("s.n")) - F.col("c.at")).cast("long").alias("n"),
    )
    return out.withColumn("skipped", F.col("n") < min_rows)


def event_barriers(events: DataFrame) -> DataFrame:
    """(video_id, track_id, start, end): the open interval between the last frame before and the first after a contact or
    boundary, else the candidate range; unusable intervals inclusive. Events that are no contact give none, excluded
    ones do."""
    given = events.where(~F.coalesce(F.col("kind") == "noncontact_pass", F.lit(False)))
    bound = F.coalesce("contact", "boundary")
    cut = F.when(bound.isNotNull() & (bound["from"] < bound["to"]), F.struct((bound["from"] + 0.5).alias("start"), (bound["to"] - 0.5).alias("end")))
    whole = F.struct(F.greatest(F.col("frame_start"), F.lit(0)).cast("double").alias("start"), F.col("frame_end").cast("double").alias("end"))
    dead = F.transform(F.coalesce("unusable", F.array().cast("array<struct<from:bigint,to:bigint>>")), lambda u: F.struct(F.greatest(u["from"], F.lit(0)).cast("double").alias("start"), u["to"].cast("double").alias("end")))
    kind = "array<struct<start:double,end:double>>"
    every = given.select("video_id", F.explode("pair").alias("track_id"), F.explode(F.concat(dead.cast(kind), F.array(F.coalesce(cut, whole)).cast(kind))).alias("b"))
    return every.select(*TRACK, "b.start", "b.end").distinct()


def gauge(rows: DataFrame, angle: str = "theta_unwrapped", wrapped: str = "theta") -> DataFrame:
    """rows with `angle` on one branch along each run of contiguous frames of a segment: whole turns are added so that it
    follows the wrapped angle's steps. Every run begins with none."""
    order = Window.partitionBy(*TRACK).orderBy("frame_index")
    goes_on = F.coalesce((F.lag("frame_index").over(order) + 1 == F.col("frame_index")) & (F.lag("segment").over(order) == F.col("segment")), F.lit(False))
    step = F.col(wrapped) - F.lag(wrapped).over(order)
    step = step - 2 * math.pi * F.floor((step + math.pi) / (2 * math.pi))
    turns = F.rint((F.lag(angle).over(order) + step - F.col(angle)) / (2 * math.pi))
    out = rows.withColumns({"run": (~goes_on).cast("int"), "turn": F.when(goes_on, turns).otherwise(0.0)})
    out = out.withColumn("run", F.sum("run").over(order))
    total = F.sum("turn").over(Window.partitionBy(*TRACK, "run").orderBy("frame_index"))
    return out.withColumn(angle, F.col(angle) + 2 * math.pi * total).drop("run", "turn")


def spans(rows: DataFrame, keys: list[str], frame: str = "frame_index") -> DataFrame:
    """(keys, frame_from, frame_to, n): consecutive frames with equal keys as one span; repeated rows count once."""
    own = rows.select(*keys, frame).distinct()
    own = own.withColumn("island", F.col(frame) - F.row_number().over(Window.partitionBy(*keys).orderBy(frame)))
    return own.groupBy(*keys, "island").agg(F.min(frame).alias("frame_from"), F.max(frame).alias("frame_to"), F.count("*").alias("n")).drop("island")


def moving(least: float = 0.08) -> Column:
    """Whether a row's speed (vx, vy) is over `least`; false where it is not known. For the longest run, before segments are cut."""
    return F.coalesce(F.hypot("vx", "vy") > least, F.lit(False))


def longest_run(rows: DataFrame, cap: int = 55, min_rows: int = 24) -> DataFrame:
    """The rows of each track's longest segment (the first of equals), its first `cap`, if it has min_rows."""
    sizes = rows.groupBy(*TRACK, "segment").agg(F.count("*").alias("n"))
    best = sizes.groupBy(*TRACK).agg(F.max(F.struct("n", (-F.col("segment")).alias("s"))).alias("b"))
    best = best.where(F.col("b.n") >= min_rows).select(*TRACK, (-F.col("b.s")).alias("segment"))
    place = F.row_number().over(Window.partitionBy(*TRACK, "segment").orderBy("frame_index"))
    return rows.join(best, [*TRACK, "segment"]).withColumn("place", place).where(F.col("place") <= cap)


def prefix_state(rows: DataFrame, n: int = 12) -> DataFrame:
    """(video_id, track_id, segment, x0, vx, y0, vy): straight lines through a segment's first n rows, at the n-th time."""
    place = F.row_number().over(Window.partitionBy(*TRACK, "segment").orderBy("frame_index"))
    own = rows.withColumn("place", place).where(F.col("place") <= n)
    own = own.groupBy(*TRACK, "segment").agg(
        F.count("*").alias("n"), F.max("t_s").alias("t0"), F.regr_slope("x", "t_s").alias("vx"), F.regr_slope("y", "t_s").alias("vy"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("t_s").alias("mt")
    )
    at = lambda m, v: F.col(m) + F.col(v) * (F.col("t0") - F.col("mt"))
    return own.where(F.col("n") == n).select(*TRACK, "segment", at("mx", "vx").alias("x0"), "vx", at("my", "vy").alias("y0"), "vy")


def decimate(rows: DataFrame, points: int, scope: str | None = None) -> DataFrame:
    """About `points` rows of each track, and breaks: true where the frame jumps by more than the stride, or the column `scope` changes."""
    of = Window.partitionBy(*TRACK)
    stride = F.greatest(F.lit(1), F.floor(F.count("*").over(of) / points)).cast("long")
    out = rows.withColumns({"stride": stride, "place": F.row_number().over(of.orderBy("frame_index")) - 1})
    out = out.where(F.col("place") % F.col("stride") == 0)
    line = of.orderBy("frame_index")
    jump = F.col("frame_index") - F.lag("frame_index").over(line) > F.col("stride")
    if scope:
        jump = F.coalesce(jump, F.lit(False)) | (F.lag("frame_index").over(line).isNotNull() & ~F.col(scope).eqNullSafe(F.lag(scope).over(line)))
    return out.withColumn("breaks", F.coalesce(jump, F.lit(False))).drop("place")


def sample_frames(frames: DataFrame, n: int = 24, key: str = "video_id") -> DataFrame:
    """n evenly spaced rows of each video by frame, all if it has fewer."""
    of = Window.partitionBy(key)
    own = frames.withColumns({"place": F.row_number().over(of.orderBy("frame_index")) - 1, "size": F.count("*").over(of)})
    near = F.floor(F.col("place") * n / F.col("size")) != F.floor((F.col("place") - 1) * n / F.col("size"))
    return own.where((F.col("size") <= n) | (F.col("place") == 0) | near).drop("place", "size")


def weak_signal(rows: DataFrame, speed: float = 0.015, omega: float = 1.0) -> Column:
    """An aggregate: the whole segment is slow and hardly turns."""
    return (F.max(F.coalesce("speed", F.lit(0.0))) <= speed) & (F.max(F.abs(F.coalesce("omega", F.lit(0.0)))) <= omega)
