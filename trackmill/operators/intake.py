"""Proposals made before a run: how many objects, how large, from when; and change points of events."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import usable
from .pairs import rows_in_ranges
from .quality import vote_count


def size_cluster(dets: DataFrame) -> DataFrame:
    """dets (video_id, sample, radius) within 0.72 to 1.38 times the seed: the radius whose band has detections in the most samples, the
    smallest of equals.

    Radii and seeds are whole thousandths, and a detection is in the bands of an interval of seeds. Each sample's intervals are merged, their ends summed by place, and a running
    sum over a video's places tells how many samples each seed's band has: seeds and detections never meet. What one task sorts is
    bounded by a video's different sizes, at most three places for each."""
    own = dets.select("video_id", "sample", F.round("radius", 3).alias("r")).distinct()
    first = lambda at, fits: F.filter(F.transform(F.array(*[F.lit(i) for i in (-2, -1, 0, 1, 2)]), lambda i: at + i), fits)
    low = F.array_min(first(F.floor(F.col("r") * 1000 / 1.38), lambda s: F.col("r") < 1.38 * (s / 1000.0)))
    high = F.array_max(first(F.ceil(F.col("r") * 1000 / 0.72), lambda s: F.col("r") > 0.72 * (s / 1000.0)))
    own = own.select("video_id", "sample", "r", low.alias("low"), high.alias("high"))
    line = Window.partitionBy("video_id", "sample").orderBy("low", "high")
    before = F.max("high").over(line.rowsBetween(Window.unboundedPreceding, -1))
    part = own.where("low <= high").withColumn("part", F.coalesce(F.col("low") > before + 1, F.lit(True)).cast("int"))
    part = part.withColumn("part", F.sum("part").over(line)).groupBy("video_id", "sample", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = part.select("video_id", F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(1).alias("change")), F.struct((F.col("high") + 1).alias("at"), F.lit(-1).alias("change")))).alias("e")).select("video_id", "e.*")
    ends = ends.groupBy("video_id", "at").agg(F.sum("change").alias("change"), F.lit(False).alias("is_seed"))
    seeds = own.select("video_id", F.rint(F.col("r") * 1000).cast("long").alias("at"), F.lit(0).cast("long").alias("change"), F.lit(True).alias("is_seed")).distinct()
    swept = ends.unionByName(seeds).withColumn("n", F.sum("change").over(Window.partitionBy("video_id").orderBy("at", "is_seed")))
    best = swept.where("is_seed").groupBy("video_id").agg(F.max(F.struct("n", (-F.col("at")).alias("s"))).alias("b")).select("video_id", (-F.col("b.s") / 1000.0).alias("seed"))
    out = dets.join(best, "video_id")
    return out.where((F.col("radius") > 0.72 * F.col("seed")) & (F.col("radius") < 1.38 * F.col("seed")))


def radius_range(dets: DataFrame, answers: DataFrame) -> DataFrame:
    """(video_id, low, high) from the samples whose count is the answer: a tenth and nine tenths of the radii, widened; low is 5 at least."""
    n = dets.groupBy("video_id", "sample").agg(F.count("*").alias("answer"))
    own = dets.join(n.join(answers.select("video_id", "answer"), ["video_id", "answer"]), ["video_id", "sample"])
    q = own.groupBy("video_id").agg(F.percentile("radius", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return q.select("video_id", F.greatest(F.lit(5.0), F.col("q")[0] * 0.78).alias("low"), (F.col("q")[1] * 1.25).alias("high"))


def vote_with_retry(few: DataFrame, many: DataFrame) -> DataFrame:
    """The vote of the small sample where it is above 0, else of the dense one."""
    a, b = vote_count(few), vote_count(many)
    b = b.select("video_id", *[F.col(c).alias(f"m_{c}") for c in ("answer", "support", "stable")])
    first = F.coalesce(F.col("answer") > 0, F.lit(False))
    out = a.join(b, "video_id", "full_outer")
    return out.select("video_id", *[F.when(first, F.col(c)).otherwise(F.col(f"m_{c}")).alias(c) for c in ("answer", "support", "stable")], (~first).alias("retried"))


def consensus(cands: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """(video_id, cand_id, members): of candidate vectors (video_id, cand_id, orientation, v0..v3) the largest group that is within 3 % of one of
    its own and of equal orientation (two at least), and of it the one nearest the group's medians. Equal vectors are one, with
    their number. A vector meets those in the cells about its own, of a grid that is as coarse as its length allows: vectors that are far apart never meet. Tolerances of up to a third."""
    names = [f"v{i}" for i in range(4)]
    norm = lambda s: F.greatest(F.sqrt(sum((F.col(f"{s}{n}") * F.col(f"{s}{n}") for n in names), F.lit(0.0))), F.lit(1e-9))
    apart = F.sqrt(sum(((F.col(f"a_{n}") - F.col(f"b_{n}")) * (F.col(f"a_{n}") - F.col(f"b_{n}")) for n in names), F.lit(0.0)))
    kinds = cands.groupBy("video_id", "orientation", *names).agg(F.min("cand_id").alias("cand_id"), F.count("*").alias("k"))
    kinds = kinds.withColumn("level", F.floor(F.log2(norm(""))).cast("int"))
    side = lambda df, s: df.select("video_id", "orientation", "level", "cell", *[F.col(c).alias(f"{s}_{c}") for c in ("cand_id", "k", *names)])
    # a level's cells are as wide as its vectors' tolerance at most: what is near lies in a cell beside, of the vector's own level
    place = lambda n, level: F.floor(F.col(n) / (tolerance * F.pow(F.lit(2.0), level + 1))).cast("long")
    lies = kinds.withColumn("level", F.explode(F.array(*[F.col("level") + i for i in (-1, 0, 1)])))
    lies = lies.withColumn("cell", F.array(*[place(n, F.col("level")) for n in names]))
    steps = [F.lit(list(x)) for x in itertools.product((-1, 0, 1), repeat=len(names))]
    asks = kinds.withColumn("own", F.array(*[place(n, F.col("level")) for n in names])).withColumn("step", F.explode(F.array(*steps)))
    asks = asks.withColumn("cell", F.zip_with("own", "step", lambda x, y: x + y))
    pairs = side(asks, "a").join(side(lies, "b"), ["video_id", "orientation", "level", "cell"]).where(apart / norm("a_") < tolerance)
    sizes = pairs.groupBy("video_id", "a_cand_id").agg(F.sum("b_k").alias("n"))
    best = sizes.groupBy("video_id").agg(F.max(F.struct("n", (-F.col("a_cand_id")).alias("c"))).alias("b")).where("b.n >= 2")
    group = pairs.join(best.select("video_id", (-F.col("b.c")).alias("a_cand_id")), ["video_id", "a_cand_id"])
    med = group.groupBy("video_id").agg(*[F.percentile(f"b_{n}", F.lit(0.5), F.col("b_k")).alias(f"m_{n}") for n in names], F.sum("b_k").alias("members"))
    far = F.sqrt(sum(((F.col(f"b_{n}") - F.col(f"m_{n}")) * (F.col(f"b_{n}") - F.col(f"m_{n}")) for n in names), F.lit(0.0)))
    out = group.join(med, "video_id").withColumn("far", far)
    return out.groupBy("video_id", "members").agg(F.min_by("b_cand_id", F.struct("far", "b_cand_id")).alias("cand_id"))


def lattice_pitch(offsets: DataFrame, keys: list[str], pitch: float) -> DataFrame:
    """(keys, pitch, intervals, relative_error, status) of line offsets: sorted ones closer than 12 % of the pitch to the running mean of a cluster join
    it; six clusters and five gaps of 0.6 to 1.4 pitches are needed; rejected if the median deviation is over 7 %; scale_mismatch over 8 %.
    A fold over each group's sorted offsets."""
    own = offsets.groupBy(*keys).agg(F.array_sort(F.collect_list("offset")).alias("own"))
    start = F.struct(F.array().cast("array<double>").alias("means"), F.lit(None).cast("double").alias("sum"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        joins = F.coalesce(F.abs(x - s["sum"] / F.greatest(s["n"], F.lit(1))) < 0.12 * pitch, F.lit(False))
        ended = F.when(s["n"] > 0, F.concat(s["means"], F.array(s["sum"] / F.greatest(s["n"], F.lit(1))))).otherwise(s["means"])
        return F.when(joins, F.struct(s["means"].alias("means"), (s["sum"] + x).alias("sum"), (s["n"] + 1).alias("n"))).otherwise(F.struct(ended.alias("means"), x.alias("sum"), F.lit(1).alias("n")))

    means = F.aggregate("own", start, step, lambda s: F.concat(s["means"], F.array(s["sum"] / F.greatest(s["n"], F.lit(1)))))
    own = own.withColumn("means", means).where(F.size("means") >= 6)
    gaps = own.select(*keys, F.posexplode("means").alias("i", "m"))
    gaps = gaps.withColumn("gap", F.col("m") - F.lag("m").over(Window.partitionBy(*keys).orderBy("i"))).where((F.col("gap") > 0.6 * pitch) & (F.col("gap") < 1.4 * pitch))
    med = gaps.groupBy(*keys).agg(F.percentile("gap", F.lit(0.5)).alias("pitch"), F.count("*").alias("intervals")).where("intervals >= 5")
    mad = gaps.join(med, keys).groupBy(*keys, "pitch", "intervals").agg(F.percentile(F.abs(F.col("gap") - F.col("pitch")), F.lit(0.5)).alias("mad"))
    error = F.abs(F.col("pitch") / pitch - 1)
    return mad.where(F.col("mad") / F.col("pitch") <= 0.07).select(*keys, "pitch", "intervals", error.alias("relative_error"), F.when(error <= 0.08, "consistent").otherwise("scale_mismatch").alias("status"))


def motion_onset(dets: DataFrame, totals: DataFrame, stride: int = 4, fps: float = 240.0) -> DataFrame:
    """(video_id, start, end, confidence) of tracks (video_id, track, frame, x, y, radius, coverage, residual) and videos (video_id, total).

    A step moves if it is over 1.2 radii a second and 0.035 radii and no longer than two strides; a track of five rows sets off at the row before three
    moving steps in a row. The video starts with the first, and ends a stride after the last row of any that set off. Confidence is
    medium; low if the speed still rises, or the outline is good in under 80 % of the rows after the start. Without a mover: the whole
    video, low."""
    order = Window.partitionBy("video_id", "track").orderBy("frame")
    of = Window.partitionBy("video_id", "track")
    own = dets.withColumns({"n": F.count("*").over(of), "size": F.greatest(F.percentile("radius", F.lit(0.5)).over(of), F.lit(1.0))}).where("n >= 5")
    gap = F.lead("frame").over(order) - F.col("frame")
    dx, dy = F.lead("x").over(order) - F.col("x"), F.lead("y").over(order) - F.col("y")
    own = own.withColumns({"step": F.sqrt(dx * dx + dy * dy) / F.col("size"), "gap": gap})
    own = own.withColumn("speed", F.col("step") / F.greatest(F.col("gap") / fps, F.lit(1e-9)))
    own = own.withColumn("moving", F.coalesce((F.col("speed") > 1.2) & (F.col("step") > 0.035) & (F.col("gap") <= 2 * stride), F.lit(False)))
    sets_off = F.col("moving") & F.coalesce(F.lead("moving", 1).over(order), F.lit(False)) & F.coalesce(F.lead("moving", 2).over(order), F.lit(False))
    w = max(3, -(-int(0.05 * fps) // stride))
    ahead = order.rowsBetween(0, w - 1)
    good = ((F.col("coverage") >= 0.85) & (F.col("residual") / F.col("radius") < 0.04)).cast("double")
    own = own.withColumns({"off": sets_off, "good": F.avg(good).over(ahead), "speeds": F.filter(F.collect_list("speed").over(ahead), lambda s: s.isNotNull()), "last": F.max("frame").over(of)})
    first = own.where("off").groupBy("video_id", "track").agg(F.min_by(F.struct("frame", "good", "speeds", "last"), "frame").alias("f"))
    s = F.col("f.speeds")
    rising = (F.size(s) > 2) & (F.try_element_at(s, F.lit(-1)) > F.try_element_at(s, F.lit(1)) * 1.5 + 1)
    first = first.select("video_id", "track", "f.frame", "f.last", (F.col("f.good") < 0.8).alias("poor"), F.coalesce(rising, F.lit(False)).alias("rising"))
    video = first.groupBy("video_id").agg(F.min_by(F.struct("frame", "poor", "rising"), F.struct("frame", "track")).alias("l"), F.max("last").alias("last"))
    out = totals.join(video, "video_id", "left")
    start = F.coalesce(F.greatest(F.col("l.frame"), F.lit(0)), F.lit(0))
    end = F.coalesce(F.least(F.col("total") - 1, F.col("last") + stride), F.col("total") - 1)
    low = F.col("l").isNull() | F.col("l.poor") | F.col("l.rising")
    return out.select("video_id", start.cast("long").alias("start"), F.greatest(start, end).cast("long").alias("end"), F.when(low, "low").otherwise("medium").alias("confidence"))


def refine_onset(rows: DataFrame) -> DataFrame:
    """(video_id, start) of fine rows (video_id, frame, good, x, y, radius): the first good one whose next ten hold eight good, which get on by 0.2
    radii, at least 0.85 straight."""
    order = Window.partitionBy("video_id").orderBy("frame").rowsBetween(0, 9)
    own = rows.withColumns({"w": F.collect_list(F.struct("good", "x", "y")).over(order)})
    own = own.withColumn("g", F.filter("w", lambda r: r["good"])).where((F.size("w") == 10) & (F.size("g") >= 8) & F.col("good"))
    pairs = F.zip_with(F.slice("g", F.lit(2), F.size("g")), F.slice("g", F.lit(1), F.size("g") - 1), lambda b, a: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
    path = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    a, b = F.element_at("g", 1), F.element_at("g", -1)
    net = F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    ok = own.where((net >= 0.2 * F.col("radius")) & (net / F.greatest(path, F.lit(1e-9)) >= 0.85))
    return ok.groupBy("video_id").agg(F.min("frame").alias("start"))


FRACTIONS = (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0)
#: Frames that are tried at once.
TRIES = 2_000


def _bends(rows: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
    """For events (rows: arrays of structs first, frame_index, t_s, x, y) the bracket of change_points, or null."""
    events, lists = len(rows), rows.value_lengths().to_numpy(zero_copy_only=False)
    flat, event = rows.flatten(), np.repeat(np.arange(events), lists)
    col = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
    frame, side, values = col("frame_index"), (~col("first")).astype(np.int64), [col(c) for c in ("t_s", "x", "y")]
    start, end = start.to_numpy(zero_copy_only=False), end.to_numpy(zero_copy_only=False)
    low = min(frame.min(initial=0), start.min(initial=0) - 8)
    size = max(frame.max(initial=0), end.max(initial=0) + 8) - low + 1
    key = (event * 2 + side) * size + (frame - low)
    order = np.argsort(key, kind="stable")
    key, values = key[order], [v[order] for v in values]
    # a frame is tried if both tracks have it, so their rows tell the frames of a long event
    own = np.flatnonzero((side == 0) & (frame >= start[event]) & (frame < end[event]))
    at_event, at_frame = event[own], frame[own]
    again = np.lexsort((at_frame, at_event))
    at_event, at_frame = at_event[again], at_frame[again]
    cost = np.full(len(own), np.nan)
    with np.errstate(all="ignore"):
        for b in range(0, len(own), TRIES):
            cost[b : b + TRIES] = _costs(key, values, at_event[b : b + TRIES], at_frame[b : b + TRIES] - low, size)
    there = np.flatnonzero(~np.isnan(cost))
    at_event, at_frame, cost = at_event[there], at_frame[there], cost[there]
    best = np.full(events, np.inf)
    np.minimum.at(best, at_event, cost)
    near = np.flatnonzero(np.where(best[at_event] < 1e-18, cost == best[at_event], cost <= best[at_event] * 1.05 + 1e-10))
    lowest, highest = np.full(events, np.iinfo(np.int64).max), np.full(events, np.iinfo(np.int64).min)
    np.minimum.at(lowest, at_event[near], at_frame[near])
    np.maximum.at(highest, at_event[near], at_frame[near])
    found = best < np.inf
    highest = np.where(best < 1e-18, lowest, highest) + 1
    return pa.StructArray.from_arrays([pa.array(lowest), pa.array(highest)], ["from", "to"], mask=pa.array(~found))


def _costs(key: np.ndarray, values: list[np.ndarray], event: np.ndarray, frame: np.ndarray, size: int) -> np.ndarray:
    """The least cost of a broken line at each frame over its seven places, NaN if none counts. Sums are taken row by row, as covar_pop takes them."""
    if not len(key):
        return np.full(len(event), np.nan)
    straight, broken, enough = 0.0, 0.0, np.ones(len(event), bool)
    for side in (0, 1):
        at, use = [], []
        for sign, first in ((-1, 0), (1, 1)):
            run, n = np.ones(len(event), bool), 0
            for k in range(8):
                wanted = (event * 2 + side) * size + frame + first + sign * k
                i = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                run = run & (key[i] == wanted)
                at.append(i)
                use.append(run)
                n = n + run
            enough &= n >= 5
        at, use = np.stack(at), np.stack(use)
        t, x, y = (v[at] for v in values)
        left, right = np.where(use[:8], t[:8], -np.inf).max(axis=0), np.where(use[8:], t[8:], np.inf).min(axis=0)
        part = np.array(FRACTIONS)[:, None]
        t = t[:, None] - ((1 - part) * left + part * right)
        row = {"t": t, "z": np.maximum(t, 0.0), "x": x[:, None], "y": y[:, None]}
        mean, c, n = dict.fromkeys(row, 0.0), dict.fromkeys(("tt", "zz", "tz", "tx", "zx", "xx", "ty", "zy", "yy"), 0.0), 0.0
        for k, u in enumerate(use):
            n = n + u
            step = {v: np.where(u, r[k] - mean[v], 0.0) for v, r in row.items()}
            mean = {v: mean[v] + step[v] / np.maximum(n, 1) for v in row}
            c = {ab: s + np.where(u, step[ab[0]] * (row[ab[1]][k] - mean[ab[1]]), 0.0) for ab, s in c.items()}
        c = {ab: s / n for ab, s in c.items()}
        zz = c["zz"] - c["tz"] * c["tz"] / c["tt"]
        line = {v: c[v + v] - c["t" + v] * c["t" + v] / c["tt"] for v in "xy"}
        over = {v: c["z" + v] - c["tz"] * c["t" + v] / c["tt"] for v in "xy"}
        gain = {v: np.where(zz > 1e-12 * c["tt"], o * o / zz, 0.0) for v, o in over.items()}
        straight = straight + np.maximum(0.0, (line["x"] + line["y"]) / 2)
        broken = broken + np.maximum(0.0, (line["x"] - gain["x"] + line["y"] - gain["y"]) / 2)
    cost = np.where(enough & (straight > 1e-9) & (broken < straight * 0.4), broken, np.inf).min(axis=0)
    return np.where(cost < np.inf, cost, np.nan)


def change_points(events: DataFrame, obs: DataFrame) -> DataFrame:
    """(video_id, event_id, from, to) of events (video_id, event_id, a, b, frame_start, frame_end): where both paths bend.

    Each frame f of an event with 5 to 8 contiguous rows of both tracks up to f and from f + 1, and each of seven places between them, is tried:
    a broken line against a straight one. It counts if the straight one misses by over 1e-9 and the broken one by under 0.4 of that. The result is
    the bracket of all frames within 5 % of the best, or one frame for a noiseless bend. Rows meet events by video, track and buckets of frames and
    leave that join once for each event, not for each frame and place that is tried; fits run in numpy for many events at once."""
    keys = ["video_id", "event_id", "frame_start", "frame_end"]
    lo, hi = (F.col("frame_start") - 7).alias("lo"), (F.col("frame_end") + 7).alias("hi")
    tracks = F.explode(F.array(*[F.struct(F.lit(c == "a").alias("first"), F.col(c).alias("track_id")) for c in "ab"]))
    own = events.where("a <> b AND frame_start < frame_end").select(*keys, lo, hi, tracks.alias("m")).select(*keys, "lo", "hi", "m.*")
    rows = rows_in_ranges(own, obs.where(usable()).select("video_id", "track_id", "frame_index", "t_s", "x", "y"), [*keys, "first"], 32)
    fields = F.struct("first", F.col("frame_index").cast("long").alias("frame_index"), *[F.col(c).cast("double").alias(c) for c in ("t_s", "x", "y")])
    each = rows.groupBy(*keys).agg(F.collect_list(fields).alias("rows"))  # 2 * (length + 14) rows
    found = F.arrow_udf(_bends, "struct<from:bigint,to:bigint>").asNondeterministic()("rows", F.col("frame_start").cast("long"), F.col("frame_end").cast("long"))  # so called, it isn't run again by the filter
    return each.select("video_id", "event_id", found.alias("found")).where("found IS NOT NULL").select("video_id", "event_id", "found.from", "found.to")
