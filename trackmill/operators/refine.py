"""Contact times and side states of candidate events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import usable

STEPS, ZOOMS = 64, 3
SIDES = ("a_pre", "a_post", "b_pre", "b_post")
WHOLE = ("f_min", "f_max")
FIELDS = ("t_min", "t_max", *WHOLE, "radius", "var", "half", "t0", "i11", "i12", "i22", *(f"{v}b{k}" for v in "xy" for k in range(3)))
#: Events that are searched at once.
AT_ONCE = 2_000


def side_rows(marks: DataFrame, obs: DataFrame, window_s: float, most: int = 12) -> DataFrame:
    """marks (video_id, track_id, post, frame_index) once each, with the usable rows that may speak for the track up to that frame, or from it on if post: t_s, x, y (arrays,
    the nearest first), radius, f_min, f_max.

    Of the `most` frames next to it, the run without a missing frame that begins with the nearest row there, at most `most` rows and window_s long. Marks and rows are one timeline for each
    track, so a mark's rows are a range of it; how many events have a mark doesn't matter."""
    rows = obs.where(usable()).select("video_id", "track_id", "frame_index", F.struct("frame_index", "t_s", "x", "y", "radius").alias("r"))
    line = Window.partitionBy("video_id", "track_id").orderBy("frame_index")
    both = rows.unionByName(marks.where("frame_index IS NOT NULL").distinct(), allowMissingColumns=True)
    before = F.filter(F.collect_list("r").over(line.rangeBetween(-most, 0)), lambda r: r["frame_index"] >= 0)
    both = both.withColumns({"before": before, "after": F.collect_list("r").over(line.rangeBetween(0, most))}).where("post IS NOT NULL")
    both = both.withColumn("near", F.when(F.col("post"), F.col("after")).otherwise(F.reverse("before"))).drop("before", "after", "r").where(F.size("near") > 0)
    first = F.col("near")[0]
    fit = F.filter("near", lambda r, i: (F.abs(r["frame_index"] - first["frame_index"]) == i) & (i < most) & (F.abs(r["t_s"] - first["t_s"]) <= window_s))
    out = both.withColumn("fit", fit).where(F.size("fit") > 0)
    return out.select("video_id", "track_id", "post", "frame_index", "fit.t_s", "fit.x", "fit.y", F.array_max("fit.radius").alias("radius"), F.array_min("fit.frame_index").alias("f_min"), F.array_max("fit.frame_index").alias("f_max"))


def _padded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each list, and where it has a value that is not null."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    there = np.arange(n.max(initial=1)) < n[:, None]
    flat, out, known = lists.flatten(), np.zeros(there.shape), np.zeros(there.shape, bool)
    known[there] = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    out[known] = flat.drop_null().to_numpy()
    return out, known


def _side_fits(sides: pa.StructArray, event: np.ndarray, events: int) -> dict[str, np.ndarray]:
    """A quadratic in time for each side, about its event's first time after: FIELDS and there; NaN stands for what is null."""
    number = lambda c: sides.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
    (t, there), post = _padded(sides.field("t_s")), sides.field("post").to_numpy(zero_copy_only=False)
    t_min, t_max = np.where(there, t, np.inf).min(axis=1, initial=np.inf), np.where(there, t, -np.inf).max(axis=1, initial=-np.inf)
    t0, half = np.full(events, np.inf), np.full(events, 1e-9)
    np.minimum.at(t0, event[post], t_min[post])
    np.maximum.at(half, event, np.maximum(np.abs(t_min - t0[event]), np.abs(t_max - t0[event])))
    t0, half = t0[event], half[event]
    u = np.where(there, (t - t0[:, None]) / half[:, None], 0.0)
    p = [there.astype(float)]
    for _ in range(4):
        p.append(p[-1] * u)
    a, c, d, e, f = (x.sum(axis=1) for x in p)
    det = a * (d * f - e * e) - c * (c * f - e * d) + d * (c * e - d * d)
    inv = [[(d * f - e * e) / det, (d * e - c * f) / det, (c * e - d * d) / det], [None, (a * f - d * d) / det, (c * d - a * e) / det], [None, None, (a * d - c * c) / det]]
    out = {"t_min": t_min, "t_max": t_max, "f_min": number("f_min"), "f_max": number("f_max"), "radius": number("radius"), "half": half, "t0": t0, "i11": inv[1][1], "i12": inv[1][2], "i22": inv[2][2]}
    explained, both, squares = 0.0, True, 0.0
    for v in "xy":
        z, known = _padded(sides.field(v))
        both, squares = both & known, squares + z * z
        sums = [np.where(known.any(axis=1), (z * x * known).sum(axis=1), np.nan) for x in p[:3]]
        for r in range(3):
            out[f"{v}b{r}"] = sum(inv[min(r, k)][max(r, k)] * sums[k] for k in range(3))
        explained = explained + sum(out[f"{v}b{k}"] * sums[k] for k in range(3))
    q = np.where(both.any(axis=1), (squares * both).sum(axis=1), np.nan)
    left = q - explained
    out["var"] = np.where(np.isnan(left), 0.0, np.maximum(0.0, left)) / np.maximum(1, 2 * a - 6)
    return out | {"there": (a >= 3) & (np.abs(det) > 1e-12)}


def _search(s: dict[str, dict[str, np.ndarray]], i: np.ndarray) -> np.ndarray:
    """The contact times of events i."""
    w = {k: {c: x[i][:, None] for c, x in v.items()} for k, v in s.items()}
    left, right = np.maximum(w["a_pre"]["t_max"], w["b_pre"]["t_max"]), np.minimum(w["a_post"]["t_min"], w["b_post"]["t_min"])
    reach = w["a_pre"]["radius"] + w["b_pre"]["radius"]

    def at(k: str, v: str, t: np.ndarray) -> np.ndarray:
        u = (t - w[k]["t0"]) / w[k]["half"]
        return w[k][f"{v}b0"] + w[k][f"{v}b1"] * u + w[k][f"{v}b2"] * u * u

    low, high = left, right
    for _ in range(ZOOMS):
        t = low + (high - low) * np.arange(STEPS + 1) / STEPS
        pre = {(k, v): at(f"{k}_pre", v, t) for k in "ab" for v in "xy"}
        dx, dy = pre["b", "x"] - pre["a", "x"], pre["b", "y"] - pre["a", "y"]
        gap = np.sqrt(dx * dx + dy * dy) - reach
        loss = gap * gap + sum((x - at(f"{k}_post", v, t)) ** 2 for (k, v), x in pre.items())
        best = np.take_along_axis(t, loss.argmin(axis=1)[:, None], axis=1)
        step = (high - low) / STEPS
        low, high = np.maximum(left, best - step), np.minimum(right, best + step)
    return best[:, 0]


def _refined(sides: pa.Array) -> pa.Array:
    """For events (arrays of structs: who, post, t_s, x, y, radius, f_min, f_max) the fits of their SIDES and best: the contact time."""
    events = len(sides)
    flat, event = sides.flatten(), np.repeat(np.arange(events), sides.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    with np.errstate(all="ignore"):
        fits = _side_fits(flat, event, events)
        who, s = flat.field("who").to_numpy(zero_copy_only=False), {}
        for k, name in enumerate(SIDES):
            own = np.flatnonzero((who == k) & fits["there"])
            s[name] = {c: np.full(events, np.nan) for c in FIELDS} | {"there": np.zeros(events, bool)}
            for c, x in s[name].items():
                x[event[own]] = fits[c][own]
        ok = np.logical_and.reduce([s[k]["there"] for k in SIDES])
        ok &= np.maximum(s["a_pre"]["t_max"], s["b_pre"]["t_max"]) < np.minimum(s["a_post"]["t_min"], s["b_post"]["t_min"])
        best, found = np.full(events, np.nan), np.flatnonzero(ok)
        for b in range(0, len(found), AT_ONCE):
            i = found[b : b + AT_ONCE]
            best[i] = _search(s, i)
    kind = lambda c: pa.int64() if c in WHOLE else pa.float64()
    own = [pa.StructArray.from_arrays([pa.array(v[c], pa.float64(), from_pandas=True).cast(kind(c)) for c in FIELDS], FIELDS, mask=pa.array(~v["there"])) for v in s.values()]
    return pa.StructArray.from_arrays([*own, pa.array(best, mask=~ok)], [*SIDES, "best"])


def refine_events(events: DataFrame, obs: DataFrame, window_s: float = 0.08) -> DataFrame:
    """events (video_id, event_id, a, b, pre_end, post_start) and time_s, nx, ny, distance, approach, after, e_obs, slip, slip_after, impact_parameter, incidence,
    approach_sigma, boundary_from, boundary_to, kind, warnings. Spins are left to the angular regressions: slip is of the centres.

    Each side of each track is one quadratic, so its position at any time is known without fitting again. The contact time is
    where the centres' distance is nearest the sum of radii and the sides are nearest to meeting: the least of a grid of times between the last
    row before and the first after, laid three times about the best, for many events at once in numpy. Three rows a side are needed (else unmeasurable);
    a time that runs backwards or a grazing approach is invalid."""
    each = [F.struct(F.lit(k).alias("who"), F.col(t).alias("track_id"), F.lit(post).alias("post"), F.col("post_start" if post else "pre_end").alias("frame_index")) for k, (t, post) in enumerate((("a", False), ("a", True), ("b", False), ("b", True)))]
    marks = events.where(~F.col("a").eqNullSafe(F.col("b"))).select("video_id", "event_id", F.explode(F.array(*each)).alias("m")).select("video_id", "event_id", "m.*")
    keys = ["video_id", "track_id", "post", "frame_index"]
    own = marks.join(side_rows(marks.select(*keys), obs, window_s), keys)
    own = own.groupBy("video_id", "event_id").agg(F.collect_list(F.struct("who", "post", "t_s", "x", "y", "radius", "f_min", "f_max")).alias("sides"))
    side = ",".join(f"{c}:{'bigint' if c in WHOLE else 'double'}" for c in FIELDS)
    fits = F.arrow_udf(_refined, f"struct<{','.join(f'{k}:struct<{side}>' for k in SIDES)},best:double>")("sides")
    out = events.join(own.select("video_id", "event_id", fits.alias("fit")), ["video_id", "event_id"], "left")
    out = out.select(*events.columns, "fit.*")
    c = F.col
    complete = c("a_pre").isNotNull() & c("a_post").isNotNull() & c("b_pre").isNotNull() & c("b_post").isNotNull()
    out = out.withColumns({"left": F.greatest("a_pre.t_max", "b_pre.t_max"), "right": F.least("a_post.t_min", "b_post.t_min")})
    ok = complete & (c("left") < c("right"))

    def at(w: str, v: str, t: Column) -> Column:
        u = (t - c(f"{w}.t0")) / c(f"{w}.half")
        return c(f"{w}.{v}b0") + c(f"{w}.{v}b1") * u + c(f"{w}.{v}b2") * u * u

    def speed(w: str, v: str, t: Column) -> Column:
        u = (t - c(f"{w}.t0")) / c(f"{w}.half")
        return (c(f"{w}.{v}b1") + 2 * c(f"{w}.{v}b2") * u) / c(f"{w}.half")

    t = c("best")
    dx, dy = at("b_pre", "x", t) - at("a_pre", "x", t), at("b_pre", "y", t) - at("a_pre", "y", t)
    out = out.withColumns({"dx": dx, "dy": dy}).withColumn("distance", F.sqrt(c("dx") * c("dx") + c("dy") * c("dy")))
    size = F.when(c("distance") >= 1e-10, c("distance"))
    out = out.withColumns({"nx": c("dx") / size, "ny": c("dy") / size})
    for name, side in (("v", "pre"), ("w", "post")):
        out = out.withColumns({f"{name}x": speed(f"a_{side}", "x", t) - speed(f"b_{side}", "x", t), f"{name}y": speed(f"a_{side}", "y", t) - speed(f"b_{side}", "y", t)})

    def spread(w: str) -> Column:
        u = (t - c(f"{w}.t0")) / c(f"{w}.half")
        return c(f"{w}.var") * (c(f"{w}.i11") + 4 * u * c(f"{w}.i12") + 4 * u * u * c(f"{w}.i22")) / (c(f"{w}.half") * c(f"{w}.half"))

    out = out.withColumns({
        "approach": c("vx") * c("nx") + c("vy") * c("ny"), "after": c("wx") * c("nx") + c("wy") * c("ny"), "slip": c("vy") * c("nx") - c("vx") * c("ny"), "slip_after": c("wy") * c("nx") - c("wx") * c("ny"),
        "approach_sigma": F.sqrt(F.greatest(F.lit(0.0), spread("a_pre") + spread("b_pre"))), "boundary_from": F.greatest("a_pre.f_max", "b_pre.f_max"), "boundary_to": F.least("a_post.f_min", "b_post.f_min"),
    })
    good = c("approach") > 1e-12
    v = F.sqrt(c("vx") * c("vx") + c("vy") * c("vy"))
    kind = F.when(~complete, "unmeasurable").when(~ok | ~F.coalesce(good, F.lit(False)), "invalid").otherwise("isolated_binary")
    soft = F.array_compact(F.array(
        F.when(c("approach") <= F.greatest(F.lit(1e-5), 3 * c("approach_sigma")), "weak_approach_signal"), F.when(c("after") > 3 * c("approach_sigma"), "post_state_not_separating"),
    ))
    out = out.withColumns({
        "time_s": t, "e_obs": F.when(good, -c("after") / c("approach")), "impact_parameter": F.when(v > 1e-6, (c("dx") * c("vy") - c("dy") * c("vx")) / v), "incidence": F.atan2("slip", "approach"),
        "kind": kind, "warnings": soft,
    })
    return out.drop("a_pre", "a_post", "b_pre", "b_post", "left", "right", "best", "dx", "dy", "vx", "vy", "wx", "wy")
