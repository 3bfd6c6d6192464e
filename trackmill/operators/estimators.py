"""Coefficients from trials: hierarchical means, bootstrap, segment, restitution and impact estimates."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

#: Rows of a grid that are broadcast; a longer one is joined by its keys.
GRID_ROWS = 500_000
G = 9.80665


def hierarchy(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of rows for each video, of videos for each session, of sessions; and the plain row mean, the standard deviations
    (null under two) and the inverse-variance mean. Rows have video_id, session_id, value, variance. Chained
    aggregations: only sums leave a task."""
    by = by or []
    v = rows.groupBy(*by, "session_id", "video_id").agg(
        F.avg("value").alias("m"), F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"),
        F.sum(F.when(F.col("variance") > 0, F.col("value") / F.col("variance"))).alias("wv"), F.sum(F.when(F.col("variance") > 0, 1 / F.col("variance"))).alias("w"),
    )
    s = v.groupBy(*by, "session_id").agg(F.avg("m").alias("m"), *[F.sum(c).alias(c) for c in ("n", "s", "ss", "wv", "w")], F.count("*").alias("videos"), F.sum("m").alias("vs"), F.sum(F.col("m") * F.col("m")).alias("vss"))
    t = s.groupBy(*by).agg(
        F.avg("m").alias("estimate"), F.sum("n").alias("n_rows"), F.sum("videos").alias("n_videos"), F.count("*").alias("n_sessions"), F.stddev_samp("m").alias("session_std"),
        F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("wv").alias("wv"), F.sum("w").alias("w"), F.sum("vs").alias("vs"), F.sum("vss").alias("vss"),
    )
    std = lambda n, a, q: F.when(F.col(n) > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col(q) - F.col(a) * F.col(a) / F.col(n)) / (F.col(n) - 1))))
    return t.select(
        *by, "estimate", "n_rows", "n_videos", "n_sessions", (F.col("s") / F.col("n_rows")).alias("row_mean"), std("n_rows", "s", "ss").alias("row_std"),
        std("n_videos", "vs", "vss").alias("video_std"), F.when(F.col("n_sessions") > 1, F.col("session_std")).alias("session_std"), F.try_divide("wv", "w").alias("weighted_mean"),
    )


def with_median(summary: DataFrame, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """hierarchy's rows and row_median, the exact median of all values."""
    median = rows.groupBy(*(by or [])).agg(F.percentile("value", F.lit(0.5)).alias("row_median"))
    return summary.join(median, by, "left") if by else summary.crossJoin(median)  # one row each


def numbered_groups(groups: DataFrame, buckets: int = 64) -> DataFrame:
    """groups (group_id), each once, with place, from 0, and size, how many there are. Groups are numbered within hashed buckets, and
    the buckets' counts are summed, so that no task has them all."""
    digits = F.conv(F.substring(F.md5(F.col("group_id").cast("string")), 1, 4), 16, 10).cast("int")
    own = groups.select("group_id").where("group_id IS NOT NULL").distinct().withColumn("bucket", digits % buckets)
    one = Window.partitionBy(F.lit(0))  # over at most `buckets` rows
    before = F.coalesce(F.sum("n").over(one.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = own.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", before.alias("before"), F.sum("n").over(one).alias("size"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("group_id")) - 1
    return own.withColumn("place", place.cast("long")).join(F.broadcast(sums), "bucket").select("group_id", (F.col("place") + F.col("before")).alias("place"), "size")


def draws(groups: DataFrame, n: int, seed: int) -> DataFrame:
    """(boot_id, slot, group_id): n draws of as many groups as there are (rows group_id, place from 0, size), with replacement. The pick
    is 60 bits of a digest of seed, draw and slot, so that any task, and SQL, can repeat it."""
    slots = groups.select(F.col("place").alias("slot"), "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("boot_id"))
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("boot_id").cast("string"), F.col("slot").cast("string")))
    pick = F.conv(F.substring(mixed, 1, 15), 16, 10).cast("long") % F.col("size")
    return slots.select("boot_id", "slot", pick.alias("pick")).join(groups.select(F.col("place").alias("pick"), "group_id"), "pick").drop("pick")


def per_video(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id", "video_id").agg(F.avg("value").alias("value"), F.lit(None).cast("double").alias("variance"))


def python_estimator(f: Callable[[pd.DataFrame], float | None]) -> Callable[[DataFrame, list[str]], DataFrame]:
    """An estimator for bootstrap and leave_one_out from a function of a group's rows (session_id, video_id, value, variance); what it
    raises or returns as no finite number is a null estimate. A group is one row for each video, which is what a task holds."""

    def estimate(rows: DataFrame, by: list[str]) -> DataFrame:
        own = rows if by else rows.withColumn("every_row", F.lit(0))
        keys = by or ["every_row"]

        def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            try:
                value = f(group)
            except (ValueError, ArithmeticError):
                value = None
            known = value is not None and math.isfinite(value)
            return pd.DataFrame([[*key, float(value) if known else None]], columns=[*keys, "estimate"])

        schema = T.StructType([*(own.schema[k] for k in keys), T.StructField("estimate", T.DoubleType())])
        return own.groupBy(*keys).applyInPandas(one, schema).select(*by, "estimate")

    return estimate


def bootstrap(rows: DataFrame, estimator: Callable[[DataFrame, list[str]], DataFrame] = hierarchy, unit: str | None = None, n: int = 200, seed: int = 0) -> DataFrame:
    """(estimate, low, high, groups, unit, scope, failed, group_std): 2.5 and 97.5 percentiles of the estimator over draws of whole
    groups, how many draws gave no estimate, and the standard deviation of the groups' own estimates.

    The unit is the session if there is more than one, else the video. Drawn groups are relabelled, so that one drawn twice
    counts twice. With fewer than two groups, or two draws with an estimate, the interval is null, never of width zero.
    Rows are first summed to one for each video, so what is multiplied by the draws is small."""
    if unit is None:
        unit = "session_id" if rows.select("session_id").where("session_id IS NOT NULL").distinct().limit(2).count() > 1 else "video_id"
    video = per_video(rows)
    groups = numbered_groups(video.select(F.col(unit).alias("group_id")))
    drawn = draws(groups, n, seed).join(video.withColumn("group_id", F.col(unit)), "group_id")
    label = F.concat_ws(":", F.col("slot").cast("string"), F.col("video_id").cast("string"))
    session = F.concat_ws(":", F.col("slot").cast("string"), F.col("session_id").cast("string")) if unit == "session_id" else F.col("session_id").cast("string")
    drawn = drawn.select("boot_id", label.alias("video_id"), session.alias("session_id"), "value", "variance")
    ok = F.col("estimate").isNotNull() & ~F.isnan("estimate")
    e = estimator(drawn, ["boot_id"]).where(ok).agg(F.percentile("estimate", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("*").alias("ok"))
    each = estimator(video.withColumn("group_id", F.col(unit)), ["group_id"]).agg(F.stddev_samp("estimate").alias("group_std"), F.count("*").alias("groups"))
    whole = estimator(video, []).select("estimate").crossJoin(each).crossJoin(e)  # one row each
    many = (F.col("groups") > 1) & (F.col("ok") > 1)
    scope = "between_sessions" if unit == "session_id" else "within_single_session_between_videos"
    return whole.select(
        "estimate", F.when(many, F.col("q")[0]).alias("low"), F.when(many, F.col("q")[1]).alias("high"), "groups", F.lit(unit).alias("unit"), F.lit(scope).alias("scope"),
        F.when(F.col("groups") > 1, n - F.col("ok")).alias("failed"), F.when(F.col("groups") > 1, F.col("group_std")).alias("group_std"),
    )


def leave_one_out(rows: DataFrame) -> DataFrame:
    """(excluded, estimate): the hierarchical estimate without each video in turn. Sums of each session less the video's own, so that
    videos meet their session and one row of totals, never each other. Null where nothing is left."""
    video = per_video(rows).select("session_id", "video_id", "value")
    session = video.groupBy("session_id").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    total = session.agg(F.sum(F.col("s") / F.col("n")).alias("all_means"), F.count("*").alias("all_sessions"))
    less = video.join(session, "session_id").withColumn("rest", F.when(F.col("n") > 1, (F.col("s") - F.col("value")) / (F.col("n") - 1)))
    own = less.groupBy(F.col("video_id").alias("excluded")).agg(F.sum(F.coalesce("rest", F.lit(0.0)) - F.col("s") / F.col("n")).alias("change"), F.count_if(F.col("rest").isNull()).alias("gone"))
    return own.crossJoin(F.broadcast(total)).select("excluded", F.try_divide(F.col("all_means") + F.col("change"), F.col("all_sessions") - F.col("gone")).alias("estimate"))


def segment_coefficient(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, v0, decel, mu, status, mu_variance, position_rmse, rank_deficient, active_bound) of segments (t_s, s = distance along the track, sigma, and, if there is, warned): s = c + v t - mu g t^2 / 2 by weighted
    least squares, from moment sums about the segment's first time. A negative value stays, as a candidate, and is on the bound 0. The variance is that of the weights, raised by
    chi squared over n - 3 where that is more than one; the RMSE is weighted. A segment with a warned row is computed_with_warnings."""
    w = Window.partitionBy(*keys)
    own = rows.withColumns({"t": F.col("t_s") - F.min("t_s").over(w), "w": 1 / (F.col("sigma") * F.col("sigma"))})
    own = own if "warned" in rows.columns else own.withColumn("warned", F.lit(False))
    t = F.col("t")
    power = lambda k: F.sum(F.col("w") * F.pow(t, F.lit(float(k))))
    value = lambda k: F.sum(F.col("w") * F.pow(t, F.lit(float(k))) * F.col("s"))
    m = own.groupBy(*keys).agg(F.count("*").alias("n"), *[power(k).alias(f"s{k}") for k in range(5)], *[value(k).alias(f"b{k}") for k in range(3)], F.sum(F.col("w") * F.col("s") * F.col("s")).alias("ss"), F.coalesce(F.bool_or("warned"), F.lit(False)).alias("warned"))
    a, c, d, e, f = (F.col(f"s{k}") for k in range(5))
    det = a * (d * f - e * e) - c * (c * f - e * d) + d * (c * e - d * d)
    safe = F.when((F.col("n") >= 3) & (F.abs(det) > 1e-9 * a * d * f), det)
    b0, b1, b2 = (F.col(f"b{k}") for k in range(3))
    v0 = ((d * e - c * f) * b0 + (a * f - d * d) * b1 + (c * d - a * e) * b2) / safe
    acc = ((c * e - d * d) * b0 + (c * d - a * e) * b1 + (a * d - c * c) * b2) / safe
    at0 = ((d * f - e * e) * b0 + (d * e - c * f) * b1 + (c * e - d * d) * b2) / safe
    chi2 = F.greatest(F.lit(0.0), F.col("ss") - at0 * b0 - v0 * b1 - acc * b2)
    excess = F.when(F.col("n") > 3, F.greatest(F.lit(1.0), chi2 / (F.col("n") - 3))).otherwise(1.0)
    out = m.select(
        *keys, "n", v0.alias("v0"), (-2 * acc).alias("decel"), "warned", (4 * (a * d - c * c) / safe * excess / (G * G)).alias("mu_variance"),
        F.sqrt(chi2 / a).alias("position_rmse"), safe.isNull().alias("rank_deficient"),
    )
    mu = F.col("decel") / G
    status = F.when(F.col("decel").isNull(), "not_computed").when(F.col("decel") < 0, "candidate_only").when(F.col("warned"), "computed_with_warnings").otherwise("computed")
    out = out.withColumns({"mu": mu, "status": status, "active_bound": F.when(F.col("decel") <= 0, "low")})
    return out.select(*keys, "n", "v0", "decel", "mu", "status", "mu_variance", "position_rmse", "rank_deficient", "active_bound")


#: No sigma of a speed along the normal is taken to be less, in m/s.
LEAST_SPEED_SIGMA = 0.003


def normal_trials(events: DataFrame) -> DataFrame:
    """events (event_id, nx, ny, pre / post velocities of both and, if there are, their sigmas: pre_svx1 ...) and a, b, e_obs, sa, sb, skip_reason, warning. e_obs = -b / a is never
    clipped; a value outside 0 to 1 is a warning. sa and sb are the sigmas of the velocities' differences along the normal, LEAST_SPEED_SIGMA at least; a missing
    sigma makes them null, which is a warning and skips nothing."""
    c = F.col
    size = F.sqrt(c("nx") * c("nx") + c("ny") * c("ny"))
    unit = F.when(size > 0, size)
    project = lambda side: ((c(f"{side}_vx1") - c(f"{side}_vx2")) * c("nx") + (c(f"{side}_vy1") - c(f"{side}_vy2")) * c("ny")) / unit
    square = lambda x: x * x
    known = {f"{side}_sv{axis}{i}" for side in ("pre", "post") for axis in "xy" for i in (1, 2)} <= set(events.columns)

    def sigma(side: str) -> Column:
        if not known:
            return F.lit(None).cast("double")
        along = square(c("nx") / unit) * (square(c(f"{side}_svx1")) + square(c(f"{side}_svx2"))) + square(c("ny") / unit) * (square(c(f"{side}_svy1")) + square(c(f"{side}_svy2")))
        return F.when(along.isNotNull(), F.greatest(F.lit(LEAST_SPEED_SIGMA), F.sqrt(along)))

    out = events.withColumns({"a": project("pre"), "b": project("post"), "sa": sigma("pre"), "sb": sigma("post")})
    reason = F.when(~F.coalesce(size > 0, F.lit(False)), "no_normal").when(c("a").isNull() | c("b").isNull(), "state_missing").when(c("a") <= 1e-12, "no_approach")
    out = out.withColumn("skip_reason", reason)
    out = out.withColumn("e_obs", F.when(c("skip_reason").isNull(), -c("b") / c("a")))
    warning = F.when((c("e_obs") < 0) | (c("e_obs") > 1), "outside_0_1")
    if known:
        warning = F.coalesce(warning, F.when(c("skip_reason").isNull() & (c("sa").isNull() | c("sb").isNull()), "sigma_missing"))
    return out.withColumn("warning", warning)


def on_grid(rows: DataFrame, grid: DataFrame, keys: list[str], size: int) -> DataFrame:
    """rows with each of the grid's cells that have their keys. `size`, the grid's counted rows, decides whether it is broadcast."""
    grid = F.broadcast(grid) if size <= GRID_ROWS else grid
    return rows.join(grid, keys) if keys else rows.crossJoin(grid)


def restitution_cost(rows: DataFrame, newton: int = 6) -> DataFrame:
    """rows (a, b, sa, sb, e) and cost: the soft-L1 loss of both speeds with the latent approach speed profiled out by Newton steps."""
    a, b, sa, sb, e, v = (F.col(k) for k in ("a", "b", "sa", "sb", "e", "x"))
    best = lambda w1, w2: F.greatest(F.lit(0.0), (w2 * a / (sa * sa) - w1 * b * e / (sb * sb)) / (w2 / (sa * sa) + w1 * e * e / (sb * sb)))
    rows = rows.withColumn("x", best(F.lit(1.0), F.lit(1.0)))
    r1, r2 = (b + e * v) / sb, (v - a) / sa
    for _ in range(newton):
        rows = rows.withColumn("x", best(1 / F.sqrt(1 + r1 * r1), 1 / F.sqrt(1 + r2 * r2)))
    return rows.withColumn("cost", F.sqrt(1 + r1 * r1) - 1 + F.sqrt(1 + r2 * r2) - 1).drop("x")


def _restitution_grid(windows: DataFrame, points: int) -> DataFrame:
    """windows (low, high) and e, points in each."""
    at = windows.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return at.withColumn("e", F.col("low") + F.col("at") / (points - 1) * (F.col("high") - F.col("low"))).drop("at")


def _restitution_window(points: int) -> dict[str, Column]:
    step = (F.col("high") - F.col("low")) / (points - 1)
    return {"new_low": F.greatest(F.lit(0.0), F.col("e") - step), "new_high": F.least(F.lit(1.0), F.col("e") + step)}


def normal_restitution(trials: DataFrame, by: list[str] | None = None, points: int = 41, zooms: int = 3, newton: int = 6) -> DataFrame:
    """(by, e, cost, n, observed_mean, observed_median, on_bound): restitution with errors in both speeds under a soft-L1 loss, 0 <= e <= 1.

    Trials have a, b, sa, sb. Each candidate e of a grid meets every trial, and the losses are summed for each candidate
    before anything is shuffled. Each zoom lays the grid about the best candidate so far, which is written, so that a zoom reads the trials once. The grid has
    `points` rows for each `by`; it is broadcast if they are few, counted, and else joined by its keys."""
    by = by or []
    seen = trials.groupBy(*by).agg(F.count("*").alias("n"), F.avg(-F.col("b") / F.col("a")).alias("observed_mean"), F.percentile(-F.col("b") / F.col("a"), F.lit(0.5)).alias("observed_median"))
    best = written((trials.select(*by).distinct() if by else trials.select(F.lit(0)).limit(1)).select(*by, F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), "windows")
    n = best.count() * points
    for _ in range(zooms):
        rows = on_grid(trials.select(*by, "a", "b", "sa", "sb"), _restitution_grid(best, points), by, n)
        sums = restitution_cost(rows, newton).groupBy(*by, "low", "high", "e").agg(F.sum("cost").alias("cost"))
        top = sums.groupBy(*by).agg(F.min_by(F.struct("e", "cost", "low", "high"), F.struct("cost", "e")).alias("t")).select(*by, "t.*")
        best = written(top.withColumns(_restitution_window(points)).select(*by, "e", "cost", F.col("new_low").alias("low"), F.col("new_high").alias("high")), "windows")
    out = best.join(seen, by) if by else best.crossJoin(seen)  # one row each
    return out.select(*by, "e", "cost", "n", "observed_mean", "observed_median", ((F.col("e") <= 1e-9) | (F.col("e") >= 1 - 1e-9)).alias("on_bound"))


def predict_impacts(trials: DataFrame, e_n: Column, e_t: Column, mu: Column, sliding_scale: float | None = None) -> DataFrame:
    """trials (a, c, m1, m2, r1, r2, i1, i2) and the impulses, branch, state after and checks of a pair impact.

    An = 1/m1 + 1/m2; At = An + r1^2/i1 + r2^2/i2; Jn = (1 + e_n) a / An; Jt = (1 + e_t) c / At + sign(c) min(mu Jn, |c| / As), with
    As = At, or sliding_scale * An. Status: separating without approach, unsupported without bodies."""
    k = F.col
    an = 1 / k("m1") + 1 / k("m2")
    at = an + k("r1") * k("r1") / k("i1") + k("r2") * k("r2") / k("i2")
    out = trials.withColumns({"e_n": e_n, "e_t": e_t, "mu": mu, "An": an, "At": at})
    out = out.withColumn("As", k("At") if sliding_scale is None else sliding_scale * k("An"))
    out = out.withColumn("Jn", (1 + k("e_n")) * k("a") / k("An"))
    out = out.withColumn("Jt", (1 + k("e_t")) * k("c") / k("At") + F.signum("c") * F.least(k("mu") * k("Jn"), F.abs("c") / k("As")))
    out = out.withColumns({
        "branch": F.when(k("mu") * k("Jn") < F.abs("c") / k("As"), "sliding").otherwise("sticking"),
        "b": k("a") - k("An") * k("Jn"), "c_after": k("c") - k("At") * k("Jt"),
        "spin_change_1": -k("r1") * k("Jt") / k("i1"), "spin_change_2": -k("r2") * k("Jt") / k("i2"),
    })
    energy = 0.5 * (k("b") * k("b") - k("a") * k("a")) / k("An") + 0.5 * (k("c_after") * k("c_after") - k("c") * k("c")) / k("At")
    status = F.when(k("At").isNull() | k("An").isNull(), "unsupported").when(k("a") <= 0, "separating").when(k("energy_change") > 1e-12, "invalid").otherwise("ok")
    return out.withColumn("energy_change", energy).withColumn("status", status)


def tangential_cost(rows: DataFrame, e_n: Column) -> DataFrame:
    """Trials with cells (gt, gm) and cost: the squared whitened residual of the slip after, and a penalty on energy gain."""
    rows = predict_impacts(rows, e_n, F.col("gt"), F.col("gm"))
    r = (F.col("c_obs") - F.col("c_after")) / F.col("sc")
    return rows.withColumn("cost", r * r + 1e3 * F.greatest(F.lit(0.0), F.col("energy_change")))


def _tangential_grid(windows: DataFrame, points: int) -> DataFrame:
    """windows (t_low, t_high, m_low, m_high) and cells (gt, gm), points by points in each."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(points * points - 1)))
    u, v = F.col("cell") % points / (points - 1), F.floor(F.col("cell") / points) / (points - 1)
    out = windows.withColumn("cell", cell)
    return out.withColumns({"gt": F.col("t_low") + u * (F.col("t_high") - F.col("t_low")), "gm": F.col("m_low") + v * (F.col("m_high") - F.col("m_low"))}).drop("cell")


def _tangential_window(points: int) -> list[Column]:
    step_t, step_m = (F.col("t_high") - F.col("t_low")) / (points - 1), (F.col("m_high") - F.col("m_low")) / (points - 1)
    return [
        F.greatest(F.lit(-1.0), F.col("gt") - step_t).alias("t_low"), F.least(F.lit(1.0), F.col("gt") + step_t).alias("t_high"),
        F.greatest(F.lit(0.0), F.col("gm") - step_m).alias("m_low"), F.least(F.lit(1.0), F.col("gm") + step_m).alias("m_high"),
    ]


#: The first window of a tangential search.
TANGENTIAL_START = (("t_low", -1.0), ("t_high", 1.0), ("m_low", 0.0), ("m_high", 1.0))
TANGENTIAL_WINDOW = [n for n, _ in TANGENTIAL_START]


def tangential_fit(trials: DataFrame, e_n: float | Column, points: int = 21, zooms: int = 2, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """For each `by` the best (e_t, mu, cost, n, withheld) of a grid over [-1, 1] x [0, 1], and the last grid's costs: squared whitened residuals of the
    slip after (c_obs, sc) and a penalty on energy gain. e_n is a number, or a column of the trials. withheld says why the pair is not to be used: fewer than three trials, a best cell
    on the bounds, or a best cell at which a trial gains energy; else null. Each zoom's window is written, so that a zoom reads the trials
    once; the grid has points x points cells for each `by`, broadcast if they are few, counted, and else joined by its keys."""
    by = by or []
    e_n = F.lit(e_n) if isinstance(e_n, float) else e_n
    best = written((trials.select(*by).distinct() if by else trials.select(F.lit(0)).limit(1)).select(*by, *[F.lit(v).alias(n) for n, v in TANGENTIAL_START]), "windows")
    n, costs = best.count() * points * points, None
    for _ in range(zooms):
        rows = tangential_cost(on_grid(trials, _tangential_grid(best, points), by, n), e_n)
        gains = F.count_if(F.col("energy_change") > 1e-12).alias("gains")
        costs = written(rows.groupBy(*by, *TANGENTIAL_WINDOW, "gt", "gm").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"), gains), "costs")
        top = costs.groupBy(*by).agg(F.min_by(F.struct("gt", "gm", "cost", "n", "gains", *TANGENTIAL_WINDOW), F.struct("cost", "gt", "gm")).alias("t")).select(*by, "t.*")
        best = written(top.select(*by, "gt", "gm", "cost", "n", "gains", *_tangential_window(points)), "windows")
    on_bound = (F.abs("gt") >= 1 - 1e-9) | (F.col("gm") <= 1e-9) | (F.col("gm") >= 1 - 1e-9)
    withheld = F.when(F.col("n") < 3, "fewer_than_3_trials").when(on_bound, "on_bound").when(F.col("gains") > 0, "not_admissible")
    return best.select(*by, F.col("gt").alias("e_t"), F.col("gm").alias("mu"), "cost", "n", withheld.alias("withheld")), costs.select(*by, "gt", "gm", "cost")


def profile(costs: DataFrame, fixed: str, other: str) -> DataFrame:
    """(fixed, other, delta): for each fixed value the least cost over the other, less the least of all."""
    p = costs.groupBy(fixed).agg(F.min("cost").alias("cost"), F.min_by(other, F.struct("cost", other)).alias(other))
    return p.crossJoin(costs.agg(F.min("cost").alias("least"))).select(fixed, other, (F.col("cost") - F.col("least")).alias("delta"))


def impulse_diagnostics(trials: DataFrame) -> DataFrame:
    """trials (a, b, c, c_after, m1, m2, r1, r2, i1, i2, dw1, dw2) and four estimates of the tangential impulse, their mean and standard
    deviation, and the normal one."""
    k = F.col
    an = 1 / k("m1") + 1 / k("m2")
    at = an + k("r1") * k("r1") / k("i1") + k("r2") * k("r2") / k("i2")
    four = F.array((k("c") - k("c_after")) / at, -k("dw1") * k("i1") / k("r1"), -k("dw2") * k("i2") / k("r2"), (k("c") - k("c_after")) / an)
    mean = F.aggregate("jt", F.lit(0.0), lambda s, x: s + x) / 4
    var = F.aggregate("jt", F.lit(0.0), lambda s, x: s + (x - k("jt_mean")) * (x - k("jt_mean"))) / 3
    out = trials.withColumns({"jn": (k("a") - k("b")) / an, "jt": four}).withColumn("jt_mean", mean)
    return out.withColumns({"jt_std": F.sqrt(var), "e_t_obs": F.try_divide(-k("c_after"), k("c"))})


def monte_carlo(rows: DataFrame, f: Callable[[Column], Column], value: str, shared_sigma: float, own_sigma: str, n: int, seed: int, second: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, mean, std, low, high, and, with a second function, covariance of both): f of the value with one shared and one own normal draw for each replicate. Draws are counter based:
    each is a sum of 12 hashed uniforms, so that any task can repeat it."""

    def normal(*parts: Column) -> Column:
        return sum((F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *parts), F.lit(1 << 30)) / float(1 << 30) for i in range(12)), F.lit(-6.0))

    each = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = F.col(value) * (1 + shared_sigma * normal(F.col("rep"))) + F.col(own_sigma) * normal(F.col("rep"), F.col("key"))
    each = each.withColumn("out", f(drawn))
    more = [] if second is None else [F.covar_samp("out", second(drawn)).alias("covariance")]
    out = each.groupBy("key").agg(F.avg("out").alias("mean"), F.stddev_samp("out").alias("std"), F.percentile("out", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), *more)
    return out.select("key", "mean", "std", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), *["covariance"] * len(more))


def diagnostics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, condition, correlation, var1, var2, covariance, norm1, norm2) of two-parameter fits from rows of a whitened Jacobian (j1, j2):
    the inverse of its normal matrix and the norms of its columns. All but rank and norms are null where the rank is under 2."""
    m = rows.groupBy(*keys).agg(F.sum(F.col("j1") * F.col("j1")).alias("p"), F.sum(F.col("j1") * F.col("j2")).alias("q"), F.sum(F.col("j2") * F.col("j2")).alias("r"))
    half, p, q, r = (F.col("p") + F.col("r")) / 2, F.col("p"), F.col("q"), F.col("r")
    spread = F.sqrt((p - r) * (p - r) / 4 + q * q)
    big, small = half + spread, F.greatest(half - spread, F.lit(0.0))
    full = small > 1e-12 * big
    rank = F.when(full, 2).when(big > 0, 1).otherwise(0)
    det = F.when(full, p * r - q * q)
    return m.select(
        *keys, rank.alias("rank"), F.when(full, F.sqrt(big / small)).alias("condition"), F.when(full, -q / F.sqrt(p * r)).alias("correlation"),
        (r / det).alias("var1"), (p / det).alias("var2"), (-q / det).alias("covariance"), F.sqrt(p).alias("norm1"), F.sqrt(r).alias("norm2"),
    )


def symmetric_eigenvalues(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> list[Column]:
    """The three eigenvalues, largest first, of [[a, d, e], [d, b, f], [e, f, c]], none negative. The largest by the cosine of a third of an angle, the
    others from the sums of minors and the determinant, as differences from the largest would lose what is small."""
    mean = (a + b + c) / 3
    size = F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean) + 2 * (d * d + e * e + f * f)) / 6)
    x, y, z, u, v, w = (m / F.when(size > 0, size) for m in (a - mean, b - mean, c - mean, d, e, f))
    half = (x * (y * z - w * w) - u * (u * z - w * v) + v * (u * w - y * v)) / 2
    big = F.coalesce(mean + 2 * size * F.cos(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3), mean)
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    both = F.when(big > 0, det / big)
    rest = (a * b - d * d + a * c - e * e + b * c - f * f - both) / F.when(big > 0, big)
    middle = F.coalesce(F.greatest(F.lit(0.0), rest / 2 + F.sqrt(F.greatest(F.lit(0.0), rest * rest / 4 - both))), F.lit(0.0))
    return [big, middle, F.coalesce(F.greatest(F.lit(0.0), F.when(middle > 0, both / middle)), F.lit(0.0))]


def diagnostics3(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, condition, var1..3, covariance12, 13, 23, correlation12, 13, 23, norm1..3) of three-parameter fits from rows of a whitened Jacobian (j1, j2, j3): the
    inverse of its normal matrix and the norms of its columns, from sums of products. All but rank and norms are null where the rank is under 3."""
    j = [F.col(f"j{i}") for i in (1, 2, 3)]
    places = {"a": (0, 0), "b": (1, 1), "c": (2, 2), "d": (0, 1), "e": (0, 2), "f": (1, 2)}
    m = rows.groupBy(*keys).agg(*[F.sum(j[i] * j[k]).alias(n) for n, (i, k) in places.items()])
    a, b, c, d, e, f = (F.col(n) for n in places)
    big, middle, small = symmetric_eigenvalues(a, b, c, d, e, f)
    m = m.withColumns({"big": big, "middle": middle, "small": small})
    over = lambda x: (F.col(x) > 1e-12 * F.col("big")).cast("int")
    m = m.withColumn("rank", F.when(F.col("big") > 0, 1 + over("middle") + over("small")).otherwise(0))
    det = F.when(F.col("rank") == 3, a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e))
    inverse = {"var1": b * c - f * f, "var2": a * c - e * e, "var3": a * b - d * d, "covariance12": e * f - d * c, "covariance13": d * f - e * b, "covariance23": d * e - a * f}
    m = m.withColumns({n: x / det for n, x in inverse.items()})
    pairs = {f"correlation{i}{k}": F.col(f"covariance{i}{k}") / F.sqrt(F.col(f"var{i}") * F.col(f"var{k}")) for i, k in ((1, 2), (1, 3), (2, 3))}
    condition = F.when(F.col("rank") == 3, F.sqrt(F.col("big") / F.col("small")))
    return m.select(*keys, "rank", condition.alias("condition"), *inverse, *[x.alias(n) for n, x in pairs.items()], F.sqrt(a).alias("norm1"), F.sqrt(b).alias("norm2"), F.sqrt(c).alias("norm3"))


def active_bounds(estimates: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """estimates (value, low, high) and active_bound: low or high where the value is on it, else null."""
    at = lambda c: F.abs(F.col("value") - F.col(c)) <= tolerance
    return estimates.withColumn("active_bound", F.when(at("low"), "low").when(at("high"), "high"))


def learn_template(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, sd, ratio, learned): circular mean and sd of angle differences, and the median radius ratio; learned from 3."""
    out = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.sin("d")).alias("s"), F.avg(F.cos("d")).alias("c"), F.percentile("ratio", F.lit(0.5)).alias("ratio"))
    r = F.least(F.lit(1.0), F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")))
    return out.select(*keys, "n", F.atan2("s", "c").alias("mean"), F.sqrt(-2 * F.log(r)).alias("sd"), "ratio", (F.col("n") >= 3).alias("learned"))


def design_coverage(trials: DataFrame) -> DataFrame:
    """One row: what a design lacks. Trials have session_id and slip."""
    return trials.agg(
        F.array_compact(F.array(
            F.when(F.count_distinct("session_id") < 3, "fewer_than_3_sessions"), F.when(F.count_if(F.col("slip") > 0) == 0, "no_positive_slip"),
            F.when(F.count_if(F.col("slip") < 0) == 0, "no_negative_slip"), F.when(F.count("*") < 10, "fewer_than_10_trials"),
        )).alias("missing")
    )
