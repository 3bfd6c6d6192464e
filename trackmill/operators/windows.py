"""Local regressions along a track."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import TRACK


def _quadratic(near: Column, value: str, half: float, min_samples: int) -> Column:
    """struct(value, velocity, acceleration, velocity_sigma, acceleration_sigma) of the weighted quadratic through near's items (t, w and
    the value), about the row's own time; null with too few items or a singular system.

    One fold gathers the moments and the last step solves the 3 x 3 system in closed form, so that Catalyst has one
    expression to evaluate for each row. Times are in half windows and values relative to the row's own."""
    zero = F.lit(0.0)
    names = [*(f"s{k}" for k in range(5)), *(f"b{k}" for k in range(3)), "q"]
    start = F.struct(*[zero.alias(n) for n in names], F.lit(0).alias("n"))

    def add(m: Column, r: Column) -> Column:
        u, w, y = (r["t"] - F.col("t_s")) / half, r["w"], r[value] - F.col(value)
        p = [w, w * u, w * u * u, w * u * u * u, w * u * u * u * u]
        return F.struct(*[(m[f"s{k}"] + p[k]).alias(f"s{k}") for k in range(5)], *[(m[f"b{k}"] + p[k] * y).alias(f"b{k}") for k in range(3)], (m["q"] + w * y * y).alias("q"), (m["n"] + 1).alias("n"))

    def solve(m: Column) -> Column:
        a, c, d, e, f = (m[f"s{k}"] for k in range(5))
        b0, b1, b2 = (m[f"b{k}"] for k in range(3))
        det = a * (d * f - e * e) - c * (c * f - e * d) + d * (c * e - d * d)
        inverse = F.array(d * f - e * e, d * e - c * f, c * e - d * d, a * f - d * d, c * d - a * e, a * d - c * c)
        ok = (m["n"] >= min_samples) & (det > 1e-12 * a * d * f)
        x = F.struct(F.transform(inverse, lambda i: i / det).alias("i"), m.alias("m"))
        # one-element arrays name what is used more than once
        beta = F.transform(F.array(x), lambda x: F.struct(
            (x["i"][0] * b0 + x["i"][1] * b1 + x["i"][2] * b2).alias("v"), (x["i"][1] * b0 + x["i"][3] * b1 + x["i"][4] * b2).alias("d"),
            (x["i"][2] * b0 + x["i"][4] * b1 + x["i"][5] * b2).alias("a"), x["i"][3].alias("vd"), x["i"][5].alias("va"),
        ))

        def named(z: Column) -> Column:
            chi = F.greatest(F.lit(0.0), m["q"] - z["v"] * b0 - z["d"] * b1 - z["a"] * b2)
            wide = F.greatest(F.lit(1.0), chi / F.greatest(F.lit(1), m["n"] - 3))
            return F.struct(
                (z["v"] + F.col(value)).alias("value"), (z["d"] / half).alias("velocity"), (2 * z["a"] / half / half).alias("acceleration"),
                (F.sqrt(z["vd"] * wide) / half).alias("velocity_sigma"), (2 * F.sqrt(z["va"] * wide) / half / half).alias("acceleration_sigma"),
            )

        return F.when(ok, F.transform(beta, named)[0])

    return F.aggregate(near, start, add, solve)


def _fitted(rows: DataFrame, values: tuple[str, ...], window_s: float, min_samples: int, max_window: int) -> DataFrame:
    """rows (with island, sigma) and fit_<value> for each value, n and reason.

    An island is a run within which a window may reach. Each window is a range of time, in microseconds, so it holds the
    neighbours and nothing else; at most max_window of them, by frame."""
    half = round(window_s / 2 * 1e6)
    order = Window.partitionBy(*TRACK, "island").orderBy("us").rangeBetween(-half, half)
    rows = rows.withColumns({"us": F.round(F.col("t_s") * 1e6).cast("long"), "w": 1 / (F.col("sigma") * F.col("sigma"))})
    item = F.struct(F.col("t_s").alias("t"), F.col("frame_index").alias("f"), "w", *values)
    rows = rows.withColumn("near", F.collect_list(item).over(order))
    near = F.filter("near", lambda r: F.abs(r["f"] - F.col("frame_index")) <= max_window // 2)
    rows = rows.withColumns({f"fit_{v}": _quadratic(near, v, window_s / 2, min_samples) for v in values} | {"n": F.size(near)}).drop("near", "us", "w")
    first = F.col(f"fit_{values[0]}")
    return rows.withColumn("reason", F.when(F.col("n") < min_samples, "insufficient_contiguous_samples").when(first.isNull(), "singular_or_invalid_local_fit"))


def local_derivatives(rows: DataFrame, window_s: float = 0.08, min_samples: int = 5, max_window: int = 161) -> DataFrame:
    """Rows of usable observations with `segment` (see islands) and `sigma`, and fit_x, fit_y, n, reason.

    A weighted quadratic in time about each row, over neighbours of its own segment that are at most half a window away.
    As segments are contiguous and cut by barriers and scope, a missing frame or a contact is never bridged. Standard
    errors grow with the misfit. Too few neighbours or a singular fit give a reason and nulls."""
    return _fitted(rows.withColumn("island", F.col("segment")), ("x", "y"), window_s, min_samples, max_window)


def angular_derivatives(rows: DataFrame, bound: float | None, window_s: float = 0.08, min_samples: int = 5, max_window: int = 161) -> DataFrame:
    """Rows with finite theta, theta_sigma and segment; fit_angle, n, angle_status.

    Angles are unwrapped along runs of contiguous frames of a segment. A speed bound is needed: where a step of time could
    hold half a turn, or a step of angle is over the bound (and 0.05), the window is alias_ambiguous."""
    order = Window.partitionBy(*TRACK, "segment").orderBy("frame_index")
    gap = F.coalesce(F.col("frame_index") != F.lag("frame_index").over(order) + 1, F.lit(True))
    rows = rows.withColumn("island", F.sum(gap.cast("int")).over(order)).withColumn("island", F.concat_ws("-", "segment", "island"))
    run = Window.partitionBy(*TRACK, "island").orderBy("frame_index")
    step = F.col("theta") - F.lag("theta").over(run)
    step = step - 2 * math.pi * F.floor((step + math.pi) / (2 * math.pi))
    dt = F.col("t_s") - F.lag("t_s").over(run)
    over = F.lit(True) if bound is None else (dt * bound >= math.pi) | (F.abs(step) > bound * dt + 0.05)
    rows = rows.withColumns({"step": F.coalesce(step, F.lit(0.0)), "alias": F.coalesce(over, F.lit(False)).cast("int")})
    rows = rows.withColumn("angle", F.first("theta").over(run) + F.sum("step").over(run)).withColumn("sigma", F.greatest(F.lit(0.005), F.coalesce("theta_sigma", F.lit(0.05))))
    half = round(window_s / 2 * 1e6)
    rows = rows.withColumn("us", F.round(F.col("t_s") * 1e6).cast("long"))
    near = Window.partitionBy(*TRACK, "island").orderBy("us").rangeBetween(-half, half)
    # the first row of a window has its step outside it
    rows = rows.withColumn("aliases", F.sum("alias").over(near) - F.first("alias").over(near)).drop("us", "step")
    out = _fitted(rows, ("angle",), window_s, min_samples, max_window)
    status = F.when(F.col("reason").isNotNull(), "insufficient_contiguous_angle_samples")
    status = status.when(F.lit(bound is None) | (F.col("aliases") > 0), "alias_ambiguous").otherwise("unwrap_conditional_on_speed_bound")
    out = out.withColumn("angle_status", status)
    return out.withColumn("fit_angle", F.when(F.col("angle_status").startswith("unwrap"), F.col("fit_angle"))).drop("alias", "aliases")


def pixel_fallback(rows: DataFrame, window_s: float = 0.08, min_samples: int = 5) -> DataFrame:
    """rows with px, py, x, y, segment and sigma, and the derivatives of both: fit_x, fit_y in metres where there are world positions, and
    fit_px, fit_py; unit tells which of them speaks for the row."""
    metres = local_derivatives(rows.where("x IS NOT NULL AND y IS NOT NULL"), window_s, min_samples)
    metres = metres.select(*TRACK, "frame_index", "fit_x", "fit_y")
    pixels = _fitted(rows.withColumn("island", F.col("segment")), ("px", "py"), window_s, min_samples, 161)
    out = pixels.join(metres, [*TRACK, "frame_index"], "left")
    return out.withColumn("unit", F.when(F.col("fit_x").isNotNull(), "m").when(F.col("fit_px").isNotNull(), "px"))
