"""Row predicates and scalar columns of observation tables. All are plain Catalyst expressions."""

from __future__ import annotations

import itertools

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_DATA = ("missing", "predicted_only", "outside_interval")
PREDICTIONS = ("tracking_prediction", "physics_prediction")
TAU = 2 * math.pi


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def cleaned(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(finite(c), c)


def live(status: str = "status") -> Column:
    """Rows that are data at all."""
    return ~F.coalesce(F.col(status).isin(*NOT_DATA), F.lit(False))


def usable(world: bool = True, time: bool = True, orientation: bool = False) -> Column:
    """Hard blockers only; quality warnings never reject. A null flag passes, a null position or time does not."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    out = live() & no(F.col("source").isin(*PREDICTIONS)) & no(F.col("assignment_ambiguous")) & no(F.col("identity_status") == "ambiguous")
    out = out & no(~F.col("observable")) & no(F.col("surface_status") == "floor_boundary")
    out = out & (finite(F.col("x")) & finite(F.col("y")) if world else finite(F.col("px")) & finite(F.col("py")))
    if time:
        out = out & finite(F.col("t_s"))
    if orientation:
        out = out & finite(F.col("theta"))
    return out


def warnings(inherited: Column | None = None) -> Column:
    """Sorted distinct warnings: inherited ones, the measurement's, and a status that is itself a warning."""
    own = F.array(F.col("measurement_warning"), F.when(F.col("status").isin("low_confidence", "partially_observed"), F.col("status")))
    every = own if inherited is None else F.concat(F.coalesce(inherited, F.array().cast("array<string>")), own)
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def wrap(angle: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(TAU)) - math.pi


def direction(vx: Column, vy: Column, sx: Column, sy: Column) -> Column:
    """The heading, where the speed is over three times its standard error."""
    return F.when(F.hypot(vx, vy) > 3 * F.hypot(sx, sy), F.atan2(vy, vx))


def presentation_time(pts: Column, num: Column, den: Column) -> Column:
    return pts * num / den


def exposure_midpoint(physical: Column, exposure: Column, reference: Column) -> Column:
    """The middle of the exposure when the time is of its start, end or middle; null if that is not known."""
    shift = F.when(reference == "start", exposure / 2).when(reference == "end", -exposure / 2).when(reference == "midpoint", F.lit(0.0))
    return physical + shift


def inertia(model: Column, mass: Column, radius: Column, given: Column) -> Column:
    return F.when(model == "uniform_disk", 0.5 * mass * radius * radius).otherwise(given)


def fused_angle(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    """Weighted circular mean of up to two angles; null if they disagree by more than max(0.18, 4 sigma)."""
    both = a.isNotNull() & b.isNotNull()
    apart = F.abs(wrap(a - b)) > F.greatest(F.lit(0.18), 4 * F.sqrt(1 / wa + 1 / wb))
    mean = F.atan2(wa * F.sin(a) + wb * F.sin(b), wa * F.cos(a) + wb * F.cos(b))
    return F.when(both & apart, None).when(both, mean).otherwise(F.coalesce(a, b))


def whitened(r: list[Column], cov: list[list[Column]]) -> Column:
    """The squared whitened residual of 2 components with a full covariance, or of the one that is there.

    Null if the covariance is not positive definite or no component is there."""
    (a, b), (_, d) = cov
    det = a * d - b * b
    full = (d * r[0] * r[0] - 2 * b * r[0] * r[1] + a * r[1] * r[1]) / det
    x, y = finite(r[0]), finite(r[1])
    return F.when(x & y, F.when((a > 0) & (det > 0), full)).when(x, F.when(a > 0, r[0] * r[0] / a)).when(y, F.when(d > 0, r[1] * r[1] / d))


def whiten(r: list[Column], cov: list[list[Column]]) -> Column:
    """struct(q, problem): the squared whitened residual of up to three components with their covariance, by its Cholesky factor. Components that are not there leave the
    principal submatrix of the others. problem is no_component or not_positive_definite, and q then null."""
    there = [finite(x) for x in r]
    null, out = F.lit(None).cast("double"), F.struct(F.lit(None).cast("double").alias("q"), F.lit("no_component").alias("problem"))
    for own in (s for n in range(1, len(r) + 1) for s in itertools.combinations(range(len(r)), n)):
        low: dict[tuple[int, int], Column] = {}
        z: list[Column] = []
        good = F.lit(True)
        for i, a in enumerate(own):
            for j, b in enumerate(own[:i]):
                low[i, j] = (cov[a][b] - sum((low[i, k] * low[j, k] for k in range(j)), F.lit(0.0))) / low[j, j]
            left = cov[a][a] - sum((low[i, k] * low[i, k] for k in range(i)), F.lit(0.0))
            good = good & F.coalesce(left > 0, F.lit(False))
            low[i, i] = F.sqrt(F.when(left > 0, left))
            z.append((r[a] - sum((low[i, k] * z[k] for k in range(i)), F.lit(0.0))) / low[i, i])
        q = sum((x * x for x in z), F.lit(0.0))
        case = F.lit(True)
        for i, x in enumerate(there):
            case = case & (x if i in own else ~x)
        out = F.when(case, F.struct(F.when(good, q).otherwise(null).alias("q"), F.when(~good, "not_positive_definite").alias("problem"))).otherwise(out)
    return out


def to_world(px: Column, py: Column, h: list[Column]) -> tuple[Column, Column]:
    """Pixels through a plane homography of nine columns, row by row; null where it is singular."""
    w = h[6] * px + h[7] * py + h[8]
    ok = F.abs(w) >= 1e-12
    return F.when(ok, (h[0] * px + h[1] * py + h[2]) / w), F.when(ok, (h[3] * px + h[4] * py + h[5]) / w)


def to_world_cov(px: Column, py: Column, sigma: Column, h: list[Column], step: float = 0.01) -> tuple[Column, Column, Column]:
    """Variances and covariance of a projected point, by a numeric Jacobian with probes of `step` pixels."""
    x0, y0 = to_world(px, py, h)
    x1, y1 = to_world(px + step, py, h)
    x2, y2 = to_world(px, py + step, h)
    jxx, jyx, jxy, jyy = (x1 - x0) / step, (y1 - y0) / step, (x2 - x0) / step, (y2 - y0) / step
    v = sigma * sigma
    return v * (jxx * jxx + jxy * jxy), v * (jyx * jyx + jyy * jyy), v * (jxx * jyx + jxy * jyy)


def to_world_height(px: Column, py: Column, m: list[Column], camera: tuple[Column, Column, Column], height: Column) -> tuple[Column, Column]:
    """Where the ray through a pixel meets the plane z = height: m holds the nine columns that turn (px, py, 1) into a direction in the
    world, camera its centre. Null for parallel rays and planes behind the camera."""
    dx, dy, dz = (m[3 * k] * px + m[3 * k + 1] * py + m[3 * k + 2] for k in range(3))
    cx, cy, cz = camera
    s = F.when(F.abs(dz) >= 1e-12, (height - cz) / dz)
    ok = F.coalesce(s > 0, F.lit(False))
    return F.when(ok, cx + s * dx), F.when(ok, cy + s * dy)
