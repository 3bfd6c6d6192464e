"""Replay of edit logs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def active_edits(log: DataFrame, cursor: DataFrame | int) -> DataFrame:
    """The edits before the cursor: one number, or rows (project_id, cursor)."""
    if isinstance(cursor, int):
        return log.where(F.col("seq") < cursor)
    return log.join(cursor, "project_id").where(F.col("seq") < F.col("cursor")).drop("cursor")


def fold_log(ops: DataFrame) -> DataFrame:
    """(project_id, active, abandoned, cursor) from operations (project_id, n, op, edit): an edit drops what lies beyond the
    cursor into abandoned and is appended; undo and redo move the cursor within [0, length]. A fold over each project's
    ordered operations."""
    own = ops.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("n", "op", "edit"))).alias("ops"))
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("log"), none.alias("gone"), F.lit(0).alias("cursor"))

    def step(s: Column, o: Column) -> Column:
        cut = F.slice(s["log"], F.lit(1), s["cursor"])
        tail = F.slice(s["log"], s["cursor"] + 1, F.size(s["log"]))
        edit = F.struct(F.concat(cut, F.array(o["edit"])).alias("log"), F.concat(s["gone"], tail).alias("gone"), (s["cursor"] + 1).alias("cursor"))
        move = lambda c: F.struct(s["log"].alias("log"), s["gone"].alias("gone"), c.alias("cursor"))
        return F.when(o["op"] == "edit", edit).when(o["op"] == "undo", move(F.greatest(F.lit(0), s["cursor"] - 1))).otherwise(move(F.least(F.size(s["log"]), s["cursor"] + 1)))

    s = own.withColumn("s", F.aggregate("ops", start, step))
    return s.select("project_id", F.slice("s.log", F.lit(1), F.col("s.cursor")).alias("active"), F.col("s.gone").alias("abandoned"), F.col("s.cursor").alias("cursor"))


#: Frames of a bucket of edits; an edit over more than WIDE buckets is kept for its whole video.
PART, WIDE = 256, 64
#: What an edit may do.
KNOWN = ("swap_id", "set_id", "center", "marker", "angle", "exclude")


def _walk(edits: list[tuple]) -> dict:
    """For each track as a frame has it before any edit, the places of the edits (track_id, other_id, action) that hit its rows. Only the holders of an edit's
    tracks are touched by it, so the work is that of the edits and hits."""
    at, hits = {}, {}

    def holders(track) -> list:
        return [] if track is None else at.setdefault(track, [track])

    for i, (track, other, action) in enumerate(edits):
        if action not in KNOWN:
            continue
        mine = holders(track)
        theirs = holders(other) if action == "swap_id" and other != track else []
        for t in (*mine, *theirs):
            hits.setdefault(t, []).append(i)
        if other != track and action in ("swap_id", "set_id"):  # a track that becomes null is never hit again
            if track is not None:
                at[track] = theirs
            if other is not None:
                at[other] = mine if action == "swap_id" else [*holders(other), *mine]
    return hits


def _hits(own: str, track: T.DataType) -> Column:
    """array<struct<track_id, places>> from a frame's sorted edits."""

    def run(edits: pa.Array) -> pa.Array:
        out = []
        for e in edits:
            items = e.values
            out.append([{"track_id": t, "places": p} for t, p in _walk(list(zip(*(items.field(k).to_pylist() for k in range(3))))).items()])
        return pa.array(out, pa.list_(pa.struct([("track_id", edits.type.value_type.field(0).type), ("places", pa.list_(pa.int32()))])))

    ids = F.transform(own, lambda e: F.struct(e["track_id"].cast(track).alias("track_id"), e["other_id"].cast(track).alias("other_id"), e["action"].alias("action")))
    return F.arrow_udf(run, f"array<struct<track_id:{track.simpleString()},places:array<int>>>")(ids)


def apply_edits(obs: DataFrame, edits: DataFrame, after: str | None = None) -> DataFrame:
    """obs after an ordered replay of the edits (seq, video_id or null, frame_from, frame_to, action, track_id, other_id, nx,
    ny, n_radius, n_theta, and, if given, n_sigma and n_theta_sigma) whose range covers their frame; edit_ids lists those that
    changed a row.

    Actions: swap_id, set_id, center (new point and radius; the row is observed, its angle is invalidated, and its warning set
    aside), marker (the angle of the line from the centre to the new point, if that is 0.45 to 1.3 radii and 3 pixels off), angle,
    exclude (status missing). Where obs has position_sigma, theta_sigma, assignment_ambiguous and measurement_warning they
    change too, the old warning going to superseded_warning; where it has marker_x and marker_y, a new centre takes the
    angle of the marker that is there, and a marker's point stays.

    An edit goes to the track that the row has after earlier edits. Edits meet the frames that there are, those over few buckets of PART frames by bucket,
    longer ones by video; each frame's edits are walked once, in order, over what is at each track, and a row gets those that hit it, by its first track, and
    folds them. Rows that end with equal keys are left to an upsert. `after` names a column: only edits with a larger seq are
    replayed on its row."""
    more = {c: F.col(c) if c in edits.columns else F.lit(None).cast("double").alias(c) for c in ("n_sigma", "n_theta_sigma")}
    item = F.struct("seq", "frame_from", "frame_to", "action", "track_id", "other_id", "nx", "ny", "n_radius", "n_theta", *more.values()).alias("e")
    first, last, far = F.floor(F.col("frame_from") / PART), F.floor(F.col("frame_to") / PART), F.lit(-(2**62))
    by = ["video_id", "frame_index", *([after] if after else [])]
    frames = obs.select(*by).distinct()
    within = (F.col("e.frame_from") <= F.col("frame_index")) & (F.col("frame_index") <= F.col("e.frame_to"))
    within = within & (F.col("e.seq") > F.col(after)) if after else within
    parts = F.when(last - first > WIDE, F.array(far)).otherwise(F.sequence(first, last))
    own = edits.where("video_id IS NOT NULL").select("video_id", F.explode(parts).alias("edit_part"), item)
    met = frames.withColumn("edit_part", F.explode(F.array(F.floor(F.col("frame_index") / PART), far))).join(own, ["video_id", "edit_part"]).where(within)
    every = frames.join(edits.where("video_id IS NULL").select(item), within)  # edits of all videos
    told = met.select(*by, "e").unionByName(every.select(*by, "e")).groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("own"))
    found = told.withColumn("found", _hits("own", obs.schema["track_id"].dataType))
    hits = found.select(*[F.col(c).alias(f"hit_{c}") for c in by], F.explode(F.transform("found", lambda f: F.struct(f["track_id"].alias("track"), F.transform(f["places"], lambda i: F.get("own", i)).alias("here")))).alias("hit"))
    hits = hits.select(*[f"hit_{c}" for c in by], F.col("hit.track").alias("hit_track"), F.col("hit.here").alias("hit_edits"))
    same = F.col("video_id").eqNullSafe(F.col("hit_video_id")) & (F.col("track_id") == F.col("hit_track"))
    for c in by[1:]:
        same = same & (F.col(c) == F.col(f"hit_{c}"))
    rows, here = obs.join(hits, same, "left"), F.col("hit_edits")
    fields = ["track_id", "x", "y", "radius", "theta", "status", "source"]
    fields += [c for c in ("position_sigma", "theta_sigma", "assignment_ambiguous", "measurement_warning", "marker_x", "marker_y") if c in obs.columns]
    warned = "measurement_warning" in fields
    start = F.struct(*[F.col(c) for c in fields], *[F.lit(None).cast("string").alias("superseded_warning")] * warned, F.array().cast("array<bigint>").alias("edit_ids"))
    kinds = {c: obs.schema[c].dataType for c in fields} | ({"superseded_warning": T.StringType()} if warned else {}) | {"edit_ids": T.ArrayType(T.LongType())}
    start = start.cast(T.StructType([T.StructField(c, kind) for c, kind in kinds.items()]))  # an edit may make any of them null

    def step(s: Column, e: Column) -> Column:
        mine, others, a = F.coalesce(s["track_id"] == e["track_id"], F.lit(False)), F.coalesce(s["track_id"] == e["other_id"], F.lit(False)), e["action"]
        swap, center, marker, angle = (a == "swap_id") & (mine | others), (a == "center") & mine, (a == "marker") & mine, (a == "angle") & mine
        hits = swap | (mine & a.isin(*KNOWN))
        pick = lambda yes, new, old: F.when(yes, new).otherwise(old)
        x, y, radius = pick(center, e["nx"], s["x"]), pick(center, e["ny"], s["y"]), pick(center, F.coalesce(e["n_radius"], s["radius"]), s["radius"])
        # the marker's point, from the edit or the one that is there, and whether its distance makes an angle
        mx, my = (pick(marker, e[n], s[c] if c in fields else F.lit(None)) for n, c in (("nx", "marker_x"), ("ny", "marker_y")))
        far = F.sqrt((mx - x) * (mx - x) + (my - y) * (my - y))
        fits = F.coalesce((far >= F.greatest(F.lit(3.0), 0.45 * radius)) & ((radius <= 0) | (far <= 1.3 * radius)), F.lit(False))
        line = F.atan2(y - my, mx - x)
        theta = F.when(center, F.when(fits, line)).when(marker & fits, line).when(angle, e["n_theta"]).otherwise(s["theta"])
        new = {
            "track_id": F.when(swap, pick(mine, e["other_id"], e["track_id"])).when((a == "set_id") & mine, e["other_id"]).otherwise(s["track_id"]),
            "x": x, "y": y, "radius": radius, "theta": theta,
            "status": F.when(center, "observed").when((a == "exclude") & mine, "missing").otherwise(s["status"]), "source": pick(hits, F.lit("manual_corrected"), s["source"]),
        }
        if "position_sigma" in fields:
            new["position_sigma"] = pick(center, F.coalesce(e["n_sigma"], F.lit(1.0)), s["position_sigma"])
        if "theta_sigma" in fields:
            off = F.greatest(F.lit(0.01), 2**0.5 * (F.coalesce(new["position_sigma"], F.lit(1.0)) if "position_sigma" in new else F.lit(1.0)) / far)
            new["theta_sigma"] = F.when(center, F.when(fits, off)).when(marker & fits, off).when(angle, F.coalesce(e["n_theta_sigma"], F.lit(0.03))).otherwise(s["theta_sigma"])
        if "assignment_ambiguous" in fields:
            new["assignment_ambiguous"] = pick(center, F.lit(False), s["assignment_ambiguous"])
        if warned:
            new["measurement_warning"] = pick(center, F.lit(None).cast("string"), s["measurement_warning"])
            new["superseded_warning"] = pick(center, s["measurement_warning"], s["superseded_warning"])
        for c, point in (("marker_x", mx), ("marker_y", my)):
            if c in fields:
                new[c] = F.when(center, F.when(fits, point)).when(marker & fits, point).otherwise(s[c])
        new["edit_ids"] = pick(hits, F.concat(s["edit_ids"], F.array(e["seq"])), s["edit_ids"])
        return F.struct(*[new[c].alias(c) for c in (*fields, *["superseded_warning"] * warned, "edit_ids")])

    rows = rows.withColumn("s", F.when(here.isNull(), start).otherwise(F.aggregate(here, start, step)))
    rest = [c for c in obs.columns if c not in fields]
    return rows.select(*rest, "s.*")


def insert_edits(obs: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows that insert edits add at exactly their frame, with all later edits replayed on them. Upsert them by key."""
    new = edits.where("action = 'insert'").select(
        "video_id", F.col("frame_from").alias("frame_index"), "track_id", F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("n_radius").alias("radius"),
        F.lit(None).cast("double").alias("theta"), F.lit("observed").alias("status"), F.lit("manual_corrected").alias("source"), F.col("seq").alias("inserted"),
    )
    tag = new.withColumn("edit_base", F.col("inserted"))
    later = edits.where("action <> 'insert'")
    out = apply_edits(tag, later, after="edit_base")
    return out.drop("edit_base", "inserted")


def replay_scope(log: DataFrame) -> DataFrame:
    """(video_id, track_id, segments) from scope edits (video_id, track_id, seq, kind, frame): exit closes the segment that
    holds the frame and drops later ones, reentry opens one after a closed one, surface_exit splits off a tail without
    fitting, reset clears. Starts with one open segment from frame 0. A fold over each track's ordered edits."""
    own = log.groupBy("video_id", "track_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "frame"))).alias("ops"))
    seg = lambda a, b, fit: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), fit.alias("fit_enabled"))
    none = F.lit(None).cast("long")
    first = F.array(seg(F.lit(0), none, F.lit(True)))
    holds = lambda s, f: (s["start"] <= f) & (s["end"].isNull() | (s["end"] >= f))

    def step(s: Column, o: Column) -> Column:
        f = o["frame"]
        closed = F.transform(F.filter(s, lambda x: x["start"] <= f), lambda x: F.when(holds(x, f), seg(x["start"], f, x["fit_enabled"])).otherwise(x))
        can = ~F.exists(s, lambda x: x["end"].isNull() | (x["end"] >= f))
        opened = F.when(can, F.concat(s, F.array(seg(f, none, F.lit(True))))).otherwise(s)
        split = F.flatten(F.transform(s, lambda x: F.when(holds(x, f) & (x["start"] < f), F.array(seg(x["start"], f - 1, x["fit_enabled"]), seg(f, x["end"], F.lit(False)))).otherwise(F.array(x))))
        return F.when(o["kind"] == "exit", closed).when(o["kind"] == "reentry", opened).when(o["kind"] == "surface_exit", split).when(o["kind"] == "reset", first).otherwise(s)

    return own.select("video_id", "track_id", F.aggregate("ops", first, step).alias("segments"))


def trim_segments(segments: DataFrame, start: int, end: int) -> DataFrame:
    """Segments cut to [start, end]; empty ones dropped, open ends closed."""
    out = segments.withColumns({"start": F.greatest("start", F.lit(start)), "end": F.least(F.coalesce("end", F.lit(end)), F.lit(end))})
    return out.where(F.col("start") <= F.col("end"))
