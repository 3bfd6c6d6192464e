"""Pairs in cells of blocks, and what is looked up for their tracks."""

import random
from types import SimpleNamespace

import duckdb
import numpy as np
from pyspark.sql import functions as F

from trackmill.operators import cells, pairs, quality, segments, trials
from trackmill.plans import QUERIES
from trackmill.streaming import ingest, timing

SCHEMA = "video_id long, frame_index long, track_id long, x double, y double, radius double, status string"


def crowd(spark, tracks=260, frames=30):
    """Enough tracks for several blocks, some places unknown, some rows missing, and a video of one track."""
    rng = random.Random(11)
    own = []
    for t in range(tracks):
        for f in range(frames):
            if rng.random() < 0.4:
                x = None if rng.random() < 0.03 else rng.uniform(0, 250)
                own.append((1, f, t, x, rng.uniform(0, 100), 10.0, "missing" if rng.random() < 0.1 else "observed"))
    return spark.createDataFrame([*own, (2, 0, 5, 1.0, 1.0, 10.0, "observed")], SCHEMA)


def test_cells_find_the_events_of_joined_pairs(spark):
    df = crowd(spark)
    every = pairs.frame_pairs(df).select("video_id", "a", "b").distinct()
    want = sorted(map(tuple, pairs.pair_events(df, only=every).collect()))
    got = sorted(map(tuple, pairs.pair_events(df).collect()))
    assert got == want and len(got) > 5_000 and any(r[-2] > 1 for r in got)


def test_few_meetings_are_picked(spark):
    """Tracks that are seldom there at once: rows of a frame are picked instead of looked through."""
    own = [(1, t * 50 + f, t, 0.0, 0.0, 10.0, "observed") for t in range(220) for f in range(51)]
    got = pairs.pair_events(spark.createDataFrame(own, SCHEMA)).collect()
    assert sorted((r.a, r.b, r.closest_frame) for r in got) == [(t, t + 1, 50 * t + 50) for t in range(219)]


def test_pairs_of_frames_are_dealt_over_all_partitions(spark):
    """Before, a few tasks had all pairs: partitions were put together by the bytes of their rows."""
    assert pairs.frame_pairs(crowd(spark)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_no_query_sorts_all_pairs(spark, small):
    """Before, a window over each pair's rows sorted and spilled all pairs of a video."""
    for name in ("a13_event_id", "g7_pair_events", "g3_barriers", "f1_run_report"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().toString()
        assert "lag(near" not in plan and "MapInArrow" in plan, name


def test_no_query_numbers_events(spark, small):
    """Before, events were numbered by a window over each video."""
    for name in ("e5_contact_graph", "e6_supporting_rows", "a14_review_basis", "b12_reject_noncontact"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().toString()
        assert "lag(near" not in plan and not any("row_number()" in x and "closest_frame" in x for x in plan.split("\n")), name


def test_streamed_cells_send_the_events_of_the_batch(spark, tmp_path):
    """Before, each pair was a key of state and each of its rows a row of the stream."""
    df = crowd(spark, 230, 30)
    rows = cells.blocked(cells.ready(df), df).withColumn("ts", F.timestamp_seconds(F.col("frame_index") + 1)).persist()
    assert rows.agg(F.max("blocks")).first()[0] > 1
    for low, high in ((0, 9), (9, 10), (10, 30)):
        rows.where(F.col("frame_index").between(low, high - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = rows.limit(1).withColumns({"video_id": F.lit(-1).cast("long"), "ts": F.timestamp_seconds(F.lit(10**6))})
    last.unionByName(last.withColumn("ts", F.timestamp_seconds(F.lit(2 * 10**6)))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = ingest.read_stream(spark, f"{tmp_path}/in", rows.schema, 1).withWatermark("ts", "0 seconds")
    timing.cell_events_stream(source, idle_ms=1000_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    names = ["a", "b", "frame_start", "frame_end", "closest_frame", "min_gap", "n_near"]
    got = spark.read.parquet(f"{tmp_path}/out")
    want = pairs.pair_events(df).select(*names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.collect())) and {r[0] for r in got.select("closed_by").distinct().collect()} == {"row", "idle"}


def test_state_of_a_cell_is_that_of_the_last_frames(spark):
    """Before, the last event of each pair stayed in the state until the pair came again."""
    df = crowd(spark, 120, 60)
    own = cells.each_cell(cells.blocked(cells.ready(df), df)).where("video_id = 1").withColumn("ts", F.timestamp_seconds("frame_index")).toPandas()
    cut, sent, most, total = {}, [], 0, 0

    class Value(dict):
        exists = lambda self: "v" in self
        get = lambda self: self["v"]
        update = lambda self, v: self.__setitem__("v", v)

    for low in range(0, 60, 10):
        for key, rows in own[own.frame_index.between(low, low + 9)].groupby(list(cells.CELL)):
            state = cut.setdefault(key, Value())
            walk = timing.CellEvents(2, 8, None)
            walk.init(SimpleNamespace(getValueState=lambda *_, state=state: state))
            for out in walk.handleInputRows(key, iter([rows]), None):
                sent += list(out.drop(columns=["kind", "closed_by", "video_id"]).itertuples(index=False, name=None))
        held = [np.frombuffer(s.get()[0], timing.OPEN) for s in cut.values() if s.exists()]
        assert all((h["end"] >= low + 10 - 4).all() for h in held)
        most = max(most, sum(map(len, held)))
    names = ["a", "b", "frame_start", "frame_end", "closest_frame", "min_gap", "n_near"]
    sent += [tuple(x[c] for c in ("u", "v", "start", "end", "closest", "least", "n")) for h in held for x in h]
    key = lambda r: (min(r[:2]), max(r[:2]), *r[2:])
    assert sorted(map(key, sent)) == sorted(map(tuple, pairs.pair_events(df).select(*names).collect())) and most < len(sent) / 8


def test_barriers_leave_their_cells_once(spark, small):
    """Before, each event left its cell and was exploded."""
    df = crowd(spark)
    e = pairs.pair_events(df).selectExpr("*", "array(a, b) AS pair", "IF(n_near > 1, struct(closest_frame AS from, closest_frame + 1 AS to), NULL) AS boundary", "CAST(NULL AS struct<from:bigint,to:bigint>) AS contact", "CAST(NULL AS array<struct<from:bigint,to:bigint>>) AS unusable")
    want = sorted(map(tuple, segments.event_barriers(e).collect()))
    assert sorted(map(tuple, cells.barriers(df).collect())) == want and len(want) > 1_000
    assert "closest_frame" not in QUERIES["g3_barriers"](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_counts_are_those_of_the_events(spark):
    """Whatever number of frames is counted together, with frames missing from the whole video and tracks named by text."""
    df = crowd(spark, 120, 60).where("frame_index % 11 NOT IN (3, 4) AND frame_index NOT BETWEEN 40 AND 47")
    every = pairs.frame_pairs(df).select("video_id", "a", "b").distinct()
    for gap, frames in ((2, cells.FRAMES), (2, 5), (0, 3), (5, 1)):
        want = pairs.pair_events(df, gap, only=every).groupBy("video_id", "a").count()
        got = cells.counts(df, gap, frames).groupBy("video_id", "track_id").agg(F.sum("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100, (gap, frames)
    named = df.withColumn("track_id", F.format_string("t%03d", "track_id"))
    assert cells.counts(named).agg(F.sum("n")).first() == cells.counts(df).agg(F.sum("n")).first()


def test_report_of_counts_is_that_of_events(spark):
    df = crowd(spark, 120, 20).selectExpr("*", "frame_index * 1.0D AS t_s", "'observation' AS source", "'ok' AS identity_status", "false AS assignment_ambiguous", "true AS observable", "'inside_floor' AS surface_status", "CAST(NULL AS string) AS measurement_warning")
    t = df.selectExpr("video_id", "x AS vx", "CAST(NULL AS double) AS omega", "false AS uses_warned")
    report = lambda events, a, *n: sorted(map(tuple, quality.run_report(df, t, events.select("video_id", (F.col(a) % 2 == 0).alias("fit_eligible"), *n)).select("video_id", "event_candidates", "eligible_events").collect()))
    got = report(cells.counts(df), "track_id", "n")
    assert got == report(pairs.pair_events(df), "a") and got[0][1] > got[0][2] > 100 and got[1] == (2, 0, 0)


def test_report_sends_rows_once_or_twice(spark, small, tmp_path, monkeypatch):
    """However many tracks there are: before, a row went to as many cells as its video had blocks, and each event was a row."""
    duckdb.sql(f"COPY (SELECT event_id + i * 1000 AS event_id, ts, user_id + i * 20 AS user_id, event_type, value, props FROM '{small}/events.parquet', range(200) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    sent, frame = [], type(spark.range(1))
    own = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: (sent.append(self.count()), own(self, *a, **k))[1])
    plan = QUERIES["f1_run_report"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < sent[0] <= 1.3 * 200_000 and "block_i" not in plan and "min_gap" not in plan


def test_ranges_by_frame_are_those_of_joined_pairs(spark):
    """Whatever number of frames a part has, with frames missing from the whole video, and long events at its end."""
    rng = random.Random(3)
    long = [(3, f, t, 5.0 * t, float(f % 2), 10.0, "observed") for f in range(45) for t in range(6) if rng.random() < 0.85]
    ends = [(4, f, t, 5.0 * t + (90 if f in late else 0), 0.0, 10.0, "observed") for t, late in ((0, ()), (1, (12,)), (2, (14,)), (3, ())) for f in range(15) if (t, f) != (3, 13)]
    df = crowd(spark, 90, 60).where("frame_index % 11 NOT IN (3, 4) AND frame_index NOT BETWEEN 40 AND 47").unionByName(spark.createDataFrame(long + ends, SCHEMA)).persist()
    every = pairs.frame_pairs(df).select("video_id", "a", "b").distinct()
    for gap, persistent, frames in ((2, 8, cells.FRAMES), (2, 3, 1), (0, 2, 5), (4, 8, 1)):
        want = pairs.pair_events(df, gap, persistent, only=every).persist()
        chains = cells.chain_events(df, gap, persistent, frames)
        assert sorted(map(tuple, chains.collect())) == sorted(map(tuple, want.where("n_near > 1").collect())), (gap, persistent, frames)
        got = cells.frame_ranges(df, chains, gap, frames)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cells.ranges(want).select(got.columns).collect())), (gap, persistent, frames)


def test_contacts_and_counts_come_by_frame(spark, small):
    """Before, all events left their cells so that their ranges were found, and were found again."""
    more = ("'observation' AS source", "'ok' AS identity_status", "false AS assignment_ambiguous", "true AS observable", "'inside_floor' AS surface_status", "0.0D AS t_s")
    df = crowd(spark, 100, 40).selectExpr("*", *more).persist()
    want = trials.reject_pair_noncontact(df, 0.2, 230.0, 40).groupBy("video_id", "kind").count()
    got = sorted(map(tuple, trials.count_pair_noncontact(df, 0.2, 230.0, 40).collect()))
    assert got == sorted(map(tuple, want.collect())) and {r[1] for r in got} >= {"unmeasurable", "noncontact_pass"}
    for name, most in (("e5_contact_graph", 1), ("e6_supporting_rows", 1), ("b12_reject_noncontact", 0)):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("RepartitionByExpression" in x and "block_i" in x for x in plan.split("\n")) <= most, name
