"""Edits are walked once for each frame, not once for each row."""

import random

from trackmill.operators import edits
from trackmill.plans import QUERIES


def test_walk_hits_what_a_loop_over_rows_hits():
    rng = random.Random(5)
    for _ in range(300):
        log = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 1, 2, 3, 4]), rng.choice([*edits.KNOWN, "swap_id", "set_id", "insert", None])) for _ in range(rng.randrange(12))]
        got = edits._walk(log)
        for first in (1, 2, 3, 4, 5):
            now, want = first, []
            for i, (track, other, action) in enumerate(log):
                mine, theirs = now is not None and now == track, now is not None and now == other
                if action in edits.KNOWN and (mine or (theirs and action == "swap_id")):
                    want.append(i)
                    now = (other if mine else track) if action == "swap_id" else other if action == "set_id" else now
            assert got.get(first, []) == want, log


def test_no_row_filters_the_edits_of_its_frames(spark, small):
    """Before, each row filtered and folded all edits of its video and 256 frames, which grew with the square of the tracks."""
    plan = QUERIES["d2_apply_edits"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "filter(concat(" not in plan
