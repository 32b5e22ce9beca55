"""What follows an event, found in one pass over its period."""

import contextlib
import io

from plumbline.operators import sequence

SCHEMA = "event_id string, parent_event_id string, match_id string, period_id int, seconds_into_period double, source_index int, team_id string, event_type string, set_piece_type string"
DELIBERATE = ("PASS", "SHOT", "CLEARANCE", "DUEL", "RECOVERY")


def events():
    kinds = ["PASS", "BALL_OUT", "BALL_OUT", "DUEL", "INTERCEPTION"]
    # Moments repeat, some are unknown, and long stretches hold nothing deliberate.
    return [
        (str(i), str(i - 1) if i % 13 == 5 else None, str(i % 3), i % 2, None if i % 17 == 0 else float(i // 7), i, str(i % 4 // 2), "BALL_OUT" if 60 <= i < 110 else kinds[i * 7 % 5], "CORNER_KICK" if i % 5 == 0 else None)
        for i in range(180)
    ]


def test_by_brute_force(spark):
    rows, want = events(), {}
    for e in rows:
        own = [r for r in rows if r[2:4] == e[2:4] and r[1] is None]
        own.sort(key=lambda r: (r[4] is not None, r[4] or 0.0, r[5]))
        later = own[own.index(e) + 1 :] if e[1] is None else []
        at = lambda i, c: later[i][c] if len(later) > i else None  # noqa: E731, B023
        want[e[0]] = (next((r[6] for r in later if r[7] in DELIBERATE), None), at(0, 7), at(1, 8), at(1, 6))
    found = sequence.sequenced(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r["event_id"]: (r["next_action_team"], r["next_event_type"], r["restart_type"], r["restart_team"]) for r in found} == want


def test_no_frame_reaches_to_the_end(spark):
    """Spark reads such a frame anew for each event: quadratic in a period's events."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        sequence.sequenced(spark.createDataFrame(events(), SCHEMA)).explain()
    assert "unboundedpreceding" in text.getvalue().lower() and "unboundedfollowing" not in text.getvalue().lower()
