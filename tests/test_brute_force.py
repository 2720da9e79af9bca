"""Randomised small tables against plain Python."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest

from movecheck.operators import renames, retention

DAY = date(2025, 1, 1)


@pytest.mark.parametrize("seed", range(4))
def test_retention(spark, seed):
    rng = random.Random(seed)
    users = [(u, DAY + timedelta(rng.randrange(12)), rng.choice(["a", "b", None])) for u in range(60)]
    users += rng.sample(users, 5)  # repeated rows count every time
    users += [(3, DAY + timedelta(9), "a"), (None, DAY, "b"), (77, None, "b")]
    events = [
        (rng.choice([1, 1, 1, rng.randrange(60), None]), datetime(2025, 1, 1) + timedelta(hours=rng.randrange(24 * 30)),
         rng.choice(["x", "y", "z"]))
        for _ in range(400)
    ]
    first, last = rng.choice([(0, 0), (2, 5), (7, 13)])
    window = rng.choice([None, (DAY + timedelta(2), DAY + timedelta(8))])
    active = {(u, t.date()) for u, t, name in events if name in ("x", "y")}
    expected = Counter(), Counter()
    for u, signup, seg in users:
        if window and not (signup and window[0] <= signup <= window[1]):
            continue
        expected[0][seg] += 1
        expected[1][seg] += any(
            signup and (u, signup + timedelta(d)) in active and u is not None for d in range(first, last + 1)
        )
    got = retention.cohort_retention(
        spark.createDataFrame(users, "u int, signup date, seg string"),
        spark.createDataFrame(events, "u int, ts timestamp, name string"),
        user="u", cohort="signup", ts="ts", event="name", qualifying=["x", "y"],
        first_day=first, last_day=last, by=["seg"], window=window,
    ).collect()
    assert {r.seg: (r.n, r.retained) for r in got} == {s: (expected[0][s], expected[1][s]) for s in expected[0]}


@pytest.mark.parametrize("seed", range(4))
def test_rename_detection(spark, seed):
    rng = random.Random(seed)
    cut, days, tolerance = date(2025, 2, 1), 5, rng.choice([0.1, 0.25, 0.6])
    rows = []
    for i in range(60):
        low, high = rng.choice([(-9, 0), (-9, 0), (0, 9), (0, 9), (-9, 9), (-9, -6), (6, 9)])
        for seg in rng.sample(["p", "q", None], rng.choice([1, 1, 1, 2])):
            rows += [
                (seg, f"e{i:02d}", datetime(2025, 2, 1) + timedelta(days=rng.randrange(low, high), hours=rng.randrange(24)))
                for _ in range(rng.randrange(1, 30))
            ]
    day = {k: [t.date() for s, e, t in rows if (s, e) == k] for k in {(s, e) for s, e, _ in rows}}

    def count(key, low, high):
        return sum(cut + timedelta(low) <= d < cut + timedelta(high) for d in day[key])

    expected = {}
    for seg, old in day:
        pre = count((seg, old), -days, 0)
        if not pre or count((seg, old), 0, 99):
            continue
        fits = []
        for other, new in day:
            post = count((other, new), 0, days)
            alone = sum(e == new for _, e in day) == 1
            if other == seg and alone and post and not count((other, new), -99, 0):
                if abs(post - pre) <= tolerance * pre:
                    fits.append((abs(post - pre), new, post))
        if fits:
            expected[(seg, old)] = (*min(fits)[1:], pre, len(fits))
    got = renames.detect_renames(
        spark.createDataFrame(rows, "seg string, name string, ts timestamp"),
        segment=["seg"], event="name", ts="ts", cutover=cut, days=days, tolerance=tolerance,
    ).collect()
    assert expected
    assert {(r.seg, r.old_event): (r.new_event, r.new_volume, r.old_volume, r.candidates) for r in got} == expected
