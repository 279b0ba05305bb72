"""Sessions against a plain version, with slices far smaller than sessions, streams without a break, ties and late events."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrier.llm import sessions as S

from . import brute

MINUTE = S.MINUTE
SCHEMA = "click_id long, us long, arrived_us long, client_id long, kind string, value double"
FIELDS = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path_sha256"]


def events(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"ts": F.timestamp_micros("us"), "arrived_at": F.timestamp_micros("arrived_us"), "slice": F.lit("clash"), "id": F.lit("x")})
    return df.drop("us", "arrived_us").repartition(3)


def stream(seed, clients, n, step, finals, late=0.05):
    """clients streams of n events, about ``step`` microseconds apart."""
    rng, rows = np.random.default_rng(seed), []
    for c in range(clients):
        us = np.cumsum(rng.exponential(step, n).astype(int))
        for t in us.tolist():
            for _ in range(1 + (rng.random() < 0.1)):  # ties
                slow = rng.random() < late
                rows.append((len(rows), t, None if rng.random() < 0.02 else t + int(61 * MINUTE if slow else 5), c, "purchase" if rng.random() < finals else "view", float(np.round(rng.normal(70, 30), 3))))
    rng.shuffle(rows)
    return [(int(i), t, a, c, k, v) for i, t, a, c, k, v in rows] + [(int(i), t, a, c, k, v) for i, t, a, c, k, v in rows[:20]]


def got(df):
    return sorted(tuple(r[f] for f in FIELDS) for r in df.collect())


@pytest.mark.parametrize(("seed", "step", "finals", "share"), [(1, 4 * MINUTE, 0.2, 40), (2, MINUTE, 0.0, 60), (3, 9 * MINUTE, 0.02, 30), (4, MINUTE, 0.02, 200), (5, 12 * MINUTE, 0.1, 1)])
def test_sessions_of_cut_streams(spark, seed, step, finals, share):
    rows = stream(seed, 3, 500, step, finals)
    want = sorted(brute.sessions(rows, 30 * MINUTE, 120 * MINUTE, 60 * MINUTE))
    assert got(S.sessions(events(spark, rows), hot_share=share, least_rows=5)) == want


def test_slices_with_late_events_only_and_an_unbroken_stream(spark):
    rows = [(i, i * MINUTE, None, 1, None, None) for i in range(400)]
    rows += [(1000 + i, (400 + i) * MINUTE // 4, (900 + i) * MINUTE, 1, "purchase", 99.0) for i in range(300)]
    rows += [(5000 + i, 3 * i, 61 * MINUTE + 3 * i + 1, 2, "view", 1.0) for i in range(200)]  # late only: no session
    want = sorted(brute.sessions(rows, 30 * MINUTE, 120 * MINUTE, 60 * MINUTE))
    assert {w[0] for w in want} == {1}
    assert got(S.sessions(events(spark, rows), hot_share=50, least_rows=3)) == want


def test_odd_rows(spark):
    odd = [(1, 0, 0, 1, "purchase", 60.0), (2, 0, 0, 1, "view", None), (3, 0, 61 * MINUTE, 1, None, float("nan")), (4, None, 0, 1, "view", 1.0), (5, 9, 9, None, "view", 1.0), (None, 9, 9, 1, "view", 1.0)]
    odd += [(6, 30 * MINUTE, 0, 1, "purchase", float("inf")), (7, 30 * MINUTE + 1, None, 1, "purchase", 59.999), (7, 30 * MINUTE + 1, None, 1, "purchase", 59.999), (8, 31 * MINUTE, 0, 9, "purchase", -1.005)]
    for rows in (odd, odd[:0]):
        want = sorted(brute.sessions(rows, 30 * MINUTE, 120 * MINUTE, 60 * MINUTE))
        for share, least in ((1000, 1000), (100, 1)):
            assert got(S.sessions(events(spark, rows), hot_share=share, least_rows=least)) == want


def test_times_without_a_zone_are_taken_as_they_stand(spark):
    df = spark.sql("select timestamp_ntz'2024-03-31 02:30:00.123456' t, timestamp_ntz'1969-12-31 23:59:59.5' u")
    assert tuple(df.select(S.micros(df, "t"), S.micros(df, "u")).first()) == (1711852200123456, -500000)
