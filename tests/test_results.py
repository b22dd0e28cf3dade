"""Results that SQL comparisons with tolerance do not settle: last digits, rounding."""

import os
import random
from fractions import Fraction

import duckdb
import pytest

from recollect import catalog
from recollect.operators import results as R

SF = "/root/testdata/sf0.01"


def test_brier_score_does_not_depend_on_partitions(spark):
    r = random.Random(3)
    data = [(r.random() ** 3, r.random() < 0.4) for _ in range(5000)]
    want = float(sum((Fraction(p) - y) ** 2 for p, y in data) / len(data))
    df = spark.createDataFrame(data, "predicted double, correct boolean")
    seen = {R.calibration_errors(df.repartition(k)).first()["brier"] for k in (1, 3, 7, 16)}
    assert len(seen) == 1 and seen.pop() == pytest.approx(want, rel=1e-15)
    odd = R.calibration_errors(spark.createDataFrame([(0.5, True), (None, True), (0.25, None)], df.schema)).first()
    assert odd["brier"] == 0.25
    none = R.calibration_errors(df.where("predicted > 2")).first()
    assert none["brier"] is None and none["ece"] is None


# Rounding -----------------------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")
def test_tired_nodes_round_as_sql_does(spark):
    """To the last digit: a node's activation lies a hair from the middle between two results."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    want = dict(con.execute(catalog.oracle_sql()["tired_nodes"]).fetchall())
    assert {r["id"]: r["activation"] for r in catalog.queries()["tired_nodes"](spark, SF).collect()} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")
def test_replay_means_round_as_sql_does(spark):
    """Sums in the order of events, rounded as SQL rounds; SQL itself differs at most where the exact mean is halfway between two results."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    sql = dict(con.execute(catalog.oracle_sql()["replay_means"]).fetchall())
    want, halfway, so_far = {}, set(), {}
    for i, who in con.execute("SELECT event_id, user_id FROM events ORDER BY user_id, ts, event_id").fetchall():
        n, total, exact = so_far.get(who, (0, 0.0, Fraction(0)))
        k = i * 37 % 100
        n, total, exact = so_far[who] = (n + 1, total + (0.5 + 0.5 * k / 100), exact + Fraction(100 + k, 200))
        scaled = total / n * 1e6
        want[i] = (int(scaled) + (scaled - int(scaled) >= 0.5)) / 1e6
        if (exact / n * 10**6) % 1 == Fraction(1, 2):
            halfway.add(i)
    got = {r["id"]: r["mean"] for r in catalog.queries()["replay_means"](spark, SF).collect()}
    assert got == want
    assert {i for i in got if got[i] != sql[i]} <= halfway
