"""Queries on tables that the given ones do not look like, against their SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

from axonflow.plans import registry


def check(spark, folder, name, con=None):
    con = con or duckdb.connect()
    df = registry.queries()[name](spark, str(folder))
    got = df.collect()
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    have, want = order([tuple(plain(r[c]) for c in columns) for r in got]), order([tuple(plain(v) for v in r) for r in cursor.fetchall()])
    assert have == want
    return have


def view(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["a17_regression", "a18_effective_n", "a18_robust_correlation", "m8_fisher_interval", "m9_correlation_p"])
def test_subjects_of_few_days_or_constant_sides(spark, tmp_path, name):
    start, rows = datetime.datetime(1995, 1, 1), []
    for g in range(1, 15):
        for j in range(g):
            day = j // 2 if g % 3 == 0 and j > 1 else j
            rows.append((len(rows), 100 * g, 100.25 if g % 4 == 0 else 50.0 + len(rows) * 37 % 101, start + datetime.timedelta(days=day), "1-URGENT"))
    con = view(spark, tmp_path, "orders", rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    assert len(check(spark, tmp_path, name, con)) == 14


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def hours(pairs, kind="a"):
    """Events at hours of users from 2024-01-01: (user, hour, value)."""
    return [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h, minutes=10 if h > 0 else 0), u, kind, v) for i, (u, h, v) in enumerate(pairs)]


def laid_out_under_broadcasts(df) -> int:
    """Broadcasts in the first plan of rows that ``explode`` has laid out, whose number Spark does not foresee."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = 0
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for other in lines[i + 1 :]:
                if depth(other) <= depth(line):
                    break
                if "Aggregate" in other:
                    break
                below.append(other)
            found += any("Generate explode(sequence" in b for b in below)
    return found


@pytest.mark.parametrize("name", ["a4_frame_window_average", "a1_peri_event", "p9_signal_statistics", "p8_cross_correlation", "f13_complete_pairs"])
def test_rows_laid_out_are_not_broadcast(spark, name):
    assert laid_out_under_broadcasts(registry.queries()[name](spark, "/root/testdata/sf0.001")) == 0


def test_samples_of_bursts_are_not_broadcast(spark):
    from axonflow.operators import spectral

    for recording in (spark.range(0, 3000), spark.range(-1500, 1500)):
        samples = recording.selectExpr("'r' AS recording_id", "id AS idx", "IF(pmod(id, 400) < 60, sin(id * 0.6), 0) + sin(id * id) / 9 AS value")
        found = spectral.oscillatory_events(samples, ["recording_id"], 1.0, (0.05, 0.2), (1.0, 10.0), (2.0, 90.0), 2.0)
        assert laid_out_under_broadcasts(found) == 0
        rows = found.collect()
        assert len(rows) >= 5 and all(r["start"] <= r["peak_time"] <= r["end"] for r in rows)


def test_neighbours_share_the_hours_that_both_have(spark, tmp_path):
    rows = hours([(1, -3, 2.0), (1, 5, 3.0), (2, -2, 5.0), (2, 725, 1.0), (3, 730, 4.0), (3, 722, 9.0), (7, 1, 1.0)])
    con = view(spark, tmp_path, "events", rows, EVENTS)
    from axonflow.plans import views

    both = views.user_neighbours(spark, str(tmp_path))
    found = {(r["recording_id"], r["idx"]): (r["x"], r["y"]) for r in both.collect()}
    want = con.execute(f"WITH {views.USER_FILLED} SELECT a.recording_id, a.idx, a.value, b.value FROM filled a JOIN filled b ON a.idx = b.idx AND CAST(b.recording_id AS BIGINT) = CAST(a.recording_id AS BIGINT) + 1").fetchall()
    assert both.count() == len(want) and found == {(r, i): (x, y) for r, i, x, y in want}
    check(spark, tmp_path, "f13_complete_pairs", con)


def test_many_events_on_one_sample_keep_their_deviation(spark, tmp_path):
    rows = hours([(1, h, 1e6 + h % 7) for h in range(0, 60, 2)] + [(1, 30, 1e6 + 2)] * 5)
    con = view(spark, tmp_path, "events", rows, EVENTS)
    check(spark, tmp_path, "a4_frame_window_average", con)
    assert len(check(spark, tmp_path, "a2_event_triggered_average", con)) == 13


@pytest.mark.parametrize("name", ["w9_unit_events", "s15_unit_event_document"])
def test_unit_events_of_flat_differences_and_long_ids(spark, tmp_path, name):
    far = 10**17
    rows = hours([(u, h, v) for u in (1, 12, far + 9, far + 10) for h, v in ((3, 20.0), (4, 40.0), (9, 30.0), (15, 12.5), (16, 25.0))])
    con = view(spark, tmp_path, "events", rows, EVENTS)
    assert check(spark, tmp_path, name, con)


def test_groups_over_many_batches_are_each_guarded(spark):
    from axonflow.sources import results

    def half(g):
        if len(g) % 2:
            raise ValueError("odd")
        return g.assign(n=len(g))[["subject", "n"]].head(1)

    sizes = {None: 3, 1: 2500, 2: 7, 3: 2000, 10**17 + 1: 4}
    rows = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "subject long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        plan = results.guarded(rows, ["subject"], half, "subject long, n long", "halves")
        got = {r["subject"]: (r["n"], r["status"], r["reason"]) for r in plan.collect()}
        assert "FlatMapGroups" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: (n, "completed", None) if n % 2 == 0 else (None, "skipped", "ValueError: odd") for k, n in sizes.items()}


SPARSE = ["w13_suppress_artifacts", "w4_fill_missing", "a26_outlier_flags", "p3_phase_and_envelope", "p7_coherence", "p8_cross_correlation", "p10_coherogram", "p11_wavelet_transform"]


@pytest.mark.parametrize("name", SPARSE)
def test_empty_hours_are_not_laid_out_as_rows(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence(_start" not in plan and "Window" in plan


@pytest.mark.parametrize("name", SPARSE)
def test_sparse_signals_match_their_sql(spark, tmp_path, name):
    early, late = name not in ("p7_coherence", "p10_coherogram"), name not in ("p7_coherence", "p10_coherogram", "p11_wavelet_transform")  # their SQL has 30 days
    ends = [(4, -30 if early else 0, 7.0), (5, -1 if early else 1, 3.0), (4, 731 if late else 719, 90.0), (5, 800 if late else 640, 5.0)]
    rows = [(1, h, 100.0 if h % 5 == 0 else 3.0 * (h % 11)) for h in range(0, 720, 1)] + [(2, h, float(h * 7 % 130)) for h in range(0, 719, 3)]
    rows += [(3, h, 200.0 - h % 3) for h in (0, 1, 4, 9, 13, 14, 300, 303, 307, 715, 717)] + ends + [(u, h, float(h * h % 59 + 1)) for u in (4, 5, 9) for h in range(40, 260)] + [(9, 400, 75.5)]
    con = view(spark, tmp_path, "events", hours(rows), EVENTS)
    assert check(spark, tmp_path, name, con)
