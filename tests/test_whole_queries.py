"""Queries over whole tables: every row takes part."""

import datetime
import os

from axonflow.operators import stats
from axonflow.plans import registry, views

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_queries_take_all_rows(spark):
    run = lambda name: registry.queries()[name](spark, DATA)
    events, vectors = spark.read.parquet(f"{DATA}/events.parquet").count(), spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    for name in ("m1_sorted_events", "j3_phase_at_events", "s5_read_notes"):
        assert run(name).count() == events, name
    for name in ("a29_footprint_outline", "a31_unit_summary"):
        assert run(name).select("recording_id", "unit_id").distinct().count() == vectors, name
    black = run("a30_blacked_out")
    assert black.count() == vectors and 0 < black.where("mean != 0").count()
    assert {r["frame_idx"] for r in run("a30_activity_movie").select("frame_idx").distinct().collect()} == set(range(64))


def test_random_queries_take_the_default_numbers_of_draws(spark, monkeypatch):
    run = lambda name: registry.queries()[name](spark, DATA)
    assert {r["n_surrogates"] for r in run("u2_permutation_test").collect()} == {1000}
    for name in ("w15_jitter", "w16_shift", "w17_shuffle_intervals", "w18_poisson"):
        assert run(name).select("replicate").distinct().count() == 1000, name
    seen = []
    monkeypatch.setattr(stats, "bootstrap_interval", lambda *a, **b: seen.append(b))
    run("a23_bootstrap_interval")
    assert "draws" not in seen[0]


def test_hours_before_and_after_the_thirty_days_stay(spark, tmp_path):
    at = lambda t: datetime.datetime.fromisoformat(t)
    rows = [(1, at("2023-12-31 22:30:00"), 1, "a", 2.0), (2, at("2024-01-01 00:10:00"), 1, "a", 3.0), (3, at("2024-02-01 01:00:00"), 1, "a", 5.0), (4, at("2024-01-05 00:00:00"), 1, "b", 7.0), (5, None, 1, "c", 7.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    hours = {(r["recording_id"], r["idx"]): r["value"] for r in views.hourly(spark, str(tmp_path)).collect()}
    assert (hours["a", -2], hours["a", 0], hours["a", 745], hours["b", 96]) == (2.0, 3.0, 5.0, 7.0)
    assert [sum(k[0] == x for k in hours) for x in "abc"] == [748, 720, 720]
    found = registry.queries()["j3_phase_at_events"](spark, str(tmp_path)).collect()
    assert {r["event_id"]: r["value"] for r in found} == {1: 2.0, 2: 3.0, 3: 5.0, 4: 7.0}
