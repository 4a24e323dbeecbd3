"""Queries that write given tables as files of the sources' formats and read them back through the sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from axonflow.plans import views
from axonflow.plans.views import TRAINS, table
from axonflow.sources import results, sheets
from axonflow.sources.scratch import scratch_path


def s1(spark, d):
    path = scratch_path(spark, "sheet")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("line number"), F.col("c_name").alias("id"), F.lit("").alias(" "), F.concat(F.lit('say "'), "c_mktsegment", F.lit('", a')).alias("group"))
    c.write.csv(path, header=True, escape='"', emptyValue="")
    return sheets.read_sheet(spark, path).select(F.col("line number").cast("long").alias("c_custkey"), "id", F.length("group").alias("n"))


def s3_files(spark, d):
    path = scratch_path(spark, "metadata")
    rows = table(spark, d, "events").groupBy("event_type").agg(F.max("user_id").alias("user_id"))
    rows.select("event_type", F.concat(F.col("user_id").cast("string"), F.lit("FPS")).alias("frameRate"), F.lit(1).alias("device")).repartition(1).sortWithinPartitions("event_type").write.partitionBy("event_type").json(path)
    out = sheets.read_metadata(spark, f"{path}/event_type=*", "frameRate string, device long")
    return out.select("frameRate", "device")


def s4(spark, d):
    path = scratch_path(spark, "frames")
    views.trains(spark, d).select(F.col("event_id").alias("Frame Number"), F.round(F.col("t") / 1000, 3).alias("Time Stamp (ms)")).write.csv(path, header=True)
    return sheets.read_frame_times(spark, path).select("frame_idx", F.round("t", 6).alias("t"))


def s5(spark, d):
    """One sheet of notes for each unit, each written and read by itself, since the source takes one file."""
    path = scratch_path(spark, "notes")
    rows = views.trains(spark, d).select("unit_id", F.round(F.col("t") / 1000, 3), "recording_id")
    units = [r["unit_id"] for r in rows.select("unit_id").distinct().orderBy("unit_id").collect()]  # 8 at most
    rows.repartition("unit_id").write.partitionBy("unit_id").csv(path, header=True)
    sheet = lambda u: sheets.read_notes(spark, f"{path}/unit_id={u}").select("t", "label")
    notes = [sheet("__HIVE_DEFAULT_PARTITION__" if u is None else u) for u in units] or [spark.createDataFrame([], "t double, label string")]
    return reduce(lambda a, b: a.unionAll(b), notes).select(F.round("t", 6).alias("t"), "label")


def s8(spark, d):
    path = scratch_path(spark, "start")
    table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd"), "o_totalprice", "o_orderkey", "o_custkey").write.csv(path, header=False)
    out = sheets.read_start_time(spark, path)
    return out.select("time", F.round("acq_clk_hz", 2).alias("acq_clk_hz"), "block_read_sz", "block_write_sz")


def s9(spark, d):
    path = scratch_path(spark, "fifo")
    o = table(spark, d, "orders")
    o.select(F.col("o_orderkey").alias("Clock"), F.col("o_custkey").alias("Bytes"), F.round("o_totalprice", 2).alias("Percent")).write.csv(path, header=True)
    return sheets.read_fifo_use(spark, path).select("clock", "bytes", F.round("percent", 2).alias("percent"))


def s10(spark, d):
    """Nations are the subjects of the design, which is laid over all customers."""
    path = scratch_path(spark, "design")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.col("n_nationkey").cast("string").alias("s"))
    groups = n.groupBy("r_name").agg(F.sort_array(F.collect_list("s")).alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("r_name", "v"))).alias("drug_groups"))
    spans = n.select("s", F.lit([[0, 10], [15, 25]]).alias("w")).agg(F.map_from_entries(F.collect_list(F.struct("s", "w"))).alias("selections"))
    both = groups.crossJoin(spans).withColumn("no_drug_conditions", F.array(F.lit("ASIA")))  # one row each
    both.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(path)
    conditions, windows = sheets.read_design(spark, f"{path}/*.txt")
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("subject"))
    return rows.join(conditions.join(windows, "subject"), "subject")


def s12_files(spark, d):
    path = scratch_path(spark, "results")
    rows = table(spark, d, "customer").select(F.concat(F.col("c_mktsegment"), F.lit(": a")).alias("drug"), (F.col("c_nationkey") % 3).cast("string").alias("channel"), "c_custkey")
    results.write_results(rows, path)
    return spark.read.schema("c_custkey long, drug string, channel string").parquet(path)


def s13_append(spark, d):
    path = scratch_path(spark, "append")
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("long").alias("part"))
    results.append_new(o.where("part < 3"), path, ["part"])
    done = spark.read.schema("o_orderkey long, part long").parquet(path)
    results.append_new(results.pending(o, done, ["part"]), path, ["part"])
    return spark.read.schema("o_orderkey long, part long").parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "s1_read_sheet": (s1, "SELECT c_custkey, c_name AS id, CAST(length(c_mktsegment) + 9 AS INTEGER) AS n FROM customer"),
    "s3_read_metadata": (s3_files, "WITH l AS (SELECT max(event_type) AS e FROM events) SELECT CAST(max(user_id) AS DOUBLE) AS frameRate, 1::BIGINT AS device FROM events, l WHERE event_type = l.e"),
    "s4_read_frame_times": (s4, f"WITH {TRAINS} SELECT event_id AS frame_idx, round(t / 1000000, 6) AS t FROM trains"),
    "s5_read_notes": (s5, f"WITH {TRAINS} SELECT round(t / 1000000, 6) AS t, recording_id AS label FROM trains"),
    "s8_read_start_time": (s8, "SELECT strftime(o_orderdate, '%Y-%m-%d') AS time, round(o_totalprice, 2) AS acq_clk_hz, o_orderkey AS block_read_sz, o_custkey AS block_write_sz FROM orders"),
    "s9_read_fifo_use": (s9, "SELECT o_orderkey AS clock, o_custkey AS bytes, round(o_totalprice, 2) AS percent FROM orders"),
    "s10_read_design": (s10, "SELECT c_custkey, CAST(n_nationkey AS VARCHAR) AS subject, r_name AS condition, r_name != 'ASIA' AS is_drug, p.period, p.start_min::DOUBLE AS start_min, p.end_min::DOUBLE AS end_min FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (VALUES ('control', 0, 10), ('treatment', 15, 25)) p(period, start_min, end_min)"),
    "s12_write_results": (s12_files, "SELECT c_custkey, c_mktsegment || '__a' AS drug, CAST(c_nationkey % 3 AS VARCHAR) AS channel FROM customer"),
    "s13_append_new": (s13_append, "SELECT o_custkey % 5 AS part, count(*) AS n FROM orders GROUP BY ALL"),
}
