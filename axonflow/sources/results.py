"""Result tables, resumable work, run logs and unit-event documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from axonflow.functions.scalars import file_name_part
from axonflow.operators import buckets


def write_results(rows: DataFrame, path: str, by: tuple[str, ...] = ("drug", "channel"), form: str = "parquet", mode: str = "overwrite") -> None:
    """One folder a drug and channel, their names made fit for paths."""
    named = rows.withColumns({c: file_name_part(F.col(c)) for c in by})
    named.write.mode(mode).partitionBy(*by).format(form).options(**({"header": True} if form == "csv" else {})).save(path)


def pending(work: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Work whose keys have no output yet."""
    return work if done is None else work.join(done.select(*keys).distinct(), keys, "left_anti")


def append_new(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write partitions of new work; partitions that are there and not in ``rows`` stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def guarded(rows: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, analysis: str) -> DataFrame:
    """``fn`` by group, in which a failing group does not stop the others: its rows are one with status and reason.

    Returns the columns of ``schema`` (keys first) and analysis, status ('completed' or 'skipped') and reason.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    fields = StructType.fromDDL(schema)
    types = to_arrow_schema(fields)

    def guard(g: pa.Table) -> tuple[pa.Table, str, str | None]:
        try:
            out = fn(g.to_pandas()).reindex(columns=names)
            return pa.Table.from_pandas(out, types, preserve_index=False), "completed", None
        except Exception as e:  # the point of the log
            head = g.slice(0, 1)
            row = [head.column(n).cast(types.field(n).type) if n in keys else pa.nulls(1, types.field(n).type) for n in names]
            return pa.table(row, schema=types), "skipped", f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group so far, which the next batch may go on with
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            starts = [0, *_changes(table, keys)]
            yield from logged([table.slice(a, b - a) for a, b in zip(starts, starts[1:], strict=False)])
            held = table.slice(starts[-1]) if table.num_rows else None
        yield from logged([held] if held is not None else [])

    def logged(groups: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        made = [guard(g) for g in groups]
        if made:
            each = [len(out) for out, *_ in made]
            said = [pa.array([x for x, n in zip(text, each, strict=True) for _ in range(n)], pa.string()) for text in zip(*((s, r) for _, s, r in made), strict=True)]
            out = pa.concat_tables([out for out, *_ in made])
            columns = [*out.columns, pa.repeat(pa.scalar(analysis), len(out)), *said]
            yield from pa.table(columns, names=[*names, "analysis", "status", "reason"]).combine_chunks().to_batches()

    # groups follow each other within sorted parts: a batch for each group would cost more than most groups' work; the number
    # of parts is fixed, since small rows may stand for much work
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).mapInArrow(run, f"{schema}, analysis string, status string, reason string")


def _changes(table: pa.Table, keys: list[str]) -> list[int]:
    """Rows whose keys are not those of the row before."""
    n = max(table.num_rows - 1, 0)
    changed = np.zeros(n, bool)
    for k in keys:
        a, b = table.column(k).slice(0, n), table.column(k).slice(1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(a.type):
            other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        changed |= other.to_numpy() if n else changed
    return (np.flatnonzero(changed) + 1).tolist()


def run_log(results: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each group and analysis: status and reason."""
    return results.groupBy(*keys, "analysis").agg(F.max("status").alias("status"), F.max("reason").alias("reason"))


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("analysis", "status").agg(F.count(F.lit(1)).alias("n"))


#: Events of a piece of a document.
PIECE = 1 << 16


def unit_event_pieces(events: DataFrame, rate: float, derivative: int, threshold: float, idx: str = "idx", piece: int = PIECE) -> DataFrame:
    """JSON documents in pieces: recording_id, place (from 0), offset (characters before it), text.

    A document holds the events of each unit by its id, frame rate, derivative, threshold and index convention; its pieces'
    texts in order of place are the document. A unit's events are numbered and cut every ``piece`` events, so that a recording
    of any length is many rows, and the offsets are an index into it.
    """
    keys = ["recording_id", "unit_id"]
    rows = buckets.numbered(events.select(*keys, F.col(idx).cast("long").alias("_i")), keys, ["_i"], "_n").withColumn("_piece", F.floor(F.col("_n") / piece))
    cut = rows.groupBy(*keys, "_piece").agg(F.array_join(F.sort_array(F.collect_list("_i")), ",").alias("_list"))
    # one row a piece from here on
    unit, recording = Window.partitionBy(*keys), Window.partitionBy("recording_id")
    first_unit = F.col("unit_id") == F.min("unit_id").over(recording)
    name = F.concat(F.lit('"'), F.col("unit_id").cast("string"), F.lit('":['))
    opened = F.when(F.col("_piece") > 0, ",").otherwise(F.concat(F.when(first_unit, "").otherwise(","), name))
    closed = F.when(F.col("_piece") == F.max("_piece").over(unit), "]").otherwise("")
    body = cut.select(*keys, "_piece", F.lit(1).alias("_kind"), F.concat(opened, "_list", closed).alias("text"))
    tail = F.to_json(F.struct(F.lit(float(rate)).alias("frame_rate"), F.lit(derivative).alias("derivative"), F.lit(float(threshold)).alias("threshold"), F.lit("differenced trace").alias("index")))
    ends = F.array(F.struct(F.lit(0).alias("k"), F.lit('{"events":{').alias("text")), F.struct(F.lit(2).alias("k"), F.concat(F.lit("},"), F.substr(tail, F.lit(2))).alias("text")))
    edges = cut.select("recording_id").distinct().select("recording_id", F.explode(ends).alias("e")).select("recording_id", F.lit(None).cast(events.schema["unit_id"].dataType).alias("unit_id"), F.lit(0).cast("long").alias("_piece"), F.col("e.k").alias("_kind"), F.col("e.text").alias("text"))
    order = Window.partitionBy("recording_id").orderBy("_kind", "unit_id", "_piece")
    all_pieces = body.unionByName(edges)
    offset = F.coalesce(F.sum(F.length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return all_pieces.select("recording_id", (F.row_number().over(order) - 1).cast("long").alias("place"), offset.alias("offset"), "text")


def unit_event_document(events: DataFrame, rate: float, derivative: int, threshold: float, idx: str = "idx") -> DataFrame:
    """recording_id and the whole JSON document of each recording, for recordings whose document fits in a row."""
    pieces = unit_event_pieces(events, rate, derivative, threshold, idx)
    return pieces.groupBy("recording_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), "").alias("document"))


def write_unit_events(pieces: DataFrame, path: str) -> None:
    """Write the pieces under ``path`` in folders by recording, as Parquet in order of place, with their offsets."""
    pieces.repartition("recording_id", F.floor(F.col("place") / 64)).sortWithinPartitions("recording_id", "place").write.partitionBy("recording_id").parquet(path)
