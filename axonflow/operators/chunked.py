"""Signals as packed chunks of consecutive samples, and numpy functions over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def key_schema(df: DataFrame, keys: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


@dataclass(frozen=True)
class Sparse:
    """Samples of which most are empty, in a row for each known one.

    ``rows``: keys, idx, ``values``, _start, _end. A row stands for the samples from _start to _end; those of a recording follow
    on each other without gaps. Sample idx has the values, the others are empty: ``fill``, or null. Rows without idx have no values.
    """

    rows: DataFrame
    values: tuple[str, ...] = ("value",)
    fill: float | None = None

    def filled(self, fill: float) -> Sparse:
        known = F.col("idx").isNotNull()
        return Sparse(self.rows.withColumns({v: F.when(known, F.coalesce(v, F.lit(fill))) for v in self.values}), self.values, fill)

    def samples(self, keys: list[str]) -> DataFrame:
        """keys, idx and values, a row for each sample."""
        rows = self.rows.select(*keys, F.col("idx").alias("_at"), *self.values, F.explode(F.sequence("_start", "_end")).alias("idx"))
        values = (F.when(F.col("_at") == F.col("idx"), F.col(v)) for v in self.values)
        return rows.select(*keys, "idx", *((c if self.fill is None else F.coalesce(c, F.lit(self.fill))).alias(v) for c, v in zip(values, self.values, strict=True)))

    def sizes(self, keys: list[str]) -> DataFrame:
        """keys, _n: samples of each recording."""
        return self.rows.groupBy(*keys).agg(F.sum(_length()).alias("_n"))


def _length() -> Column:
    return F.col("_end") - F.col("_start") + 1


def with_moments(samples: DataFrame | Sparse, keys: list[str], values: list[str]) -> tuple[DataFrame | Sparse, list[str]]:
    """``samples`` with ``_n``, the samples of each recording, and ``_mean_*`` and ``_std_*`` (of the population) of its values; and
    the names of these columns."""
    names = ["_n", *(f"_{m}_{v}" for v in values for m in ("mean", "std"))]
    if not isinstance(samples, Sparse):
        moments = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(f(v).alias(f"_{m}_{v}") for v in values for m, f in (("mean", F.avg), ("std", F.stddev_pop))))
        return samples.join(moments.hint("shuffle_hash"), keys), names
    whole = Window.partitionBy(*keys)
    rows = samples.rows.withColumn("_n", F.sum(_length()).over(whole))
    for v in values:
        mean, std = F.avg(v).over(whole), F.stddev_pop(v).over(whole)
        if samples.fill is not None:
            # the empty samples join those that are known as a group without deviation
            known, fill = F.count(v).over(whole), F.lit(samples.fill)
            off, empty = F.coalesce(mean - fill, F.lit(0.0)), F.col("_n") - known
            std = F.sqrt((F.coalesce(std * std, F.lit(0.0)) * known + off * off * known * empty / F.col("_n")) / F.col("_n"))
            mean = (F.coalesce(F.sum(v).over(whole), F.lit(0.0)) + fill * empty) / F.col("_n")
        rows = rows.withColumns({f"_mean_{v}": mean, f"_std_{v}": std})
    return Sparse(rows, samples.values, samples.fill), names


def chunks(samples: DataFrame | Sparse, keys: list[str], core: int | None, left: int = 0, right: int = 0, values: tuple[str, ...] = ("value",), idx: str = "idx", same: list[str] | None = None) -> DataFrame:
    """keys, chunk, first and last (indexes of the packed samples), an array per value column, in order of idx, and the columns
    ``same``, which are alike for a recording.

    Chunk c holds the samples [c * core - left, (c + 1) * core + right) that exist; there is none without samples of its own.
    Without ``core`` a recording is one chunk, of number 0. Of sparse samples only the known ones are packed, with their
    indexes; :func:`by_chunk` lays them out.
    """
    sparse = isinstance(samples, Sparse)
    rows = samples.rows if sparse else samples
    start, end = (F.col("_start"), F.col("_end")) if sparse else (F.col(idx), F.col(idx))
    chunk = F.lit(0).cast("long")
    if core is not None:
        chunk = F.explode(F.sequence(F.floor((start - right) / core).cast("long"), F.floor((end + left) / core).cast("long")))
    rows = rows.withColumn("chunk", chunk)
    alike = [F.first(c).alias(c) for c in same or []]
    if sparse:
        if core is not None:
            start, end = F.greatest(start, F.col("chunk") * core - left), F.least(end, (F.col("chunk") + 1) * core + (right - 1))
        known = F.when(F.col("idx").between(start, end), F.struct("idx", *values))
        packed = rows.groupBy(*keys, "chunk").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.collect_list(known).alias("_rows"), *alike)
        extra = [F.col("_rows.idx").alias("_at"), F.lit(float("nan") if samples.fill is None else samples.fill).alias("_fill")]
    else:
        packed = rows.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct(idx, *values))).alias("_rows"), F.min(idx).alias("first"), F.max(idx).alias("last"), *alike)
        extra = []
    if core is not None:
        packed = packed.where((F.col("last") >= F.col("chunk") * core) & (F.col("first") < (F.col("chunk") + 1) * core))
    return packed.select(*keys, "chunk", "first", "last", *(F.col(f"_rows.{v}").alias(v) for v in values), *extra, *(same or []))


def indexed(samples: DataFrame | Sparse, idx: str) -> tuple[DataFrame | Sparse, tuple[str, ...]]:
    """``samples`` whose chunks also have the indexes, as ``at`` (those of sparse ones always have), and the columns to pack."""
    if isinstance(samples, Sparse):
        return samples, ("value",)
    return samples.withColumns({"at": F.col(idx), "value": F.col("value").cast("double")}), ("value", "at")


def _laid_out(row: SimpleNamespace, names: list[str]) -> None:
    """Arrays of all samples of a sparse chunk instead of the known ones."""
    size, here = row.last - row.first + 1, row._at - row.first
    known = row.known
    row.known = np.full(size, not np.isnan(row._fill))
    row.known[here] = known
    row.at = np.arange(row.first, row.last + 1)
    for name in names:
        x = np.full(size, row._fill)
        x[here] = getattr(row, name)
        setattr(row, name, x)


#: Rows that a task gathers before it hands them on.
_ROWS = 1 << 16


def by_chunk(packed: DataFrame, keys: list[str], schema: str, fn) -> DataFrame:
    """``fn(row) -> dict of arrays`` over packed rows, whose arrays are numpy arrays (missing numbers NaN, ``known`` where the first
    is not null); the keys are repeated for each output row. The output of many chunks goes on as one batch."""
    fields = StructType.fromDDL(f"{key_schema(packed, keys)}, {schema}")
    types = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, lists = {}, []
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                if pa.types.is_list(column.type):
                    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                    columns[name] = [values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
                    if not lists:
                        valid = column.values.is_valid().to_numpy(zero_copy_only=False)
                        columns["known"] = [valid[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
                    lists.append(name)
                elif name not in keys:
                    columns[name] = column.to_pylist()
            made, rows, held = [], [], 0
            for i in range(batch.num_rows):
                row = SimpleNamespace(**{name: values[i] for name, values in columns.items()})
                if "_at" in columns:
                    _laid_out(row, lists[:-1])
                out = fn(row)
                made.append(out)
                rows.append(i)
                held += len(next(iter(out.values())))
                if held >= _ROWS or i == batch.num_rows - 1:
                    if held:
                        yield gathered(batch, made, rows)
                    made, rows, held = [], [], 0

    def gathered(batch: pa.RecordBatch, made: list[dict], rows: list[int]) -> pa.RecordBatch:
        names = types.names[len(keys) :]
        repeated = pa.array(np.repeat(rows, [len(out[names[0]]) for out in made]))
        values = [pa.array(np.concatenate([np.asarray(out[n]) for out in made if len(out[n])]), types.field(n).type) for n in names]
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(repeated) for k in keys), *values], schema=types)

    return packed.mapInArrow(run, fields)
