"""Raw binary recordings: files of records of one size, read and written through Hadoop's file systems.

Spark's splits of fixed-length records do the reading, so any file system that Spark can read will do. The split size is given,
so that the number of a row's split tells its file and its place there: nothing is counted, and no shuffle numbers the rows.
Bytes become numbers in Arrow batches. Writing goes through Spark's text writer and its commit protocol: a record whose
last byte is always the same is a line that ends with that byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = {"uint64": "<u8", "uint16": "<u2", "float32": "<f4", "float64": "<f8", "int16": "<i2", "int64": "<i8"}
SPARK_KINDS = {"uint64": "long", "uint16": "int", "float32": "float", "float64": "double", "int16": "short", "int64": "long"}
#: Bytes of a split, and how many splits there are at most before they grow.
SPLIT_BYTES, MOST_SPLITS = 32 << 20, 100_000
#: The last split of a file may be longer than the others by this factor (Hadoop's fixed value).
_SLOP = 1.1


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files that ``path`` (which may hold wildcards) names or holds, in order, with their sizes; hidden ones left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    found = []
    for status in fs.globStatus(place) or []:
        found += list(fs.listStatus(status.getPath())) if status.isDirectory() else [status]
    files = [(f.getPath().toString(), f.getPath().getName(), f.getLen()) for f in found if f.isFile()]
    files = sorted((uri, size) for uri, name, size in files if name[0] not in "._")
    if not files:
        raise FileNotFoundError(path)
    return files


def _splits(files: list[tuple[str, int]], record: int, split: int) -> list[tuple[int, str, int, int]]:
    """Number, path, first record in the file and first record over all files of each split, in order."""
    out, before = [], 0
    for uri, size in files:
        if size % record:
            raise ValueError(f"{uri}: {size} bytes are no whole number of records of {record}")
        at = 0
        while at < size:
            out.append((len(out), uri, at // record, (before + at) // record))
            at = at + split if (size - at) / split > _SLOP else size
        before += size
    return out


def read_raw(spark: SparkSession, path: str, kind: str, width: int = 1, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, idx (record in its file), at (record over all files, in order of path) and values of each record.

    A file that ends within a record is an error.
    """
    record = np.dtype(KINDS[kind]).itemsize * width
    files = [f for f in list_files(spark, path) if f[1]]
    schema = f"path string, idx long, at long, values array<{SPARK_KINDS[kind]}>"
    if not files:
        return spark.createDataFrame([], schema)
    split = max(record, max(split_bytes, sum(size for _, size in files) // MOST_SPLITS) // record * record)
    places = _splits(files, record, split)
    splits = spark.createDataFrame(places, "_split int, path string, _first long, _before long")
    # a hundred bytes a split, of which there are few; with very many files the rows are joined by shuffle
    splits = F.broadcast(splits) if len(places) <= 2 * MOST_SPLITS else splits
    jvm = spark._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    for end in ("minsize", "maxsize"):
        conf.set(f"mapreduce.input.fileinputformat.split.{end}", str(split))
    records = spark._jsc.sc().binaryRecords(",".join(uri for uri, _ in files), record, conf)
    rows = DataFrame(spark._jsparkSession.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = rows.select(F.spark_partition_id().alias("_split"), place.alias("_place"), F.col(rows.columns[0]).alias("value")).join(splits, "_split")
    rows = rows.select("path", (F.col("_first") + F.col("_place")).alias("idx"), (F.col("_before") + F.col("_place")).alias("at"), "value")
    signed = {"uint64": np.int64, "uint16": np.int32}.get(kind)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, n = batch.column("value"), batch.num_rows
            _, offsets, data = value.buffers()
            start = np.frombuffer(offsets, np.int32)[value.offset] if n else 0
            flat = np.frombuffer(data, np.uint8, n * record, int(start)).view(KINDS[kind]) if n else np.zeros(0, KINDS[kind])
            if kind == "uint64" and (flat >> np.uint64(63)).any():
                raise ValueError("a count beyond the signed range")
            flat = flat.astype(signed) if signed else flat
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "idx", "at")), lists], names=["path", "idx", "at", "values"])

    return rows.mapInArrow(numbers, schema)


def record_bytes(values: Column, kind: str) -> Column:
    """The bytes of a record: the numbers of an array, one after the other."""

    def encode(lists: pa.Array) -> pa.Array:
        data = lists.flatten().to_numpy(zero_copy_only=False).astype(KINDS[kind])
        offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]) * data.itemsize
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])

    return F.arrow_udf(encode, "binary")(values)


def write_raw(rows: DataFrame, values: Column, kind: str, path: str, order: list[str], last_byte: int = 0, by: list[str] | None = None) -> None:
    """Write records as raw files under ``path``, in ``order`` over all files, or in folders ``by`` columns with a file each.

    The last byte of every record has to be ``last_byte`` (under 128): the highest byte of counts under 2 ** 56 is 0, for one.
    """
    data = rows.select(*(by or []), *order, record_bytes(values, kind).alias("_record"))
    end = F.hex(F.substring("_record", -1, 1))
    body = F.when(end == f"{last_byte:02X}", F.expr("substring(_record, 1, length(_record) - 1)").cast("string")).otherwise(F.raise_error(F.lit("a record does not end with the byte of all records")))
    placed = data.repartition(*by).sortWithinPartitions(*by, *order) if by else data.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = placed.select(*(by or []), body.alias("value")).write.option("lineSep", chr(last_byte))
    (writer.partitionBy(*by) if by else writer).text(path)


def read_clock(spark: SparkSession, path: str, clock_hz: float) -> DataFrame:
    """idx and t in seconds of the ticks of a file, or of several in order of path."""
    return read_raw(spark, path, "uint64").select(F.col("at").alias("idx"), (F.col("values")[0] / F.lit(float(clock_hz))).alias("t"))


def clock_rate(clock: DataFrame, fallback: float = 30.0) -> DataFrame:
    """One row: rate = 1 / mean interval, or the fallback with fewer than two ticks."""
    span = (F.max("t") - F.min("t")) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))
    return clock.agg(F.coalesce(1 / F.nullif(span, F.lit(0.0)), F.lit(fallback)).alias("rate"))


def sampling_rate(clock: DataFrame, first: int = 10_000) -> DataFrame:
    """One row: fs = 1 / median interval of the first samples."""
    head = clock.where(F.col("idx") < first)
    gap = head.withColumn("d", F.lead("t").over(Window.orderBy("idx")) - F.col("t"))  # ``first`` rows at most
    return gap.agg((1 / F.median("d")).alias("fs"))


#: Fixed values of the recording device: channels, offset and microvolts per step.
DEVICE_CHANNELS, ZERO, MICROVOLTS = 32, 32768, 0.195


def channel_names() -> list[str]:
    return [f"RHS2116_AC_{i}" for i in range(DEVICE_CHANNELS)]


def read_ephys(spark: SparkSession, signal: str, clock: str, clock_hz: float, channels: list | None = None, max_samples: int | None = None) -> DataFrame:
    """channel, idx, t, value (microvolts) of an interleaved recording and its clock, as long as the shorter one.

    ``channels``: names or numbers, all by default.
    """
    names = channel_names()
    chosen = list(range(DEVICE_CHANNELS)) if channels is None else [names.index(c) if isinstance(c, str) else int(c) for c in channels]
    if any(not 0 <= c < DEVICE_CHANNELS for c in chosen):
        raise ValueError("no such channel")
    rows = read_raw(spark, signal, "uint16", DEVICE_CHANNELS).select(F.col("at").alias("idx"), "values")
    if max_samples is not None:
        rows = rows.where(F.col("idx") < max_samples)
    both = rows.join(read_clock(spark, clock, clock_hz), "idx")
    picked = F.explode(F.array(*(F.struct(F.lit(names[c]).alias("channel"), ((F.col("values")[c] - ZERO) * F.lit(MICROVOLTS)).alias("value")) for c in chosen))).alias("s")
    return both.select("idx", "t", picked).select("s.channel", "idx", "t", "s.value")


def read_gas(spark: SparkSession, files: dict[str, str], clock: str, clock_hz: float, scale: dict[str, float] | None = None) -> DataFrame:
    """channel, idx, t, value of float32 files that share a clock; O2 counts ten times."""
    scale = {"O2": 10.0} if scale is None else scale
    ticks, out = read_clock(spark, clock, clock_hz), None
    for name, path in files.items():
        rows = read_raw(spark, path, "float32").select(F.lit(name).alias("channel"), F.col("at").alias("idx"), (F.col("values")[0].cast("double") * scale.get(name, 1.0)).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out.join(ticks, "idx").select("channel", "idx", "t", "value")
