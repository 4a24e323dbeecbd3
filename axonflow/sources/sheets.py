"""Experiment sheets, recording metadata, clocks and study designs."""

from __future__ import annotations

import csv
import csv
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "line number"
NULLS = ["", "na", "n/a", "null", "nan", "none"]


def read_sheet(spark: SparkSession, path: str, key: str = KEY) -> DataFrame:
    """A sheet as strings, blank rows left out. Raises ValueError when a rule of :func:`violations` is broken.

    The header is one line of one file; unnamed columns are spacers and are dropped once they prove empty.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError("the sheet is empty")
    names = header_names(first[0]["value"])
    named = [c for c in names if c.strip()]
    if len(set(named)) < len(named):
        raise ValueError("a column name occurs twice")
    if key not in named:
        raise ValueError(f"no column {key!r}")
    fields = [c if c.strip() else f"_unnamed_{i}" for i, c in enumerate(names)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*fields, "_corrupt"]])
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True, escape='"')
    blank = F.forall(F.array(*(F.col(f"`{c}`") for c in fields)), lambda c: c.isNull() | (F.trim(c) == ""))
    rows = rows.where(~blank)
    broken = [r["rule"] for r in violations(rows, fields, key).collect()]  # one row a rule
    if broken:
        raise ValueError("; ".join(sorted(broken)))
    return rows.select(*(F.col(f"`{c}`") for c in named))


def header_names(line: str) -> list[str]:
    """Names in the first line of a sheet; a quoted one may hold commas, and quotes twice."""
    return next(csv.reader([line.lstrip("\ufeff").rstrip("\r\n")]), [])


def violations(rows: DataFrame, fields: list[str], key: str = KEY) -> DataFrame:
    """Names of the rules that the sheet breaks, one row each."""
    k = F.col(f"`{key}`")
    spare = [F.col(f"`{c}`") for c in fields if c.startswith("_unnamed_")]
    counts = rows.agg(
        F.count_if(F.col("_corrupt").isNotNull()).alias("rows of another length"),
        F.count_if(k.isNull() | (F.trim(k) == "")).alias("blank keys"), F.count_if(F.trim(k) != k).alias("keys with outer spaces"),
        F.count_if(F.greatest(*(F.coalesce(c, F.lit("")) for c in spare), F.lit("")) != "").alias("values in unnamed columns"),
        (F.count(k) - F.count_distinct(k)).alias("repeated keys"),
    )
    return counts.unpivot([], counts.columns, "rule", "n").where("n > 0").select("rule")


def is_null(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(NULLS)


def convert(sheet: DataFrame, types: dict[str, str]) -> DataFrame:
    """Typed columns of a sheet of strings; types: long, double, boolean, numbers (list), date (YYMMDD), texts (by ;).

    Columns that are not named stay strings. The usual spellings of missing values are null; so is what cannot be read.
    """
    def typed(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        read = {
            "long": lambda: c.try_cast("double").cast("long"), "double": lambda: c.try_cast("double"), "boolean": lambda: F.lower(F.trim(c)).try_cast("boolean"),
            "numbers": lambda: F.from_json(F.translate(c, "()", "[]"), "array<double>"), "date": lambda: F.to_date(F.try_to_timestamp(F.lpad(c, 6, "0"), F.lit("yyMMdd"))),
            "texts": lambda: F.transform(F.split(c, ";"), lambda x: F.trim(x)),
        }[kind]()
        return F.when(~is_null(c), read).alias(name)

    return sheet.select(*(typed(c, types[c]) if c in types else F.col(f"`{c}`") for c in sheet.columns))


def frame_rate(text: Column) -> Column:
    """A rate such as 20 or '20FPS' as a number."""
    return F.regexp_replace(text.cast("string"), "(?i) *FPS$", "").try_cast("double")


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row of metadata from JSON files; of a key in several files, the one in the last file (by path) holds."""
    rows = spark.read.schema(schema).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("_file"))
    keys = [c for c in rows.columns if c != "_file"]
    out = rows.agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_file"))).alias(c) for c in keys))
    return out.withColumn("frameRate", frame_rate(F.col("frameRate"))) if "frameRate" in keys else out


def read_frame_times(spark: SparkSession, path: str) -> DataFrame:
    """Frame number and time in seconds from a sheet of frame numbers and milliseconds."""
    return spark.read.csv(path, schema="frame_idx long, ms double", header=True).select("frame_idx", (F.col("ms") / 1000).alias("t"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Labelled events from one sheet of milliseconds and labels."""
    rows = spark.read.csv(path, schema="ms double, label string", header=True).select("*", F.col("_metadata.file_path").alias("_file"))
    if rows.select("_file").distinct().count() > 1:
        raise ValueError("more than one notes file")
    return rows.select((F.col("ms") / 1000).alias("t"), "label")


def read_start_time(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="time string, acq_clk_hz double, block_read_sz long, block_write_sz long", header=False)


def read_fifo_use(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="clock long, bytes long, percent double", header=True)


def read_design(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Conditions (condition, subject, is_drug) and windows (subject, period, start_min, end_min) of a study design.

    The document is small and read whole. All errors are gathered and raised at once.
    """
    document = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    groups, selections = document.get("drug_groups", {}), document.get("selections", {})
    plain = set(document.get("no_drug_conditions", []))
    conditions = [(c, str(s), c not in plain) for c, subjects in groups.items() for s in subjects]
    windows = [(str(s), period, float(a), float(b)) for s, spans in selections.items() for period, (a, b) in zip(("control", "treatment"), spans, strict=False)]
    errors = design_errors(conditions, windows, document.get("frequency_ranges", {}))
    if errors:
        raise ValueError("; ".join(errors))
    return spark.createDataFrame(conditions, "condition string, subject string, is_drug boolean"), spark.createDataFrame(windows, "subject string, period string, start_min double, end_min double")


def design_errors(conditions: list[tuple], windows: list[tuple], bands: dict) -> list[str]:
    errors = [f"band {name}: 0 < low < high is broken" for name, (low, high) in bands.items() if not 0 < low < high]
    members: dict[str, set] = {}
    for c, s, _ in conditions:
        members.setdefault(s, set()).add(c)
    errors += [f"subject {s} is in {len(c)} conditions" for s, c in members.items() if len(c) > 1]
    timed = {s for s, *_ in windows}
    errors += [f"subject {s} has no windows" for s in members if s not in timed]
    errors += [f"subject {s}, {p}: 0 <= start < end is broken" for s, p, a, b in windows if not 0 <= a < b]
    return errors


def find_files(spark: SparkSession, folder: str, names: list[str], skip: str = "saved_movies") -> DataFrame:
    """name, path of the wanted files anywhere under ``folder``; a missing or repeated name is an error.

    Only paths and lengths are read: the content is pruned.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    found = found.where(~F.col("path").contains(f"/{skip}/")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    found = found.join(F.broadcast(wanted), "name")  # the caller's list
    counts = {r["name"]: r["n"] for r in wanted.join(found, "name", "left").groupBy("name").agg(F.count("path").alias("n")).where("n != 1").collect()}
    if counts:
        raise ValueError("; ".join(f"{n}: " + ("missing" if k == 0 else f"in {k} folders") for n, k in sorted(counts.items())))
    return found


def numbered_movies(spark: SparkSession, folder: str, numbers: list[int]) -> DataFrame:
    return find_files(spark, folder, [f"{n}.avi" for n in numbers])


def name_movies(spark: SparkSession, folder: str, column: str) -> list[int]:
    """Rename the one file of each folder ``column=<n>`` to ``<n>.avi``; the numbers. A rename for each folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    numbers = []
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{column}=*/part-*")):
        parent = status.getPath().getParent()
        numbers.append(int(parent.getName().split("=")[1]))
        if not fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(parent, f"{numbers[-1]}.avi")):
            raise FileExistsError(f"{parent}/{numbers[-1]}.avi")
    return sorted(numbers)
