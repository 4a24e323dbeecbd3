"""Movies as frames of row-major pixels: projections, traces, detrending, footprints, denoising."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from axonflow.operators import spectral
from axonflow.operators.quantiles import exact_quantiles

KEY = "recording_id"

#: Pixels of a tile: a window of frames is held by tiles, so that large images do not meet in one task.
TILE = 4096


def frame_mean(pixels: Column) -> Column:
    return F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / F.size(pixels)


def mean_trace(frames: DataFrame, idx: str = "frame_idx") -> DataFrame:
    """recording_id, idx, value: mean fluorescence of each frame. A map over the frames."""
    return frames.select(KEY, idx, frame_mean(F.col("pixels")).alias("value"))


def numbered_over_files(frames: DataFrame) -> DataFrame:
    """Global frame index over the files of a recording: files in numeric order, each after the frames before it.

    ``frames``: recording_id, file_number, frame_idx (in its file), pixels.
    """
    sizes = frames.groupBy(KEY, "file_number").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(KEY).orderBy("file_number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(KEY, "file_number", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return frames.join(offsets, [KEY, "file_number"]).withColumn("frame_idx", F.col("frame_idx") + F.col("_offset")).drop("_offset")


def pixel_rows(frames: DataFrame) -> DataFrame:
    return frames.select(KEY, "frame_idx", F.posexplode("pixels").alias("pixel", "value"))


#: Values that a task holds of one tile of pixels, over all frames.
CELLS = 1 << 23
_PROJECTIONS = ("max", "min", "mean", "median", "std", "range")


def _projected(tile: pa.Table) -> pa.Table:
    """Projections of a tile's pixels; a pixel of which no frame has a value has none."""
    stack, known = _stacked(tile.column("_x"))
    wide, some = stack.shape[1], known.any(axis=0)
    out = np.full((len(_PROJECTIONS), wide), np.nan)
    for k in np.flatnonzero(some):
        x = np.sort(stack[known[:, k], k])
        middle = (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
        out[:, k] = x[-1], x[0], x.mean(), middle, x.std(), x[-1] - x[0]
    place = tile.column("_tile")[0].as_py() * tile.column("_width")[0].as_py() + np.arange(wide)
    columns = [pa.array(row, mask=~some) for row in out]
    return pa.table([pa.repeat(tile.column(KEY)[0], wide), pa.array(place, pa.int32()), *columns], names=[KEY, "pixel", *_PROJECTIONS])


def _stacked(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of one array, short ones filled up, and where they have a value."""
    flat = lists.combine_chunks()
    sizes = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = flat.flatten()
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stack, known = np.zeros((len(sizes), int(sizes.max(initial=0)))), np.zeros((len(sizes), int(sizes.max(initial=0))), bool)
    stack[rows, at] = values.fill_null(0).to_numpy(zero_copy_only=False)
    known[rows, at] = values.is_valid().to_numpy(zero_copy_only=False)
    return stack, known


def projections(frames: DataFrame, cells: int = CELLS) -> DataFrame:
    """recording_id, pixel, max, min, mean, median, std (population), range over time.

    Frames are cut into tiles of pixels and go through one shuffle as arrays; a task holds one tile over all frames, and the
    more frames there are, the fewer pixels a tile has, so that it holds about ``cells`` values (one pixel at least).
    """
    most = frames.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    width = max(1, min(TILE, cells // most))
    starts = F.when(F.size("pixels") > 0, F.sequence(F.lit(0), F.size("pixels") - 1, F.lit(width)))
    cut = F.transform(starts, lambda s: F.slice(F.col("pixels").cast("array<double>"), s + 1, width))
    tiles = frames.select(KEY, F.lit(width).alias("_width"), F.posexplode(cut).alias("_tile", "_x"))
    kind = frames.schema[KEY].dataType.simpleString()
    return tiles.groupBy(KEY, "_tile").applyInArrow(_projected, f"`{KEY}` {kind}, pixel int, " + ", ".join(f"{c} double" for c in _PROJECTIONS))


def detrend_median(frames: DataFrame) -> DataFrame:
    """Subtract from each frame how far its mean lies from the median of all frame means."""
    means = frames.withColumn("_mean", frame_mean(F.col("pixels")))
    middle = exact_quantiles(means, [KEY], "_mean", {"_median": 0.5})
    moved = F.transform("pixels", lambda p: p - (F.col("_mean") - F.col("_median")))
    return means.join(middle, KEY).withColumn("pixels", moved).drop("_mean", "_median")


def _images(pixels: DataFrame, *columns: str) -> DataFrame:
    """recording_id and an array over the pixels for each column: one row, of one image, a recording."""
    packed = pixels.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("pixel", *columns))).alias("_p"))
    return packed.select(KEY, *(F.col(f"_p.{c}").alias(c) for c in columns))


def detrend_linear(frames: DataFrame) -> DataFrame:
    """Subtract each pixel's least-squares line over time: recording_id, frame_idx, pixel, value, as rows.

    The sums of the lines are combined per partition; the lines meet the frames as images, and no pixel is joined by itself.
    """
    t, x = F.col("frame_idx").cast("double"), F.col("value").cast("double")
    lines = pixel_rows(frames).groupBy(KEY, "pixel").agg(F.regr_slope(x, t).alias("_a"), F.regr_intercept(x, t).alias("_b"), F.max(x).alias("_x"))
    # one frame has no line: its value is the line
    lines = lines.select(KEY, "pixel", F.coalesce("_a", F.lit(0.0)).alias("_a"), F.coalesce("_b", "_x").alias("_b"))
    level = F.transform("pixels", lambda p, i: p.cast("double") - F.get("_a", i) * t - F.get("_b", i))
    return frames.join(_images(lines, "_a", "_b"), KEY).select(KEY, "frame_idx", F.posexplode(level).alias("pixel", "value"))


def delta_f(frames: DataFrame, window_frames: int, percentile: float = 8, method: str = "delta_f_over_f", tile: int = TILE) -> DataFrame:
    """Relative change of each pixel: recording_id, frame_idx, pixel, value = (x - base) / base, or / sqrt(base).

    Pixels are shifted so that the smallest is positive (a negative minimum is subtracted; then 1 is added if the minimum
    is 0). The base is the percentile of each window of frames, on straight lines between the windows' centres. A task
    takes one window of one tile at a time; frames travel as arrays.
    """
    starts = F.sequence(F.lit(0), F.size("pixels") - 1, F.lit(tile))
    cut = F.transform(F.when(F.size("pixels") > 0, starts), lambda s: F.slice(F.col("pixels").cast("array<double>"), s + 1, tile))
    tiles = frames.select(KEY, "frame_idx", F.floor(F.col("frame_idx") / window_frames).alias("_w"), F.posexplode(cut).alias("_tile", "_x"))

    def base_of(g: pd.DataFrame) -> pd.DataFrame:
        wide = max(len(x) for x in g["_x"])
        stack = np.array([np.pad(np.asarray(x, float), (0, wide - len(x)), constant_values=np.nan) for x in g["_x"]])
        base = np.full(wide, np.nan)
        known = ~np.isnan(stack).all(axis=0)
        base[known] = np.nanpercentile(stack[:, known], percentile, axis=0)
        return g[[KEY, "_tile", "_w"]].iloc[:1].assign(_base=[base], _centre=g["frame_idx"].mean())

    kinds = {f.name: f.dataType.simpleString() for f in tiles.schema}
    base = tiles.groupBy(KEY, "_tile", "_w").applyInPandas(base_of, f"`{KEY}` {kinds[KEY]}, _tile int, _w long, _base array<double>, _centre double")
    w = Window.partitionBy(KEY, "_tile").orderBy("_w")
    base = base.withColumns({"_pb": F.lag("_base").over(w), "_pc": F.lag("_centre").over(w), "_nb": F.lead("_base").over(w), "_nc": F.lead("_centre").over(w)})
    least = frames.groupBy(KEY).agg(F.min(F.array_min(F.col("pixels").cast("array<double>"))).alias("_least"))
    shift = -F.least(F.col("_least"), F.lit(0.0)) + F.when(F.greatest(F.col("_least"), F.lit(0.0)) == 0, 1.0).otherwise(0.0)
    base = base.join(least.select(KEY, shift.alias("_shift")), KEY)  # percentiles move with the shift
    i, c = F.col("frame_idx"), F.col("_centre")
    left = i < c
    other, centre = F.when(left, F.col("_pb")).otherwise(F.col("_nb")), F.when(left, F.col("_pc")).otherwise(F.col("_nc"))
    both = tiles.join(base, [KEY, "_tile", "_w"]).withColumns({"_other": other, "_share": (i - c) / (centre - c)})
    levels = F.transform("_base", lambda b, k: b + F.coalesce((F.get("_other", k) - b) * F.col("_share"), F.lit(0.0)))

    def change(x, level):
        shifted = level + F.col("_shift")
        return (x - level) / (shifted if method == "delta_f_over_f" else F.sqrt(shifted))

    values = F.zip_with("_x", "_level", change)
    out = both.withColumn("_level", F.slice(levels, 1, F.size("_x"))).select(KEY, "frame_idx", "_tile", F.posexplode(values).alias("_k", "value"))
    return out.select(KEY, "frame_idx", (F.col("_tile") * tile + F.col("_k")).alias("pixel"), "value")


def footprint_sum(footprints: DataFrame) -> DataFrame:
    return footprints.groupBy(KEY, "pixel").agg(F.sum("weight").alias("weight"))


def footprint_mask(footprints: DataFrame, share: float = 0.2) -> DataFrame:
    """Pixels with at least ``share`` of their unit's largest weight."""
    peak = footprints.groupBy(KEY, "unit_id").agg(F.max("weight").alias("_peak"))
    return footprints.join(peak, [KEY, "unit_id"]).where(F.col("weight") >= share * F.col("_peak")).drop("_peak")


def footprint_outline(footprints: DataFrame, height: int, width: int, share: float = 0.2) -> DataFrame:
    """Mask pixels without all four neighbours in the mask; pixels count along the columns (pixel = x * height + y)."""
    mask = footprint_mask(footprints, share).select(KEY, "unit_id", "pixel")
    x, y = F.floor(F.col("pixel") / height), F.col("pixel") % height
    beside = F.filter(F.array(F.when(x > 0, F.col("pixel") - height), F.when(x < width - 1, F.col("pixel") + height), F.when(y > 0, F.col("pixel") - 1), F.when(y < height - 1, F.col("pixel") + 1)), lambda p: p.isNotNull())
    near = mask.withColumn("_q", F.explode(beside)).join(mask.withColumnRenamed("pixel", "_q"), [KEY, "unit_id", "_q"])
    inner = near.groupBy(KEY, "unit_id", "pixel").agg(F.count(F.lit(1)).alias("_n")).where("_n = 4")
    return mask.join(inner, [KEY, "unit_id", "pixel"], "left_anti")


#: Units, pixels and frames of a block of the product of footprints and traces.
UNITS, PIXELS, FRAMES = 128, 1024, 512


def activity_movie(footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """recording_id, frame_idx, pixel, value: the units' footprints times their traces, summed.

    A product of sparse matrices in blocks: footprints are packed by (block of units, tile of pixels), traces by (block of units,
    block of frames); each pair is one product of small dense matrices, and only its pixels and frames are rows.
    """
    block = F.pmod(F.xxhash64("unit_id"), F.ceil(F.col("_units") / UNITS)).cast("int")
    sizes = footprints.groupBy(KEY).agg(F.approx_count_distinct("unit_id").alias("_units"))
    blocked = lambda df: df.join(sizes, KEY).withColumn("_u", block)
    left = blocked(footprints).groupBy(KEY, "_u", F.floor(F.col("pixel") / PIXELS).alias("_tile")).agg(F.collect_list(F.struct("unit_id", "pixel", F.col("weight").cast("double").alias("v"))).alias("_f"))
    right = blocked(traces).groupBy(KEY, "_u", F.floor(F.col("frame_idx") / FRAMES).alias("_time")).agg(F.collect_list(F.struct("unit_id", "frame_idx", F.col("value").cast("double").alias("v"))).alias("_t"))
    kinds = {f.name: f.dataType for f in [*footprints.schema, *traces.schema]}
    names = {KEY: kinds[KEY].simpleString(), "frame_idx": kinds["frame_idx"].simpleString(), "pixel": kinds["pixel"].simpleString()}
    fields = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in names.items()) + ", value double")
    schema = to_arrow_schema(fields)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = lambda c, k: batch.column(c)[row].values.field(k).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                frame, pixel, value = _block_product(*(part("_f", k) for k in ("unit_id", "pixel", "v")), *(part("_t", k) for k in ("unit_id", "frame_idx", "v")))
                head = pa.repeat(batch.column(KEY)[row], len(value))
                yield pa.RecordBatch.from_arrays([head, pa.array(frame, schema.types[1]), pa.array(pixel, schema.types[2]), pa.array(value)], schema=schema)

    rows = left.join(right, [KEY, "_u"]).select(KEY, "_f", "_t").mapInArrow(product, fields)
    return rows.groupBy(KEY, "frame_idx", "pixel").agg(F.sum("value").alias("value"))


def _block_product(f_unit, f_pixel, weight, t_unit, t_frame, level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame, pixel and value where a unit has both; repeated entries are added up."""
    units, at = np.unique(np.concatenate([f_unit, t_unit]), return_inverse=True)
    pixels, p = np.unique(f_pixel, return_inverse=True)
    times, t = np.unique(t_frame, return_inverse=True)
    a, b = np.zeros((2, len(units), len(pixels))), np.zeros((2, len(units), len(times)))
    for dense, rows, columns, values in ((a, at[: len(f_unit)], p, weight), (b, at[len(f_unit) :], t, level)):
        np.add.at(dense[0], (rows, columns), np.nan_to_num(values, nan=0.0))
        dense[1][rows, columns] = 1
    met = (b[1].T @ a[1]) > 0
    i, j = np.nonzero(met)
    return times[i], pixels[j], (b[0].T @ a[0])[i, j]


def blacked_out(frames: DataFrame, footprints: DataFrame) -> DataFrame:
    """Frames with the pixels of all units set to 0."""
    weights = footprint_sum(footprints).select(KEY, "pixel", (F.col("weight") > 0).alias("_covered"))
    grid = weights.groupBy(KEY).agg(F.max("pixel").alias("_last")).select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("pixel"))
    masks = _images(grid.join(weights, [KEY, "pixel"], "left").fillna(False, ["_covered"]), "_covered")
    zero = F.transform("pixels", lambda p, i: F.when(F.get("_covered", i), F.lit(0.0)).otherwise(p))
    out = frames.join(masks, KEY, "left")
    return out.withColumn("pixels", F.when(F.col("_covered").isNull(), F.col("pixels")).otherwise(zero)).drop("_covered")


def unit_summary(traces: DataFrame, footprints: DataFrame, rate: float, height: int, view_seconds: float = 60.0) -> DataFrame:
    """Per unit: duration, first peak time, least and largest value, peak pixel (x, y) and the default view around it."""
    peak = F.max(F.struct("value", (-F.col("frame_idx")).alias("m")))
    t = traces.groupBy(KEY, "unit_id").agg(((F.count(F.lit(1)) - 1) / rate).alias("duration"), peak.alias("_p"), F.min("value").alias("least"), F.max("value").alias("largest"))
    t = t.withColumn("peak_time", -F.col("_p.m") / rate)
    p = footprints.groupBy(KEY, "unit_id").agg(F.max(F.struct("weight", (-F.col("pixel")).alias("m"))).alias("_f"))
    span = F.least(F.lit(view_seconds), F.col("duration"))
    start = F.least(F.greatest(F.col("peak_time") - span / 2, F.lit(0.0)), F.col("duration") - span)
    pixel = -F.col("_f.m")
    return t.join(p, [KEY, "unit_id"], "left").select(
        KEY, "unit_id", "duration", "peak_time", "least", "largest", F.floor(pixel / height).alias("peak_x"), (pixel % height).alias("peak_y"), start.alias("view_start"), (start + span).alias("view_end")
    )


def denoise(frames: DataFrame, height: int, width: int, rate: float, radius: float, notch: float, cutoff: float = 3.0, order: int = 6, limit: float = 255.0) -> DataFrame:
    """Frames without high spatial frequencies and stripes, rescaled to their low-passed mean.

    Spatial frequencies beyond ``radius`` are cut, and those within ``notch`` of the vertical axis, but for the lowest;
    each frame is a 2-D transform of its own. The mean trace is low-passed (order 6, 3 Hz) and every frame scaled to it.
    """
    fy, fx = np.meshgrid(np.fft.fftfreq(height) * height, np.fft.fftfreq(width) * width, indexing="ij")
    r = np.hypot(fx, fy)
    mask = (r <= radius) & ~((np.abs(fx) <= notch) & (np.abs(fy) > max(notch, 1)))

    def clean(batches):
        for pdf in batches:
            stack = np.array([np.asarray(p, float).reshape(height, width) for p in pdf["pixels"]])
            out = np.fft.ifft2(np.fft.fft2(stack) * mask).real if len(stack) else stack
            yield pdf.assign(pixels=list(out.reshape(len(stack), -1)))

    kept = frames.select(KEY, "frame_idx", F.col("pixels").cast("array<double>").alias("pixels"))
    cleaned = kept.mapInPandas(clean, kept.schema)

    means = mean_trace(kept)
    smooth = spectral.zero_phase(means, [KEY], order, cutoff, "low", rate, idx="frame_idx").withColumnRenamed("value", "_smooth")
    target = means.join(smooth, [KEY, "frame_idx"], "left").select(KEY, "frame_idx", F.coalesce("_smooth", "value").alias("_target"))  # too short to filter: as it is
    both = cleaned.join(target, [KEY, "frame_idx"]).withColumn("_mean", frame_mean(F.col("pixels")))
    factor = F.when(F.col("_mean") != 0, F.col("_target") / F.col("_mean")).otherwise(F.lit(1.0))
    return both.select(KEY, "frame_idx", F.transform("pixels", lambda p: F.least(F.greatest(p * factor, F.lit(0.0)), F.lit(limit))).alias("pixels"))
