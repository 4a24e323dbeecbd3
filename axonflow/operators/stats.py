"""Normalisation, correlation, effect sizes, tests, information, densities and summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonflow.functions import statistics as kernels
from axonflow.functions.scalars import effect_label, fisher_interval
from axonflow.operators import buckets
from axonflow.operators.chunked import Sparse, by_chunk, chunks
from axonflow.operators.quantiles import REST, exact_quantiles
from axonflow.sources.scratch import written


def pooled_z(samples: DataFrame, keys: list[str]) -> DataFrame:
    """z-score over all periods of a signal together (population deviation); 0 where nothing varies, null stays."""
    moments = samples.groupBy(*keys).agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    z = F.when(F.col("value").isNotNull(), F.when(F.col("_std") > 0, (F.col("value") - F.col("_mean")) / F.col("_std")).otherwise(F.lit(0.0)))
    return samples.join(moments.hint("shuffle_hash"), keys).withColumn("z", z).drop("_mean", "_std")


def block_z(samples: DataFrame, keys: list[str], block: int = 1000, idx: str = "idx") -> DataFrame:
    """z-score of each block of samples on its own; undefined values become 0."""
    w = Window.partitionBy(*keys, F.floor(F.col(idx) / block))
    z = (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_pop("value").over(w), F.lit(0.0))
    return samples.withColumn("z", F.coalesce(z, F.lit(0.0)))


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(kernels.correlation_p(r.to_numpy(float), n.to_numpy(float))).where(r.notna() & n.notna(), None)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(kernels.t_two_sided(t.to_numpy(float), df.to_numpy(float))).where(t.notna() & df.notna(), None)


def regression(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", least: int | None = 10) -> DataFrame:
    """keys, n, r, slope, intercept over complete pairs; undefined under ``least`` pairs or where a side is constant.

    With ``least=None`` each figure is there wherever it is defined, as SQL's functions have it: r where both sides vary,
    slope and intercept where x does.
    """
    pairs = pairs.dropna(subset=[x, y])
    # corr itself divides by zero where a side is constant, before any condition could guard it
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), r.alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        (F.max(x) - F.min(x)).alias("_x"), (F.max(y) - F.min(y)).alias("_y"),
    )
    if least is None:
        return out.drop("_x", "_y")
    fine = (F.col("n") >= least) & (F.col("_x") > 0) & (F.col("_y") > 0)
    return out.select(*keys, "n", *(F.when(fine, F.col(c)).alias(c) for c in ("r", "slope", "intercept")))


def with_p(correlations: DataFrame) -> DataFrame:
    return correlations.withColumn("p_value", correlation_p(F.col("r"), F.col("n").cast("double")))


def autocorrelation_sums(pairs: DataFrame, keys: list[str], max_lags: int = 100, idx: str = "idx") -> DataFrame:
    """Biased autocorrelations of x and y up to ``max_lags``: keys, lag, rho_x, rho_y, null for a constant side.

    Means are global and come first. Each sample meets those after it within its block of ``max_lags`` samples or the
    next one, so a long signal is many keys; sums by lag are combined before they are shuffled.
    """
    numbered = buckets.numbered(pairs, keys, [idx], "_i")
    moments = pairs.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.count(F.lit(1)).alias("_n"))
    centred = numbered.join(moments.hint("shuffle_hash"), keys).select(*keys, "_i", "_n", (F.col("x") - F.col("_mx")).alias("x"), (F.col("y") - F.col("_my")).alias("y"))
    block = F.floor(F.col("_i") / max_lags)
    left = centred.withColumn("_b", F.explode(F.array(block, block + 1)))
    right = centred.select(*keys, F.col("_i").alias("_j"), F.col("x").alias("x2"), F.col("y").alias("y2"), block.alias("_b"))
    lag = F.col("_j") - F.col("_i")
    met = left.join(right, [*keys, "_b"]).where((lag >= 0) & (lag <= F.least(F.lit(max_lags), F.floor(F.col("_n") / 4))))
    sums = met.groupBy(*keys, lag.alias("lag")).agg(F.sum(F.col("x") * F.col("x2")).alias("sx"), F.sum(F.col("y") * F.col("y2")).alias("sy"))
    zero = sums.where("lag = 0").select(*keys, F.col("sx").alias("_vx"), F.col("sy").alias("_vy"))
    return sums.join(zero, keys).select(*keys, "lag", F.try_divide("sx", "_vx").alias("rho_x"), F.try_divide("sy", "_vy").alias("rho_y"))


def effective_n(pairs: DataFrame, keys: list[str], max_lags: int = 100, idx: str = "idx") -> DataFrame:
    """keys, n, n_effective = n / (1 + 2 max(0, sum of rho_x rho_y over lags from 1)), held within [3, n]."""
    pairs = pairs.dropna(subset=["x", "y"])
    total = F.sum(F.when(F.col("lag") > 0, F.col("rho_x") * F.col("rho_y"))).alias("_s")
    sums = autocorrelation_sums(pairs, keys, max_lags, idx).groupBy(*keys).agg(total)
    n = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    value = F.greatest(F.lit(3.0), F.least(F.col("n") / (1 + 2 * F.greatest(F.lit(0.0), F.coalesce("_s", F.lit(0.0)))), F.col("n").cast("double")))
    return n.join(sums, keys, "left").select(*keys, "n", value.alias("n_effective"))


def robust_correlation(pairs: DataFrame, keys: list[str], level: float = 0.95, max_lags: int = 100, idx: str = "idx") -> DataFrame:
    """Correlation, regression, p, p corrected for autocorrelation and its confidence interval."""
    out = with_p(regression(pairs, keys)).join(effective_n(pairs, keys, max_lags, idx).drop("n"), keys)
    t = F.col("r") * F.sqrt((F.col("n_effective") - 2) / (1 - F.col("r") ** 2 + 1e-10))
    low, high = fisher_interval(F.col("r"), F.col("n_effective"), level)
    out = out.withColumn("p_value_corrected", F.when(F.col("n_effective") > 2, t_two_sided(t, F.col("n_effective") - 2)))
    return out.withColumns({"ci_lower": low, "ci_upper": high, "n_effective": F.floor("n_effective")})


def population_statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group over complete pairs of control and treatment: counts, moments, medians, ranges, paired difference.

    Groups with fewer than two complete pairs have ``error`` set and no figures.
    """
    fine = F.col("control").isNotNull() & F.col("treatment").isNotNull()
    use = lambda c: F.when(fine, F.col(c))
    valid, difference = F.count_if(fine), F.when(fine, F.col("treatment") - F.col("control"))
    out = {"n_total": F.count(F.lit(1)), "n_valid": valid}
    for c in ("control", "treatment"):
        x = use(c)
        out |= {f"{c}_mean": F.avg(x), f"{c}_median": None, f"{c}_std": F.stddev_samp(x), f"{c}_sem": F.stddev_samp(x) / F.sqrt(valid), f"{c}_min": F.min(x), f"{c}_max": F.max(x)}
    out |= {"mean_difference": F.avg(difference), "median_difference": None}
    figures = rows.groupBy(F.struct(*keys).alias("_g")).agg(*(c.alias(k) for k, c in out.items() if c is not None))
    # medians of all three by one exact selection
    sides = {"control_median": F.col("control"), "treatment_median": F.col("treatment"), "median_difference": F.col("treatment") - F.col("control")}
    long = rows.where(fine).select(F.struct(*keys).alias("_g"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c.cast("double").alias("x")) for k, c in sides.items()))).alias("s"))
    middle = exact_quantiles(long.select("_g", F.col("s.k").alias("_k"), F.col("s.x").alias("_x")), ["_g", "_k"], "_x", {"_m": 0.5})
    middle = middle.groupBy("_g").agg(*(F.max(F.when(F.col("_k") == k, F.col("_m"))).alias(k) for k in sides))
    figures = _ungrouped(figures.join(middle, "_g", "left"), keys, *out)
    enough = F.col("n_valid") >= 2
    blank = [k for k in out if not k.startswith("n_")]
    return figures.select(*keys, "n_total", "n_valid", *(F.when(enough, F.col(k)).alias(k) for k in blank), F.when(~enough, "fewer than 2 valid pairs").alias("error"))


def measurement_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and deviation of control, treatment and their ratio; the ratio's mean is the ratio of the means."""
    ratio = F.when(F.abs("control") >= 1e-10, F.col("treatment") / F.col("control"))
    out = rows.withColumn("ratio", ratio).groupBy(*keys).agg(*(f(c).alias(f"{c}_{n}") for c in ("control", "treatment", "ratio") for n, f in (("mean", F.avg), ("std", F.stddev_samp))))
    return out.withColumn("ratio_mean", F.col("treatment_mean") / F.nullif(F.col("control_mean"), F.lit(0.0)))


def cohens_d(rows: DataFrame, keys: list[str], paired: bool = True) -> DataFrame:
    """keys, d, effect; from paired differences, or from the pooled deviation."""
    if paired:
        d = rows.withColumn("_d", F.col("treatment") - F.col("control")).groupBy(*keys).agg((F.avg("_d") / (F.stddev_samp("_d") + 1e-10)).alias("d"))
    else:
        n1, n2 = F.count("control"), F.count("treatment")
        pooled = F.sqrt(((n1 - 1) * F.var_samp("control") + (n2 - 1) * F.var_samp("treatment")) / (n1 + n2 - 2))
        d = rows.groupBy(*keys).agg(((F.avg("treatment") - F.avg("control")) / (pooled + 1e-10)).alias("d"))
    return d.withColumn("effect", effect_label(F.col("d")))


def _spread(x: str, rows: DataFrame) -> DataFrame:
    """``rows`` (_g, x) with _u in (-1, 1), which grows with x and lays most values of each group ``_g`` out evenly."""
    q = rows.groupBy("_g").agg(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias("_q"))
    from_middle = F.col(x) - F.col("_q")[1]
    scale = F.greatest(F.col("_q")[2] - F.col("_q")[0], F.lit(1e-300))
    return rows.join(q, "_g").withColumn("_u", from_middle / (F.abs(from_middle) + scale)).drop("_q")


def _ungrouped(df: DataFrame, keys: list[str], *columns) -> DataFrame:
    return df.select(*(F.col("_g")[k].alias(k) for k in keys), *columns)


def paired_tests(rows: DataFrame, keys: list[str], test: str = "wilcoxon", least: int = 4) -> DataFrame:
    """keys, n, statistic, p_value, test for subjects' control and treatment values.

    The signed-rank test falls back to the paired t test where all differences are 0. Ranks are running sums over the
    distinct differences in buckets of their size, so a group of any length is many tasks; one row a group gets its p.
    """
    d = F.col("treatment") - F.col("control")
    kept = rows.select(F.struct(*keys).alias("_g"), F.when(F.abs(d) < math.inf, d).alias("_d"))
    whole = kept.groupBy("_g").agg(F.count("_d").alias("n"), F.avg("_d").alias("_mean"), F.stddev_samp("_d").alias("_sd"), F.count_if(F.col("_d") == 0).alias("_zeros"))
    sizes = kept.where("_d != 0").groupBy("_g", F.abs("_d").alias("_x")).agg(F.count(F.lit(1)).alias("_c"), F.count_if(F.col("_d") > 0).alias("_plus"))
    ranked = buckets.running_sum(_spread("_x", sizes), ["_g"], F.col("_c"), "_last", ["_u", "_x"], 1 / 512)
    c = F.col("_c").cast("double")
    sums = ranked.groupBy("_g").agg(F.sum("_c").alias("_n"), F.sum((F.col("_last") - (c - 1) / 2) * F.col("_plus")).alias("_plus"), F.sum(c**3 - c).alias("_ties"))

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                statistic, p, name = math.nan, math.nan, "insufficient_n"
                if row.n >= least:
                    if test == "wilcoxon":
                        (statistic, p), name = kernels.signed_rank_p(int(row.n_nonzero), row.plus, row.n > row.n_nonzero, row.ties), "Wilcoxon signed-rank"
                    if test != "wilcoxon" or math.isnan(statistic):
                        t = row.mean / (row.sd / math.sqrt(row.n)) if row.sd > 0 else math.nan
                        statistic, p, name = t, float(kernels.t_two_sided(t, row.n - 1)), "Paired t-test" + " (fallback)" * (test == "wilcoxon")
                out.append((row.n, statistic, p, name))
            yield pdf[keys].assign(**dict(zip(("n", "statistic", "p_value", "test"), zip(*out, strict=True), strict=True))) if out else pdf[keys].assign(n=[], statistic=[], p_value=[], test=[])

    zero = lambda c, k: F.coalesce(c, F.lit(0)).alias(k)
    figures = _ungrouped(whole.join(sums, "_g", "left"), keys, "n", F.col("_mean").alias("mean"), F.coalesce("_sd", F.lit(0.0)).alias("sd"), zero(F.col("_n"), "n_nonzero"), F.coalesce("_plus", F.lit(0.0)).alias("plus"), F.coalesce("_ties", F.lit(0.0)).alias("ties"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return figures.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, statistic double, p_value double, test string")


def _resampled_medians(rows: DataFrame, value: str, draws: int, seed: int) -> DataFrame:
    """_g, draw: medians of resamples. Only the places of the middle values are drawn, by numbers of rows alone, and then
    looked up among the numbered values, so that no task holds a group."""
    counts = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).withColumn("_seed", F.pmod(F.xxhash64(F.to_json("_g"), F.lit(seed)), F.lit(1 << 62)))

    def draw(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                low, high = kernels.median_places(int(row.n), draws, int(row.seed))
                yield pd.DataFrame({"text": row.text, "draw_id": np.arange(draws), "low": low, "high": high})

    texts = counts.select(F.to_json("_g").alias("text"), F.col("_n").alias("n"), F.col("_seed").alias("seed"))
    places = texts.mapInPandas(draw, "text string, draw_id long, low long, high long")
    wanted = places.select("text", "draw_id", F.explode(F.array("low", "high")).alias("_place"))
    numbered = buckets.numbered(_spread(value, rows), ["_g"], ["_u", value], "_place", 1 / 512)
    met = wanted.join(numbered.withColumn("text", F.to_json("_g")), ["text", "_place"])
    return met.groupBy("text", "draw_id").agg(F.first("_g").alias("_g"), F.avg(value).alias("draw")).select("_g", "draw")


#: Rows of a part of a group whose means are resampled.
PART = 1 << 16


def _resampled_means(rows: DataFrame, value: str, draws: int, seed: int, part_rows: int) -> DataFrame:
    """_g, draw: means of resamples. A group is cut into parts; each finds how many of its rows each resample holds and adds
    up as many of its values, and only these sums are shuffled."""
    counts = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).withColumn("_seed", F.pmod(F.xxhash64(F.to_json("_g"), F.lit(seed)), F.lit(1 << 62)))
    numbered = buckets.numbered(_spread(value, rows), ["_g"], ["_u", value], "_place", 1 / 512)
    parts = numbered.withColumn("_part", F.floor(F.col("_place") / part_rows)).join(counts, "_g")
    parts = parts.select(F.to_json("_g").alias("text"), "_part", "_n", "_seed", value)

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        n, number, key = int(part["_n"].iloc[0]), int(part["_part"].iloc[0]), int(part["_seed"].iloc[0])
        picked = kernels.part_counts(n, number, part_rows, draws, key)
        return pd.DataFrame({"text": part["text"].iloc[0], "draw_id": np.arange(draws), "s": kernels.part_sums(np.sort(part[value].to_numpy(float)), picked, number, key)})

    sums = parts.groupBy("text", "_part").applyInPandas(draw, "text string, draw_id long, s double").groupBy("text", "draw_id").agg(F.sum("s").alias("s"))
    return sums.join(counts.withColumn("text", F.to_json("_g")), "text").select("_g", (F.col("s") / F.col("_n")).alias("draw"))


def bootstrap_interval(rows: DataFrame, keys: list[str], value: str, statistic: str = "median", draws: int = 10_000, level: float = 0.95, seed: int = 0, part_rows: int = PART) -> DataFrame:
    """keys, point, low, high: percentile interval of resamples; no task holds more than a part of a group.

    Medians cost the same at any size of a group, means ``draws`` times its rows.
    """
    kept = rows.dropna(subset=[value]).select(F.struct(*keys).alias("_g"), F.col(value).cast("double").alias(value))
    drawn = _resampled_medians(kept, value, draws, seed) if statistic == "median" else _resampled_means(kept, value, draws, seed, part_rows)
    alpha = (1 - level) / 2
    ends = drawn.groupBy("_g").agg(F.percentile("draw", alpha).alias("low"), F.percentile("draw", 1 - alpha).alias("high"))
    if statistic == "median":
        point = exact_quantiles(rows, keys, value, {"point": 0.5}).select(F.struct(*keys).alias("_g"), "point")
    else:
        point = rows.groupBy(F.struct(*keys).alias("_g")).agg(F.avg(value).alias("point"))
    return _ungrouped(point.join(ends, "_g"), keys, "point", "low", "high")


def mutual_information(tuning: DataFrame, keys: list[str], rate: str = "rate", occupancy: str = "occupancy") -> DataFrame:
    """Skaggs information of each tuning curve (a row a bin): keys, bits_per_second, bits_per_event."""
    total = tuning.groupBy(*keys).agg(F.sum(occupancy).alias("_total"), (F.sum(F.col(occupancy) * F.col(rate)) / F.nullif(F.sum(F.when(F.lit(True), F.col(occupancy).cast("double"))), F.lit(0.0))).alias("_mean"))
    rows = tuning.join(total, keys)
    p = F.col(occupancy) / F.nullif(F.col("_total").cast("double"), F.lit(0.0))
    term = F.when((F.col(rate) > 0) & (F.col("_mean") > 0), p * F.col(rate) * F.log2(F.col(rate) / F.col("_mean"))).otherwise(F.lit(0.0))
    out = rows.groupBy(*keys).agg(F.sum(term).alias("bits_per_second"), F.first("_mean").alias("_mean"))
    return out.select(*keys, "bits_per_second", F.when(F.col("_mean") > 0, F.col("bits_per_second") / F.col("_mean")).alias("bits_per_event"))


def hexagons(points: DataFrame, x0: float, x1: float, y0: float, y1: float, grid: int = 50, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts in hexagonal cells: keys, lattice (0 or 1), i, j, n. Two rectangular lattices, shifted by half a cell; a
    point falls to the nearer centre. Cells lie within the given extents, ``grid`` of them across."""
    ny = int(grid / math.sqrt(3))
    sx, sy = (x1 - x0) / grid, (y1 - y0) / ny
    ix, iy = (F.col("x") - x0) / sx, (F.col("y") - y0) / sy
    i1, j1, i2, j2 = F.rint(ix), F.rint(iy), F.floor(ix), F.floor(iy)
    d1 = (ix - i1) ** 2 + 3 * (iy - j1) ** 2
    d2 = (ix - i2 - 0.5) ** 2 + 3 * (iy - j2 - 0.5) ** 2
    first = d1 < d2
    cell = [F.when(first, 0).otherwise(1).alias("lattice"), F.when(first, i1).otherwise(i2).cast("int").alias("i"), F.when(first, j1).otherwise(j2).cast("int").alias("j")]
    inside = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return inside.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("n"))


def pooled_extents(points: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """1st and 99th percentiles of x and y: one row."""
    ends = [exact_quantiles(points, [], c, {f"{c}_low": low, f"{c}_high": high}) for c in ("x", "y")]
    return ends[0].crossJoin(F.broadcast(ends[1]))  # one row each


def outlier_flags(rows: DataFrame | Sparse, keys: list[str], value: str = "value", limit: float = 3.0, rest: int = REST) -> DataFrame:
    """Adds is_outlier: further from the median than 3 * 1.4826 median absolute deviations, or not finite.

    Sparse recordings of up to ``rest`` samples are each flagged in a task, in one pass.
    """
    if isinstance(rows, Sparse):
        return _sparse_outliers(rows, keys, value, limit, rest)
    x = F.col(value)
    finite = F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    fine = rows.where(finite)
    centre = written(exact_quantiles(fine, keys, value, {"_median": 0.5}), "medians")
    away = fine.join(centre.hint("shuffle_hash"), keys).withColumn("_away", F.abs(x - F.col("_median")))
    spread = centre.join(exact_quantiles(away, keys, "_away", {"_mad": 0.5}), keys)
    out = rows.join(spread.hint("shuffle_hash"), keys, "left")
    return out.withColumn("is_outlier", ~finite | F.coalesce(F.abs(x - F.col("_median")) > limit * 1.4826 * F.col("_mad"), F.lit(True))).drop("_median", "_mad")


def _sparse_outliers(rows: Sparse, keys: list[str], value: str, limit: float, rest: int) -> DataFrame:
    def run(row) -> dict:
        x = getattr(row, value)
        fine = row.known & np.isfinite(x)
        outlier = np.ones(len(x), bool)
        if fine.any():
            away = np.abs(x[fine] - np.median(x[fine]))
            outlier[fine] = away > limit * 1.4826 * np.median(away)
        return {"idx": row.at, value: x, "is_outlier": outlier, "_known": row.known}

    sizes = rows.sizes(keys)
    mixed = not sizes.where(F.col("_n") > rest).isEmpty()
    some = lambda kept: Sparse(rows.rows.join(sizes.where(kept).select(*keys).hint("shuffle_hash"), keys), rows.values, rows.fill)
    packed = chunks(some(F.col("_n") <= rest) if mixed else rows, keys, None, values=(value,))
    flagged = by_chunk(packed, keys, f"idx long, {value} double, is_outlier boolean, _known boolean", run)
    flagged = flagged.select(*keys, "idx", F.when(F.col("_known"), F.col(value)).alias(value), "is_outlier")
    if not mixed:
        return flagged
    return flagged.unionByName(outlier_flags(some(F.col("_n") > rest).samples(keys), keys, value, limit).select(*flagged.columns))


def percentile_limits(rows: DataFrame, keys: list[str], value: str = "value", low: float = 5, high: float = 95) -> DataFrame:
    """keys, low, high: percentiles of the non-null values."""
    return exact_quantiles(rows, keys, value, {"low": low / 100, "high": high / 100})


def envelope(traces: DataFrame, keys: list[str], limit: int, idx: str = "idx") -> DataFrame:
    """Min/max downsample: keys, idx, value with at most ``limit`` points a trace, which keep every extreme.

    The range is cut into limit / 2 buckets; each gives its first smallest and first largest sample. Traces of ``limit``
    samples or fewer stay whole.
    """
    # written, so that no task sorts and holds what lies behind the samples twice
    ends = written(traces.groupBy(*keys).agg(F.min(idx).alias("_low"), F.count(F.lit(1)).alias("_n")), "trace-ends")
    buckets = max(limit // 2, 1)
    rows = traces.join(ends.hint("shuffle_hash"), keys).withColumn("_b", F.floor((F.col(idx) - F.col("_low")) * buckets / F.col("_n")))
    rows = rows.withColumn("_b", F.when(F.col("_n") <= limit, F.col(idx)).otherwise(F.col("_b")))
    best = rows.groupBy(*keys, "_b").agg(F.min(F.struct("value", idx)).alias("_min"), F.max(F.struct("value", (-F.col(idx)).alias("_m"))).alias("_max"))
    low, high = F.struct(F.col(f"_min.{idx}").alias(idx), F.col("_min.value").alias("value")), F.struct((-F.col("_max._m")).alias(idx), F.col("_max.value").alias("value"))
    return best.select(*keys, F.explode(F.array_distinct(F.array(low, high))).alias("_e")).select(*keys, f"_e.{idx}", "_e.value")
