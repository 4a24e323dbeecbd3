"""Surrogate event trains, permutation tests and functions over units.

A draw's random numbers are the SplitMix64 sequence whose key is the beginning of SHA-256 of ``seed:recording:unit:replicate``, so
they depend on nothing else and other engines can replay them. Trains are packed as one sorted array each and go, with a
block of draws, to a task; surrogates are made there and either written out or folded into a statistic at once, so that no
surrogate is ever shuffled or sorted by Spark. A long train's draws are cut into as many blocks as keep all tasks busy. A task
holds one train and one draw of it, 8 bytes an event each (Poisson draws need the number of events alone).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["recording_id", "unit_id"]

#: Values that a block of draws makes, about.
BLOCK = 1 << 20

# SplitMix64: fixed values.
_GAMMA, _MIX_1, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def stream_key(seed: int, recording, unit, replicate: int) -> int:
    name = ":".join("" if x is None else str(x) for x in (seed, recording, unit, replicate))
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")


def bits(key: int, n: int) -> np.ndarray:
    """The first ``n`` numbers of a key's sequence, 53 bits each."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64)
        z *= _GAMMA
        z += np.uint64(key)
        moved = np.empty_like(z)
        for by, mix in ((30, _MIX_1), (27, _MIX_2), (31, None)):
            z ^= np.right_shift(z, np.uint64(by), out=moved)
            if mix is not None:
                z *= mix
        z >>= np.uint64(11)
        return z


def uniforms(key: int, n: int) -> np.ndarray:
    """The same in [0, 1)."""
    return bits(key, n) / float(1 << 53)


@dataclass(frozen=True)
class Jitter:
    """t plus a uniform number within +-max_jitter; events that leave the support, if given, are dropped."""

    max_jitter: float
    support: tuple[float, float] | None = None

    def __post_init__(self):
        if self.max_jitter <= 0:
            raise ValueError("max_jitter has to be positive")

    def __call__(self, times: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray | None]:
        moved = times + (2 * uniforms(key, len(times)) - 1) * self.max_jitter
        return moved, None if self.support is None else (moved >= self.support[0]) & (moved <= self.support[1])


@dataclass(frozen=True)
class Shift:
    """One random shift for each train; events beyond the support are dropped or wrapped round."""

    t_start: float
    t_end: float
    mode: str = "drop"
    min_shift: float = 0.0
    max_shift: float | None = None

    def __post_init__(self):
        if self.t_end <= self.t_start or self.mode not in ("drop", "wrap"):
            raise ValueError("the support is empty or the mode unknown")
        if self._most() < self.min_shift:
            raise ValueError("max_shift has to be min_shift at least")

    def _most(self) -> float:
        return self.t_end - self.t_start if self.max_shift is None else self.max_shift

    def __call__(self, times: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray | None]:
        moved = times + (self.min_shift + float(uniforms(key, 1)[0]) * (self._most() - self.min_shift))
        if self.mode == "wrap":
            return self.t_start + np.mod(moved - self.t_start, float(self.t_end - self.t_start)), None
        return moved, (moved >= self.t_start) & (moved <= self.t_end)


def random_order(key: int, n: int) -> np.ndarray:
    """Places of the first ``n`` numbers of a key's sequence by size, equal ones in their order.

    Each number, less the lowest bits that do not fit, is sorted as one word with its place; the few with equal words but for the
    place are then put in order by the whole numbers.
    """
    numbers = bits(key, n)
    width = np.uint64(max(n - 1, 1).bit_length())
    words = numbers >> np.uint64(max(53 + int(width) - 64, 0))
    words <<= width
    words |= np.arange(n, dtype=np.uint64)
    words.sort()
    order = (words & np.uint64((1 << int(width)) - 1)).astype(np.int64)
    words >>= width
    same = words[1:] == words[:-1]
    if same.any():
        at = np.flatnonzero(np.append(same, False) | np.append(False, same))
        tied = order[at]
        order[at] = tied[np.lexsort((tied, numbers[tied]))]
    return order


@dataclass(frozen=True)
class ShuffleIntervals:
    """The intervals of each train in another order, from the same first event."""

    #: Surrogates of sorted times are sorted.
    ordered = True

    def __call__(self, times: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray | None]:
        gaps = np.diff(times)[random_order(key, max(len(times) - 1, 0))]
        return times[:1].repeat(len(times)) + np.concatenate([np.zeros(1, times.dtype), np.cumsum(gaps)])[: len(times)], None


@dataclass(frozen=True)
class Poisson:
    """As many uniform times on the support as each train has events, or ``events`` of them."""

    t_start: float
    t_end: float
    events: int | None = None

    def __post_init__(self):
        if self.t_end <= self.t_start:
            raise ValueError("the support is empty")

    def __call__(self, times: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray | None]:
        n = len(times) if self.events is None else self.events
        return self.t_start + uniforms(key, n) * (self.t_end - self.t_start), None


Surrogate = Jitter | Shift | ShuffleIntervals | Poisson


def packed(trains: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a train: keys and its sorted times; events without a time are left out."""
    return trains.groupBy(*(keys or KEYS)).agg(F.sort_array(F.collect_list("t")).alias("times")).where("size(times) > 0")


def _blocks(trains: DataFrame, draws: int) -> DataFrame:
    """Packed trains, each as often as its draws are cut into blocks: keys, times, _from, _upto."""
    tasks = 2 * trains.sparkSession.sparkContext.defaultParallelism
    rows = packed(trains).withColumn("_blocks", F.least(F.lit(tasks), F.lit(draws), F.ceil(F.size("times") * float(draws) / BLOCK)).cast("int"))
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    edge = lambda b: F.floor(b * F.lit(draws) / F.col("_blocks")).cast("long")
    return rows.repartition(tasks, *KEYS, "_b").select(*KEYS, "times", edge(F.col("_b")).alias("_from"), edge(F.col("_b") + 1).alias("_upto"))


def _each(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple]:
    """recording, unit, times, and the draws' numbers and keys, block by block."""
    for batch in batches:
        recordings, units, lists, first, upto = (batch.column(i) for i in range(5))
        for row in range(batch.num_rows):
            recording, unit = recordings[row].as_py(), units[row].as_py()
            draws = range(first[row].as_py(), upto[row].as_py())
            yield recording, unit, lists[row].values.to_numpy(zero_copy_only=False), ((d, stream_key(seed, recording, unit, d)) for d in draws)


def _sorted_draw(surrogate: Surrogate, times: np.ndarray, key: int) -> np.ndarray:
    moved, kept = surrogate(times, key)
    moved = moved if kept is None else moved[kept]
    return moved if getattr(surrogate, "ordered", False) else np.sort(moved)


def _key_fields(trains: DataFrame) -> tuple[str, list[pa.Field]]:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [trains.schema[k].dataType for k in KEYS]
    return ", ".join(f"{k} {t.simpleString()}" for k, t in zip(KEYS, kinds, strict=True)), [pa.field(k, to_arrow_type(t)) for k, t in zip(KEYS, kinds, strict=True)]


def surrogates(trains: DataFrame, surrogate: Surrogate, n: int, seed: int = 0) -> DataFrame:
    """The events of ``n`` surrogates of every train: recording_id, unit_id, event_idx (that of the event moved), replicate, t."""
    names, fields = _key_fields(trains)
    schema = pa.schema([*fields, ("event_idx", pa.int64()), ("replicate", pa.int32()), ("t", pa.float64())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for recording, unit, times, draws in _each(batches, seed):
            for replicate, key in draws:
                moved, kept = surrogate(times, key)
                at = np.arange(len(moved)) if kept is None else np.flatnonzero(kept)
                columns = [pa.array([recording] * len(at), schema.types[0]), pa.array([unit] * len(at), schema.types[1]), at, np.full(len(at), replicate, np.int32), moved[at].astype(float)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    return _blocks(trains, n).mapInArrow(draw, f"{names}, event_idx long, replicate int, t double")


def jitter(trains: DataFrame, max_jitter: float, n: int, seed: int = 0, support: tuple[float, float] | None = None) -> DataFrame:
    """:class:`Jitter` surrogates, a row an event."""
    return surrogates(trains, Jitter(max_jitter, support), n, seed)


def shift(trains: DataFrame, t_start: float, t_end: float, n: int, seed: int = 0, mode: str = "drop", min_shift: float = 0.0, max_shift: float | None = None) -> DataFrame:
    """:class:`Shift` surrogates, a row an event."""
    return surrogates(trains, Shift(t_start, t_end, mode, min_shift, max_shift), n, seed)


def shuffle_intervals(trains: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """:class:`ShuffleIntervals` surrogates, a row an event."""
    return surrogates(trains, ShuffleIntervals(), n, seed)


def poisson(trains: DataFrame, t_start: float, t_end: float, n: int, seed: int = 0, events: int | None = None) -> DataFrame:
    """:class:`Poisson` surrogates, a row an event."""
    return surrogates(trains, Poisson(t_start, t_end, events), n, seed)


def surrogate_statistics(trains: DataFrame, surrogate: Surrogate, statistic: Callable[[np.ndarray], tuple], fields: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """``statistic`` (sorted times to a tuple of numbers named by ``fields``) of ``n`` draws of every train: keys, replicate, fields."""
    names, _ = _key_fields(trains)
    columns = [f.split()[0] for f in fields.split(",")]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for recording, unit, times, draws in _each(batches, seed):
            rows = [(recording, unit, replicate, *statistic(_sorted_draw(surrogate, times, key))) for replicate, key in draws]
            yield pa.RecordBatch.from_pylist([dict(zip([*KEYS, "replicate", *columns], r, strict=True)) for r in rows], schema=schema)

    out = f"{names}, replicate int, {fields}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(out))
    return _blocks(trains, n).mapInArrow(draw, out)


def surrogate_test(trains: DataFrame, surrogate: Surrogate, statistic: Callable[[np.ndarray], float], n: int = 1000, seed: int = 0, alternative: str = "two-sided") -> DataFrame:
    """Permutation test of every train: keys, observed, n_surrogates, p_value = (1 + draws as extreme) / (1 + draws).

    ``statistic`` is any function of a train's sorted times. Each task counts the extreme draws of its blocks, and only
    these counts are added up. A train whose own statistic is not a number has a null p-value; such draws are never extreme.
    """
    extreme = _extreme(alternative)
    names, fields = _key_fields(trains)
    schema = pa.schema([*fields, ("observed", pa.float64()), ("n", pa.int64()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for recording, unit, times, draws in _each(batches, seed):
            observed = float(statistic(times))
            values = np.array([float(statistic(_sorted_draw(surrogate, times, key))) for _, key in draws])
            row = {KEYS[0]: recording, KEYS[1]: unit, "observed": observed, "n": len(values), "c": int(extreme(values, observed).sum())}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    counted = _blocks(trains, n).mapInArrow(count, f"{names}, observed double, n long, c long")
    out = counted.groupBy(*KEYS).agg(F.first("observed").alias("observed"), F.sum("n").alias("n_surrogates"), F.sum("c").alias("_c"))
    return out.select(*KEYS, "observed", "n_surrogates", F.when(~F.isnan("observed"), (1 + F.col("_c")) / (1 + F.col("n_surrogates"))).alias("p_value"))


def _extreme(alternative: str) -> Callable:
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError("alternative is two-sided, greater or less")
    return {"two-sided": lambda s, o: abs(s) >= abs(o), "greater": lambda s, o: s >= o, "less": lambda s, o: s <= o}[alternative]


def share_close(width: float, steps: int = 1) -> Callable[[np.ndarray], float]:
    """Statistic: share of the events whose ``steps``-th next one follows within less than ``width``."""

    def statistic(times: np.ndarray) -> float:
        gaps = times[steps:] - times[:-steps]
        return float((gaps < width).mean()) if len(gaps) else math.nan

    return statistic


def apply_to_units(trains: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` over the train of each unit (recording_id, unit_id, t, sorted by t)."""
    return trains.groupBy(*KEYS).applyInPandas(lambda g: fn(g.sort_values("t", ignore_index=True)), schema)


def permutation_test(observed: DataFrame, null: DataFrame, keys: list[str], alternative: str = "two-sided", statistic: str = "statistic") -> DataFrame:
    """keys, observed, n_surrogates, p_value = (1 + draws as extreme) / (1 + draws).

    ``observed``: keys, statistic. ``null``: keys, replicate, statistic, a row for each draw.
    """
    _extreme(alternative)
    s, o = F.col("_null"), F.col("observed")
    extreme = {"two-sided": F.abs(s) >= F.abs(o), "greater": s >= o, "less": s <= o}[alternative]
    rows = null.select(*keys, F.col(statistic).alias("_null")).join(observed.select(*keys, F.col(statistic).alias("observed")), keys)
    out = rows.groupBy(*keys, "observed").agg(F.count(F.lit(1)).alias("n_surrogates"), F.count_if(extreme).alias("_c"))
    return out.select(*keys, "observed", "n_surrogates", ((1 + F.col("_c")) / (1 + F.col("n_surrogates"))).alias("p_value"))
