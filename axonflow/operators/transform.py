"""Hilbert transform of signals of any length, over many tasks.

The imaginary part of the analytic signal is the circular convolution of the signal with a kernel in closed form. It is
taken as a product of Fourier transforms of length m = a * b, a power of two that holds twice the signal, and each transform is
done in two steps: sample ``i = i1 * b + i2`` lies in column ``i2``, frequency ``k = k1 + a * k2`` in row ``k1``. A task transforms some
columns (over i1), turns them by the twiddle factors and cuts them by rows; a task transforms some rows (over i2), multiplies
and transforms back; a task transforms some columns back. Signal and kernel are the two parts of one complex signal, told
apart by symmetry, for which row k1 and row a - k1 go to one task. So three shuffles of packed blocks do it, and no task
holds more than about ``CELLS`` complex numbers, or one row or column, the square root of the whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Complex numbers of a block.
CELLS = 1 << 19


def kernel(m: np.ndarray, n: int) -> np.ndarray:
    """Hilbert kernel of a signal of ``n`` samples at distances ``m`` (1 to n - 1), odd about 0."""
    angle = np.pi * m / n
    if n % 2 == 0:
        return np.where(m % 2 == 1, 2 / n / np.tan(angle), 0.0)
    return (np.cos(angle) - np.where(m % 2 == 1, -1.0, 1.0)) / np.sin(angle) / n


def _row_numbers(block: int, per_block: int, a: int) -> np.ndarray:
    """Rows of a block: k1 and a - k1 together."""
    u = np.arange(block * per_block, min((block + 1) * per_block, a // 2 + 1))
    return np.concatenate([u, a - u[(u > 0) & (u < a // 2)]])


def _twiddles(rows: np.ndarray, columns: np.ndarray, m: int) -> np.ndarray:
    return np.exp(-2j * np.pi * (rows[:, None] * columns[None, :] / m))


_SHAPE = ("_n", "_a", "_b", "_w", "_v")


def _shape(block: pa.Table) -> tuple[int, ...]:
    """Samples, rows, columns, columns of a block, row pairs of a block."""
    return tuple(block.column(c)[0].as_py() for c in _SHAPE)


def _repeated(block: pa.Table, names: list[str], n: int) -> list[pa.Array]:
    return [pa.repeat(block.column(c)[0], n) for c in names]


def hilbert(samples: DataFrame, keys: list[str], sizes: DataFrame, cells: int = CELLS) -> DataFrame:
    """keys, _p, _y: imaginary part of the analytic signal at each place.

    ``samples``: keys, _p (place from 0, without gaps), value; ``sizes``: keys, _n (samples), _mean, _scale (largest value).
    """
    shape = sizes.select(*keys, "_n", "_mean", F.greatest("_scale", F.lit(1e-300)).alias("_scale"), F.greatest(F.ceil(F.log2(2.0 * F.col("_n"))), F.lit(2)).cast("int").alias("_log"))
    power = lambda e: F.pow(F.lit(2.0), e).cast("int")
    shape = shape.withColumns({"_a": power(F.ceil(F.col("_log") / 2)), "_b": power(F.floor(F.col("_log") / 2))})
    shape = shape.withColumns({"_w": F.greatest(F.least(F.floor(F.lit(cells) / F.col("_a")), F.col("_b")), F.lit(1)).cast("int"), "_v": F.greatest(F.floor(F.lit(cells) / (2 * F.col("_b"))), F.lit(1)).cast("int")}).drop("_log")
    kinds = {f.name: f.dataType.simpleString() for f in [*samples.schema, *shape.schema]}
    typed = lambda names: ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def columns(block: pa.Table) -> pa.Table:
        n, a, b, w, v = _shape(block)
        first = block.column("_c")[0].as_py() * w
        place, m = block.column("_p").to_numpy(), a * b
        z = np.zeros((a, min(w, b - first)), complex)
        at = np.arange(a)[:, None] * b + np.arange(first, first + z.shape[1])[None, :]
        ahead, back = (at > 0) & (at < n), at > m - n
        z.imag[ahead], z.imag[back] = kernel(at[ahead], n), -kernel(m - at[back], n)
        z[place // b, place % b - first] += block.column("_x").to_numpy()
        z = np.fft.fft(z, axis=0) * _twiddles(np.arange(a), np.arange(first, first + z.shape[1]), m)
        blocks = range(-(-(a // 2 + 1) // v))
        cut = [np.ascontiguousarray(z[_row_numbers(r, v, a)]).tobytes() for r in blocks]
        return pa.table([*_repeated(block, [*keys, "_c", *_SHAPE], len(cut)), pa.array(blocks, pa.int32()), pa.array(cut, pa.binary())], names=[*keys, "_c", *_SHAPE, "_r", "_z"])

    def rows(block: pa.Table) -> pa.Table:
        n, a, b, w, v = _shape(block)
        k1 = _row_numbers(block.column("_r")[0].as_py(), v, a)
        order = np.argsort(block.column("_c").to_numpy())
        z = np.concatenate([np.frombuffer(block.column("_z")[int(i)].as_py(), complex).reshape(len(k1), -1) for i in order], axis=1)
        z = np.fft.fft(z, axis=1)
        where = {int(k): i for i, k in enumerate(k1)}
        partner = np.array([where[int(-k % a)] for k in k1])
        mirror = np.conj(z[partner[:, None], (-np.arange(b)[None, :] - (k1 > 0)[:, None]) % b])
        z = np.fft.ifft((z + mirror) * (z - mirror) / 4j, axis=1) * np.conj(_twiddles(k1, np.arange(b), a * b))
        starts = range(0, b, w)
        cut = [np.ascontiguousarray(z[:, s : s + w]).tobytes() for s in starts]
        numbers = pa.array([s // w for s in starts], pa.int32())
        return pa.table([*_repeated(block, keys, len(cut)), numbers, *_repeated(block, [*_SHAPE, "_r"], len(cut)), pa.array(cut, pa.binary())], names=[*keys, "_c", *_SHAPE, "_r", "_z"])

    def back(block: pa.Table) -> pa.Table:
        n, a, b, w, v = _shape(block)
        first = block.column("_c")[0].as_py() * w
        z = np.zeros((a, min(w, b - first)), complex)
        for r, data in zip(block.column("_r").to_pylist(), block.column("_z"), strict=True):
            z[_row_numbers(r, v, a)] = np.frombuffer(data.as_py(), complex).reshape(-1, z.shape[1])
        y = np.fft.ifft(z, axis=0).real
        at = np.arange(a)[:, None] * b + np.arange(first, first + z.shape[1])[None, :]
        kept = at < n
        return pa.table([*_repeated(block, keys, int(kept.sum())), pa.array(at[kept]), pa.array(y[kept])], names=[*keys, "_p", "_y"])

    moved = samples.join(shape, keys).withColumn("_x", (F.col("value") - F.col("_mean")) / F.col("_scale")).withColumn("_c", F.floor(F.col("_p") % F.col("_b") / F.col("_w")).cast("int"))
    kinds |= {"_c": "int", "_r": "int", "_z": "binary"}
    packed = typed([*keys, "_c", *_SHAPE, "_r", "_z"])
    out = moved.groupBy(*keys, "_c").applyInArrow(columns, packed).groupBy(*keys, "_r").applyInArrow(rows, packed).groupBy(*keys, "_c").applyInArrow(back, f"{typed(keys)}, _p long, _y double")
    return out.join(sizes.select(*keys, "_scale"), keys).select(*keys, "_p", (F.col("_y") * F.col("_scale")).alias("_y"))
