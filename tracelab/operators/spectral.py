"""Time-frequency features of samples.

Convolutions and Fourier transforms of one array have no built-in expression that is not
quadratic, so these are Arrow-batched functions of the feature array: no shuffle, numpy inside
the task, one array in and one array out.  Images are flattened row by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.quantile import let
from tracelab.operators.normalise import array_sum, cells_of

# fixed values: decomposition low-pass taps
TAPS = {
    "haar": [0.7071067811865476, 0.7071067811865476],
    "db4": [
        -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
        -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
    ],
    "coif1": [
        -0.01565572813546454, -0.0727326195128539, 0.38486484686420286,
        0.8525720202122554, 0.3378976624578092, -0.0727326195128539,
    ],
}


# cells a batch may hold on its way back from Python: an image is many times its sample
BATCH_CELLS = 2_000_000


def map_arrays(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Replace each feature array by what ``fn`` makes of it; ``fn`` takes a stack of arrays of one length, one per row, and gives a row for each.

    Other columns stay Arrow arrays.  Results leave in slices of bounded size, so a wide image never piles up in a worker.
    """
    at = df.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 64  # cells out for a cell in, as far as seen
        for batch in batches:
            ends = batch.column(at).offsets.to_numpy()
            sizes = np.diff(ends)
            start = 0
            while start < len(sizes):
                same = np.nonzero(sizes[start:] != sizes[start])[0]
                most = max(1, BATCH_CELLS // max(1, int(sizes[start]) * wide))
                stop = min(start + most, start + int(same[0]) if len(same) else len(sizes))
                part = batch.slice(start, stop - start)
                stack = part.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(stop - start, -1)
                out = np.asarray(fn(stack), dtype=float).reshape(stop - start, -1)
                wide = max(wide, out.shape[1] // max(1, stack.shape[1]) + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([lists if i == at else c for i, c in enumerate(part.columns)], part.schema.names)
                start = stop

    return df.mapInArrow(run, df.schema)


# -- short-time Fourier ------------------------------------------------------


def stft_frames(n: int, width: int) -> int:
    """Frames of the half-overlapping, zero-extended transform."""
    hop = width - width // 2
    padded = n + 2 * (width // 2)
    return -(-(padded - width) // hop) + 1


def stft_power(df: DataFrame, width: int) -> DataFrame:
    """Power of the Hann-windowed, half-overlapping, zero-extended transform.

    Flattened ``[frequency × frame]``; scaled by the window's sum.
    """

    def power(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        hop, frames = width - width // 2, stft_frames(n, width)
        padded = np.zeros((len(x), (frames - 1) * hop + width))
        padded[:, width // 2 : width // 2 + n] = x
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
        cut = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[:, ::hop]
        spectrum = np.fft.rfft(cut * window, axis=2) / window.sum()
        return (spectrum.real**2 + spectrum.imag**2).transpose(0, 2, 1)

    return map_arrays(df, power)


# -- continuous wavelets -----------------------------------------------------


def dyadic_scales(octaves: int, step: float = 0.1, every: int = 1) -> list[float]:
    """Scales from 2 on over the given octaves, ``1 / step`` voices in each, optionally thinned."""
    voices = round(1 / step)
    return [2.0 ** (1 + i / voices) for i in range(0, octaves * voices, every)]


def wavelet_hat(wavelet: str, f0: float) -> tuple[Callable[[np.ndarray], np.ndarray], float]:
    """Fourier transform of the wavelet, and its wavelength per scale."""
    if wavelet == "morlet":
        return (
            lambda w: np.pi**-0.25 * np.exp(-0.5 * (w - f0) ** 2),
            4 * np.pi / (f0 + np.sqrt(2 + f0**2)),
        )
    if wavelet == "mexican_hat":
        norm = np.sqrt(0.75 * np.sqrt(np.pi))
        return lambda w: w**2 * np.exp(-0.5 * w**2) / norm, 2 * np.pi / np.sqrt(2.5)
    raise ValueError(f"unknown wavelet {wavelet}")


def cwt_array(x: np.ndarray, scales: Sequence[float], wavelet: str, f0: float) -> np.ndarray:
    """Complex coefficients ``[row × scale × position]`` of a stack of arrays, zero-padded to a power of two."""
    n = x.shape[1]
    size = 1 << max(n - 1, 1).bit_length()
    hat, _ = wavelet_hat(wavelet, f0)
    omega = 2 * np.pi * np.fft.fftfreq(size)
    s = np.asarray(scales)[:, None]
    filters = np.sqrt(s * omega[1] * size) * hat(s * omega)
    return np.fft.ifft(np.fft.fft(x, size, axis=1)[:, None, :] * filters, axis=2)[:, :, :n]


def influence_limit(n: int, scales: int, wavelet: str = "morlet", f0: float = 6.0) -> np.ndarray:
    """First masked scale index per position: the log cone stretched over the scale axis (S3)."""
    _, wavelength = wavelet_hat(wavelet, f0)
    from_edge = 0.5 + np.minimum(np.arange(n), np.arange(n)[::-1])  # the cone is as wide as a position is far from its nearer end
    height = np.log2(from_edge * wavelength / np.sqrt(2))
    height -= height[0]
    top = height.max()
    return np.floor(scales * (height / top if top > 0 else height)).astype(int)


def cwt_magnitude(
    df: DataFrame, scales: Sequence[float], *, wavelet: str = "morlet", f0: float = 6.0, cone: bool = False
) -> DataFrame:
    """Magnitude image flattened ``[scale × position]`` (S2); ``cone`` nulls cells outside it (S3)."""
    wanted = list(scales)

    def magnitude(x: np.ndarray) -> np.ndarray:
        image = np.abs(cwt_array(x, wanted, wavelet, f0))
        if cone:
            limit = influence_limit(x.shape[1], len(wanted), wavelet, f0)
            image = np.where(np.arange(len(wanted))[:, None] >= limit[None, :], np.nan, image)
        return image

    out = map_arrays(df, magnitude)
    if cone:
        out = out.withColumn("features", F.transform("features", lambda v: F.when(~F.isnan(v), v)))
    return out


def cwt_deviation(
    df: DataFrame, scales: Sequence[float], *, wavelet: str = "morlet", f0: float = 6.0, cone: bool = False
) -> DataFrame:
    """Deviation over time per scale straight from the samples (S2 to S4 in one step).

    Only one value per scale leaves the task instead of the whole image.
    """
    wanted = list(scales)

    def deviation(x: np.ndarray) -> np.ndarray:
        image = np.abs(cwt_array(x, wanted, wavelet, f0))
        if cone:
            limit = influence_limit(x.shape[1], len(wanted), wavelet, f0)
            image = np.where(np.arange(len(wanted))[:, None] >= limit[None, :], np.nan, image)
        known = ~np.isnan(image)
        n = np.maximum(known.sum(axis=2), 1)
        mean = np.where(known, image, 0).sum(axis=2) / n
        spread = np.where(known, image - mean[:, :, None], 0)
        return np.where(known.any(axis=2), np.sqrt((spread**2).sum(axis=2) / n), np.nan)

    out = map_arrays(df, deviation)
    return out.withColumn("features", F.transform("features", lambda v: F.when(~F.isnan(v), v)))


def scale_deviation(df: DataFrame, width: int) -> DataFrame:
    """Population deviation over time of each image row of ``width`` cells, nulls skipped."""
    rows = F.sequence(F.lit(0), (F.size("features") / width).cast("int") - 1)

    def spread(row: Column) -> Column:
        squares = let(
            array_sum(row) / F.size(row),
            lambda mean: array_sum(F.transform(row, lambda v: (v - mean) * (v - mean))),
        )
        return F.when(F.size(row) > 0, F.sqrt(squares / F.size(row)))

    def deviation(image: Column) -> Column:
        def of_row(i: Column) -> Column:
            cells = F.slice(image, i * width + 1, F.lit(width))
            return let(F.filter(cells, lambda v: v.isNotNull()), spread)

        return F.transform(rows, of_row)

    return df.withColumn("features", let(F.col("features"), deviation))


def class_mean_image(df: DataFrame, width: int, label: str = "label") -> DataFrame:
    """Mean image per class as ``(label, scale, pos, mean)``."""
    return (
        cells_of(df, label)
        .groupBy(label, F.floor(F.col("pos") / width).alias("scale"), F.pmod("pos", F.lit(width)).alias("pos"))
        .agg(F.avg("x").alias("mean"))
    )


# -- series of any length ----------------------------------------------------


def morlet_kernel(scale: float, f0: float = 6.0, reach: float = 5.0) -> np.ndarray:
    """The wavelet in time, cut at ``reach`` scales on both sides (its weight there is below ``exp(-reach ** 2 / 2)``)."""
    t = np.arange(-math.ceil(reach * scale), math.ceil(reach * scale) + 1)
    return np.pi**-0.25 / np.sqrt(scale) * np.exp(1j * f0 * t / scale - (t / scale) ** 2 / 2)


def long_magnitude(trace: DataFrame, kernels: Sequence[np.ndarray], *, block: int = 4096) -> DataFrame:
    """``(series_id, pos, scale, x)``: magnitude of each gridded series folded with every kernel, for series of any length.

    ``trace``: ``(series_id, pos, value)`` without nulls; beyond its ends a series is zero.  Blocks take as many cells of their neighbours as the
    widest kernel reaches, are transformed by themselves and keep their own cells only, so that the result does not depend on ``block`` and
    a task holds one block.
    """
    reach = max(len(k) for k in kernels) // 2
    first, last = F.floor((F.col("pos") - reach) / block), F.floor((F.col("pos") + reach) / block)
    cut = trace.select("series_id", "pos", F.col("value").cast("double").alias("value"), F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("block"))

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        start = key[1].as_py() * block - reach
        pos = table.column("pos").to_numpy() - start
        cells = np.zeros(block + 2 * reach)
        cells[pos] = table.column("value").to_numpy()
        size = 1 << (len(cells) + 2 * reach).bit_length()
        spectrum = np.fft.fft(cells, size)
        own = np.sort(pos[(pos >= reach) & (pos < reach + block)])
        out = []
        for kernel in kernels:
            half = len(kernel) // 2
            out.append(np.abs(np.fft.ifft(spectrum * np.fft.fft(kernel, size))[own + half]))
        n = len(own)
        return pa.table({
            "series_id": pa.array([key[0].as_py()] * (n * len(kernels)), table.column("series_id").type), "pos": pa.array(np.tile(own + start, len(kernels)), pa.int64()),
            "scale": pa.array(np.repeat(np.arange(len(kernels)), n), pa.int32()), "x": pa.array(np.concatenate(out)),
        })

    kind = trace.schema["series_id"].dataType.simpleString()
    return cut.groupBy("series_id", "block").applyInArrow(fold, f"series_id {kind}, pos long, scale int, x double")


# -- discrete wavelets -------------------------------------------------------


def high_pass(low: Sequence[float]) -> np.ndarray:
    h = np.asarray(low)[::-1].copy()
    h[::2] *= -1
    return h


def dwt_level(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of a stack of arrays with half-sample symmetric edges."""
    taps = len(low)
    ext = np.pad(x, ((0, 0), (taps - 1, taps - 1)), mode="symmetric")
    cut = np.lib.stride_tricks.sliding_window_view(ext, taps, axis=1)[:, 1::2]
    return cut @ low[::-1], cut @ high[::-1]


def max_level(n: int, taps: int) -> int:
    return max(int(np.floor(np.log2(n / (taps - 1)))), 0)


def wavedec(x: np.ndarray, wavelet: str) -> list[np.ndarray]:
    """Coarsest approximation, then details from coarse to fine."""
    low, high = np.asarray(TAPS[wavelet]), high_pass(TAPS[wavelet])
    details = []
    for _ in range(max_level(x.shape[1], len(low))):
        x, d = dwt_level(x, low, high)
        details.append(d)
    return [x, *details[::-1]]


def dwt_scalogram(df: DataFrame, wavelet: str = "coif1") -> DataFrame:
    """Detail levels stretched to the time axis, the two coarsest sets left out."""

    def image(x: np.ndarray) -> np.ndarray:
        kept = wavedec(x, wavelet)[2:]
        width = 2 * kept[-1].shape[1]
        return np.concatenate([np.repeat(c, 2 ** (len(kept) - i), axis=1)[:, :width] for i, c in enumerate(kept)], axis=1)

    return map_arrays(df, image)


def circle_index(n: int, taps: int, k: int) -> np.ndarray:
    """Cells that tap ``k`` of an even circle of ``n`` cells reads."""
    return (2 * np.arange(n // 2) + taps // 2 - k) % n


def denoise(df: DataFrame, share: float, wavelet: str = "db4", levels: int | None = None) -> DataFrame:
    """Soft-threshold the details at ``share`` of the sample's maximum and rebuild."""
    low = np.asarray(TAPS[wavelet])
    high = high_pass(low)

    def clean(x: np.ndarray) -> np.ndarray:
        limit = share * np.nanmax(x, axis=1, keepdims=True)
        depth = max_level(x.shape[1], len(low)) if levels is None else levels
        steps, rest = [], x
        for _ in range(depth):
            size = rest.shape[1]
            even = np.append(rest, rest[:, -1:], axis=1) if size % 2 else rest
            at = [circle_index(even.shape[1], len(low), k) for k in range(len(low))]
            detail = sum(high[k] * even[:, at[k]] for k in range(len(low)))
            kept = np.sign(detail) * np.maximum(np.abs(detail) - limit, 0)
            steps.append((at, kept, size))
            rest = sum(low[k] * even[:, at[k]] for k in range(len(low)))
        for at, detail, size in reversed(steps):
            built = np.zeros((len(detail), 2 * detail.shape[1]))
            for k in range(len(low)):
                built[:, at[k]] += low[k] * rest + high[k] * detail
            rest = built[:, :size]
        return rest

    return map_arrays(df, clean)


def fourier_resample(df: DataFrame, resolution: float = 0.7) -> DataFrame:
    """Fourier up-sampling to ``ceil(n / resolution)`` points."""

    def stretch(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        size = int(np.ceil(n / resolution))
        spectrum = np.fft.rfft(x, axis=1)
        wide = np.zeros((len(x), size // 2 + 1), dtype=complex)
        keep = min(n, size) // 2 + 1
        wide[:, :keep] = spectrum[:, :keep]
        if min(n, size) % 2 == 0 and size != n:
            wide[:, min(n, size) // 2] *= 0.5 if size > n else 2.0
        return np.fft.irfft(wide, size, axis=1) * size / n

    return map_arrays(df, stretch)


def availability_weights(df: DataFrame, levels: int) -> DataFrame:
    """Availability of each position, accumulated level by level over widening pieces.

    Level 0 is 1 where the cell is known; each next level sums the level below over pieces of
    ``2 · level`` cells, from the second on over the distinct values of a piece; the last,
    shorter piece always over distinct values.  Flattened from the widest level down.
    """
    out = df.withColumn("_w0", F.transform("features", lambda x: F.when(x.isNull(), F.lit(0.0)).otherwise(F.lit(1.0))))
    for k in range(1, levels):

        def widen(below: Column, k=k, size=2 * k) -> Column:
            starts = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / size).cast("int"))

            def total(i: Column) -> Column:
                piece = F.slice(below, i * size + 1, F.lit(size))
                spread = F.array_distinct(piece)
                used = spread if k > 1 else F.when(F.size(piece) < size, spread).otherwise(piece)
                return F.aggregate(used, F.lit(0.0), lambda a, x: a + x)

            def stretched(sums: Column) -> Column:
                return F.transform(below, lambda _, i: F.get(sums, F.floor(i / size).cast("int")))

            return let(F.transform(starts, total), stretched)

        out = out.withColumn(f"_w{k}", let(F.col(f"_w{k - 1}"), widen))
    flat = F.concat(*[F.col(f"_w{k}") for k in reversed(range(levels))])
    return out.withColumn("features", flat).select(*df.columns)
