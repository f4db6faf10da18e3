"""Array kernels that columns can't express: Arrow batches through NumPy, one image a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _images(s: pd.Series, height: int, width: int) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64).reshape(height, width) for x in s]) if len(s) else np.zeros((0, height, width))


def gradient_score(image: str | Column, height: int, width: int, size: int = 3) -> Column:
    """The sum of gradient magnitudes under a smoothed derivative of an odd kernel size."""
    half = size // 2
    smooth = np.array([1.0])
    for _ in range(size - 1):
        smooth = np.convolve(smooth, [1.0, 1.0])
    slope = np.convolve(np.convolve(np.array([1.0]), [1.0, 0.0, -1.0]), np.array([1.0]) if size == 3 else _binomial(size - 3))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.pad(_images(s, height, width), ((0, 0), (half, half), (half, half)), mode="reflect")
            gx, gy = _separable(x, smooth, slope), _separable(x, slope, smooth)
            yield pd.Series(np.sqrt(gx * gx + gy * gy).sum(axis=(1, 2)))

    return run(image)


def _binomial(n: int) -> np.ndarray:
    out = np.array([1.0])
    for _ in range(n):
        out = np.convolve(out, [1.0, 1.0])
    return out


def _separable(x: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    x = sum(k * x[:, i : x.shape[1] - len(down) + 1 + i] for i, k in enumerate(down))
    return sum(k * x[:, :, i : x.shape[2] - len(across) + 1 + i] for i, k in enumerate(across))


#: Window size and deviation of structural similarity, and its two constants.
SSIM_WINDOW, SSIM_SIGMA, SSIM_K1, SSIM_K2 = 11, 1.5, 0.01, 0.03


def ssim(a: str | Column, b: str | Column, height: int, width: int, peak: float = 1.0) -> Column:
    """Structural similarity with a Gaussian window of 11 (or the image, if smaller), sigma 1.5."""
    n = min(SSIM_WINDOW, height if height % 2 else height - 1, width if width % 2 else width - 1)
    g = np.exp(-((np.arange(n) - n // 2) ** 2) / (2 * SSIM_SIGMA**2))
    g /= g.sum()
    c1, c2 = (SSIM_K1 * peak) ** 2, (SSIM_K2 * peak) ** 2

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, t in batches:
            x, y = _images(s, height, width), _images(t, height, width)
            mx, my = _separable(x, g, g), _separable(y, g, g)
            vx, vy, cov = _separable(x * x, g, g) - mx * mx, _separable(y * y, g, g) - my * my, _separable(x * y, g, g) - mx * my
            value = (2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))
            yield pd.Series(value.mean(axis=(1, 2)))

    return run(a, b)


def convolved(image: str | Column, kernel: np.ndarray, height: int, width: int) -> Column:
    """Convolution by FFT with zero borders; the result has the image's size."""
    kh, kw = kernel.shape
    shape = (height + kh - 1, width + kw - 1)
    spectrum = np.fft.rfft2(kernel, shape)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            full = np.fft.irfft2(np.fft.rfft2(_images(s, height, width), shape) * spectrum, shape)
            own = full[:, kh // 2 : kh // 2 + height, kw // 2 : kw // 2 + width]
            yield pd.Series(list(own.reshape(len(own), -1)))

    return run(image)


def spectral_loss(a: str | Column, b: str | Column, height: int, width: int) -> Column:
    """The mean absolute difference of real and imaginary parts of two spectra."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, t in batches:
            d = np.fft.rfft2(_images(s, height, width)) - np.fft.rfft2(_images(t, height, width))
            yield pd.Series((np.abs(d.real).mean(axis=(1, 2)) + np.abs(d.imag).mean(axis=(1, 2))) / 2)

    return run(a, b)


def shifted(image: str | Column, height: int, width: int, dy: float, dx: float) -> Column:
    """Bilinear shift, zeros from outside."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        iy, ix = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = dy - iy, dx - ix
        for s in batches:
            x = _images(s, height, width)
            out = np.zeros_like(x)
            for oy, wy in ((iy, 1 - fy), (iy + 1, fy)):
                for ox, wx in ((ix, 1 - fx), (ix + 1, fx)):
                    ys, xs = np.arange(height) - oy, np.arange(width) - ox
                    okay_y, okay_x = (ys >= 0) & (ys < height), (xs >= 0) & (xs < width)
                    part = np.zeros_like(x)
                    part[:, np.ix_(okay_y, okay_x)[0], np.ix_(okay_y, okay_x)[1]] = x[:, ys[okay_y]][:, :, xs[okay_x]]
                    out += wy * wx * part
            yield pd.Series(list(out.reshape(len(out), -1)))

    return run(image)


def layered_blur(df: DataFrame, keys: list[str], depth: str, color: str, alpha: str, kernel: str, height: int, width: int, size: int) -> DataFrame:
    """keys, image: the layers of an image (a few) convolved with their own kernels and laid over each other, the farthest first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((height, width))
        shape = (height + size - 1, width + size - 1)
        h = size // 2
        far_first = pdf.sort_values(depth, ascending=False)
        layers = zip(_images(far_first[kernel], size, size), _images(far_first[alpha], height, width), _images(far_first[color], height, width), strict=True)
        for own, a, c in layers:
            k = np.fft.rfft2(own, shape)
            blur = lambda x, k=k: np.fft.irfft2(np.fft.rfft2(x, shape) * k, shape)[h : h + height, h : h + width]
            out = blur(c * a) + out * (1 - np.clip(blur(a), 0, 1))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "image": [out.reshape(-1)]})

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys] + ["image array<double>"])
    return df.groupBy(*keys).applyInPandas(run, schema)


def masked_least_squares(df: DataFrame, keys: list[str], features: list[str], target: str, mask: str | None = None) -> DataFrame:
    """keys, coefficients: least squares of each group from its normal equations.

    The sums are grouped aggregates, so a group of any size is merged by partial results; only the
    small systems are solved in Python.
    """
    d = df.where(F.col(mask)) if mask else df
    n = len(features)
    sums = [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"a_{i}_{j}") for i in range(n) for j in range(i, n)]
    sums += [F.sum(F.col(features[i]) * F.col(target)).alias(f"b_{i}") for i in range(n)]
    g = d.groupBy(*keys).agg(*sums)

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for flat, b in zip(s, t, strict=True):
            a = np.zeros((n, n))
            a[np.triu_indices(n)] = flat
            a = a + np.triu(a, 1).T
            out.append(np.linalg.lstsq(a, np.asarray(b), rcond=None)[0])
        return pd.Series(out)

    a = F.array(*[F.col(f"a_{i}_{j}") for i in range(n) for j in range(i, n)])
    return g.select(*keys, solve(a, F.array(*[F.col(f"b_{i}") for i in range(n)])).alias("coefficients"))


def _complex(values: np.ndarray) -> pd.DataFrame:
    """Rows of complex numbers as struct(re, im)."""
    return pd.DataFrame({"re": list(np.ascontiguousarray(values.real)), "im": list(np.ascontiguousarray(values.imag))})


_SPECTRUM = "re array<double>, im array<double>"


def centred_dft(image: str | Column, shape: tuple[int, ...], inverse: bool = False, axes: tuple[int, ...] | None = None) -> Column:
    """struct(re, im) of the transform of a row-major array whose origin, before and after, is element n // 2 of each axis."""
    axes = tuple(range(len(shape))) if axes is None else axes
    own = tuple(a + 1 for a in axes)
    turn = np.fft.ifftn if inverse else np.fft.fftn

    @F.pandas_udf(_SPECTRUM)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            x = np.stack([np.asarray(v, np.float64).reshape(shape) for v in s]) if len(s) else np.zeros((0, *shape))
            y = np.fft.fftshift(turn(np.fft.ifftshift(x, own), axes=own), own)
            yield _complex(y.reshape(len(y), -1))

    return run(image)


def zoomed_dft(signal: str | Column, n: int, spacing: float, low: float, high: float, bins: int) -> Column:
    """struct(re, im) of a signal's transform at the centres of `bins` equal bins of the frequencies from `low` to `high`.

    Samples stand `spacing` apart around the middle, (n - 1) / 2. Chirps turn the sum into a convolution
    of length n + bins, which is done by FFT for all rows of a batch at once.
    """
    width = (high - low) / bins
    first = low + width / 2
    size = 1 << (n + bins - 2).bit_length()
    k = np.arange(max(n, bins), dtype=np.float64)
    # t * k = (t^2 + k^2 - (k - t)^2) / 2
    chirp = np.exp(-1j * np.pi * width * spacing * k * k)
    kernel = np.zeros(size, complex)
    kernel[:bins] = np.conj(chirp[:bins])
    kernel[size - n + 1 :] = np.conj(chirp[1:n])[::-1]
    kernel = np.fft.fft(kernel)
    start = np.exp(-2j * np.pi * first * spacing * k[:n]) * chirp[:n]
    end = chirp[:bins] * np.exp(2j * np.pi * (first + width * k[:bins]) * spacing * (n - 1) / 2)

    @F.pandas_udf(_SPECTRUM)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            x = np.stack([np.asarray(v, np.float64) for v in s]) if len(s) else np.zeros((0, n))
            y = np.fft.ifft(np.fft.fft(x * start, size, axis=1) * kernel, axis=1)[:, :bins] * end
            yield _complex(y)

    return run(signal)


def bin_centres(low: float, high: float, bins: int) -> Column:
    """The frequencies of `zoomed_dft`."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.lit(low) + (k + 0.5) * ((high - low) / bins))
