"""Frequency-domain operators on gray or colour images.

A transform needs the whole image, so pixels are dealt out by image and stacks of images of one size are transformed
at once by numpy; an image has to fit in a worker, of a partition no more than STACK pixels or one image are held.
Images are laid in the middle of black ones with sides that are powers of two, as the transform asks for, and results
are cut back to the image's own size.

An empty table gives an empty one.  Rows without an image or a place are left out, a null value counts as black, and of
a pixel that is there twice one is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.pixels import COLOR, GRAY, gray, is_color

#: Pixels that are transformed at once.
STACK = 1 << 20


def fft(line: np.ndarray, inverse: bool = False) -> np.ndarray:
    """One-dimensional transform of a line whose length is a power of two; the inverse is scaled by 1/n."""
    if len(line) & (len(line) - 1) or not len(line):
        raise ValueError("the length has to be a power of two")
    return np.fft.ifft(line) if inverse else np.fft.fft(line)


def shift(spectrum: np.ndarray) -> np.ndarray:
    return np.fft.fftshift(spectrum, axes=(-2, -1)[-spectrum.ndim :])


def _back(spectrum: np.ndarray) -> np.ndarray:
    return np.fft.ifft2(np.fft.ifftshift(spectrum, axes=(-2, -1))).real


def _power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def _cut(x: np.ndarray) -> np.ndarray:
    return np.trunc(np.clip(np.round(x, 6), 0, 255)).astype(np.int32)


# These take an image, or a stack of images of one size.


def spectrum(image: np.ndarray) -> np.ndarray:
    """log10(1 + magnitude) of the shifted transform, stretched to 0..255."""
    m = np.log10(1 + np.abs(shift(np.fft.fft2(image))))
    most = m.max(axis=(-2, -1), keepdims=True)
    return _cut(m / np.where(most > 0, most, 1) * 255)


def phase(image: np.ndarray) -> np.ndarray:
    """Angle of each bin, from 0 to 255, unshifted; bins without a magnitude count as angle 0."""
    f = np.fft.fft2(image)
    angle = np.where(np.abs(f) < 1e-6, 0.0, np.arctan2(np.where(np.abs(f.imag) < 1e-9, 0.0, f.imag), f.real))
    return _cut((angle + np.pi) / (2 * np.pi) * 255)


def _distance(shape: tuple[int, ...]) -> np.ndarray:
    h, w = shape[-2:]
    y, x = np.ogrid[:h, :w]
    return np.sqrt((x - w // 2) ** 2 + (y - h // 2) ** 2)


def pass_filter(image: np.ndarray, low: bool, ratio: float) -> np.ndarray:
    """Bins within (low) or beyond (high) ratio times half the shorter side."""
    d, r = _distance(image.shape), min(image.shape[-2:]) / 2 * ratio
    return _cut(_back(np.where(d <= r if low else d > r, shift(np.fft.fft2(image)), 0)))


def band_stop(image: np.ndarray, radius: float, magnitude: float) -> np.ndarray:
    """Without the bins beyond radius whose magnitude has a natural logarithm above `magnitude`."""
    f = shift(np.fft.fft2(image))
    with np.errstate(divide="ignore"):
        f[(_distance(image.shape) > radius) & (np.log(np.abs(f)) > magnitude)] = 0
    return _cut(_back(f))


def transformed(ids: np.ndarray, y: np.ndarray, x: np.ndarray, values: list[np.ndarray], made) -> list[np.ndarray]:
    """The values of whole images, which come one after another, after `made`."""
    head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    size = np.diff(np.append(head, len(ids)))
    h, w = np.maximum.reduceat(y, head) + 1, np.maximum.reduceat(x, head) + 1
    out = [np.zeros(len(ids), np.int32) for _ in values]
    image = np.repeat(np.arange(len(head)), size)
    for shape in np.unique(np.stack([h, w], 1), axis=0).tolist():
        own = np.flatnonzero((h == shape[0]) & (w == shape[1]))
        ph, pw = _power(shape[0]), _power(shape[1])
        top, left = (ph - shape[0]) // 2, (pw - shape[1]) // 2
        step = max(1, STACK // (ph * pw))
        for part in (own[a : a + step] for a in range(0, len(own), step)):
            nth = np.full(len(head), -1)
            nth[part] = np.arange(len(part))
            at = np.flatnonzero(nth[image] >= 0)
            place = (nth[image[at]], y[at] + top, x[at] + left)
            for v, o in zip(values, out, strict=True):
                stack = np.zeros((len(part), ph, pw))
                stack[place] = v[at]
                o[at] = made(stack)[place]
    return out


def _apply(df: DataFrame, made, names: tuple[str, ...]) -> DataFrame:
    kept = ["image_id", "y", "x", *names]

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, y, x, *values = (whole.column(i).to_numpy(zero_copy_only=False) for i in range(whole.num_columns))
        out = transformed(ids, y, x, [np.nan_to_num(v.astype(np.float64)) for v in values], made)
        return pa.RecordBatch.from_arrays([*whole.columns[:3], *(pa.array(v, pa.int32()) for v in out)], names=kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if held and n >= STACK:  # whole images are there but for the last
                cut = int(np.searchsorted(ids, held[-1].column(0)[-1].as_py(), "right"))
                if cut < len(batch):
                    yield flush([*held, batch.slice(0, cut)] if cut else held)
                    held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += len(batch)
        if held:
            yield flush(held)

    there = df.filter(F.col("image_id").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull())
    dealt = there.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("int").alias(c) for c in kept[1:]]).repartition("image_id").sortWithinPartitions("image_id")
    return dealt.mapInArrow(run, "image_id long, " + ", ".join(f"{c} int" for c in kept[1:]))


def fft_spectrum(df: DataFrame) -> DataFrame:
    return _apply(gray(df), spectrum, GRAY)


def fft_phase(df: DataFrame) -> DataFrame:
    return _apply(gray(df), phase, GRAY)


def low_pass(df: DataFrame, ratio: float = 0.01) -> DataFrame:
    return _apply(gray(df), lambda image: pass_filter(image, True, ratio), GRAY)


def high_pass(df: DataFrame, ratio: float = 0.01) -> DataFrame:
    return _apply(gray(df), lambda image: pass_filter(image, False, ratio), GRAY)


def axial_band_stop(df: DataFrame, radius: float = 10, magnitude: float = 4) -> DataFrame:
    return _apply(gray(df), lambda image: band_stop(image, radius, magnitude), GRAY)


def fft_color(df: DataFrame, as_phase: bool = False) -> DataFrame:
    """Spectrum (or phase) of blue, green and red, each by itself; alpha becomes 255."""
    if not is_color(df):
        raise ValueError("a colour image is asked for")
    return _apply(df, phase if as_phase else spectrum, COLOR).withColumn("a", F.lit(255))
