"""Commands by name: the operators as functions of an image and a set of parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lumenframe.operators import cluster, filters, frequency, histogram, match, point
from lumenframe.operators.pixels import gray


@dataclass
class Parameters:
    """What commands go by."""

    threshold: int = 128
    brightness: int = 0
    kernel_size: int = 3
    sigma: float = 1.0
    circular: bool = False
    k: int = 2
    iterations: int = 20
    radius_ratio: float = 0.01
    low_freq_radius: float = 10
    magnitude_threshold: float = 4
    phase: bool = False
    seed: int = 0
    max_dim: int | None = None
    template: DataFrame | None = None


Command = Callable[[DataFrame, Parameters], DataFrame]

COMMANDS: dict[str, Command] = {
    "Bin": lambda d, p: point.binarize(gray(d), p.threshold),
    "Bright": lambda d, p: point.brightness(d, p.brightness),
    "Bin_Otsu": lambda d, p: histogram.otsu_binarize(d),
    "Clustering": lambda d, p: cluster.kmeans(d, p.k, p.iterations, seed=p.seed),
    "ClusteringLoc": lambda d, p: cluster.kmeans(d, p.k, p.iterations, location=True, seed=p.seed),
    "Gray": lambda d, p: gray(d),
    "Equal": lambda d, p: histogram.equalize(d),
    "Equal_color": lambda d, p: histogram.equalize_color(d),
    "Diff": lambda d, p: filters.differential(d),
    "Sobel": lambda d, p: filters.sobel(d, p.kernel_size),
    "Laplace": lambda d, p: filters.laplacian(d, p.kernel_size),
    "FFT": lambda d, p: frequency.fft_phase(d) if p.phase else frequency.fft_spectrum(d),
    "FFT_Low": lambda d, p: frequency.low_pass(d, p.radius_ratio),
    "FFT_High": lambda d, p: frequency.high_pass(d, p.radius_ratio),
    "FFT_Band": lambda d, p: frequency.axial_band_stop(d, p.low_freq_radius, p.magnitude_threshold),
    "Average": lambda d, p: filters.average_blur(d, p.kernel_size, p.circular),
    "Gaussian": lambda d, p: filters.gaussian_blur(d, p.sigma, p.kernel_size, p.circular),
    "Dilation": lambda d, p: filters.dilate(d, p.kernel_size, p.circular),
    "Erosion": lambda d, p: filters.erode(d, p.kernel_size, p.circular),
    "Opening": lambda d, p: filters.opening(d, p.kernel_size, p.circular),
    "Closing": lambda d, p: filters.closing(d, p.kernel_size, p.circular),
    "NCC": lambda d, p: match.match_and_draw(d, _template(p), "NCC", p.max_dim),
    "SAD": lambda d, p: match.match_and_draw(d, _template(p), "SAD", p.max_dim),
    "SSD": lambda d, p: match.match_and_draw(d, _template(p), "SSD", p.max_dim),
}


def _template(p: Parameters) -> DataFrame:
    if p.template is None:
        raise ValueError("matching needs a template")
    return p.template


def command(name: str, parameters: Parameters | None = None) -> Callable[[DataFrame], DataFrame]:
    """The named command as a function for DataFrame.transform."""
    if name not in COMMANDS:
        raise ValueError(f"no command is called {name}")
    return lambda df: COMMANDS[name](df, parameters or Parameters())


def pipeline(df: DataFrame, *names: str, parameters: Parameters | None = None) -> DataFrame:
    """Commands one after another, as one lazy plan."""
    for name in names:
        df = df.transform(command(name, parameters))
    return df
