"""Resampling kernels: which source pixels make a target pixel, with weights.

Two ways to say the same: ``axis_taps`` is a Spark expression, and
``weight_matrix`` a dense numpy matrix for use inside a task. Both are
separable, so an image takes one along each axis.

The `cv2` backend interpolates between neighbours and repeats the border; the
`pillow` backend widens its filter when it shrinks, and cuts it at the border.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, functions as F

from framewright.functions.binding import let

# Kernel names of each backend
KERNELS = {
    "cv2": ("nearest", "bilinear", "bicubic", "area", "lanczos"),
    "pillow": ("nearest", "bilinear", "bicubic", "box", "lanczos", "hamming"),
}
# Half widths of the widening filters, in source pixels
SUPPORT = {"box": 0.5, "bilinear": 1.0, "hamming": 1.0, "bicubic": 2.0, "lanczos": 3.0}
# Neighbours that an interpolating kernel looks at
NEIGHBOURS = {"bilinear": (0, 1), "bicubic": (-1, 0, 1, 2), "lanczos": (-3, -2, -1, 0, 1, 2, 3, 4)}
CUBIC = {"cv2": -0.75, "pillow": -0.5}
AREA_TOLERANCE = 1e-3


def check_kernel(interpolation: str, backend: str) -> None:
    if backend not in KERNELS:
        raise ValueError(f"backend {backend!r} is not supported; use one of {sorted(KERNELS)}")
    if interpolation not in KERNELS[backend]:
        raise ValueError(f"backend {backend!r} has no kernel {interpolation!r}")


# -- Spark expressions ------------------------------------------------------


def _sinc(t: Column) -> Column:
    return F.when(t == 0, 1.0).otherwise(F.sin(np.pi * t) / (np.pi * t))


def _cubic(t: Column, a: float) -> Column:
    t = F.abs(t)
    near = ((a + 2) * t - (a + 3)) * t * t + 1
    far = ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
    return F.when(t < 1, near).when(t < 2, far).otherwise(0.0)


def _filter(name: str, t: Column) -> Column:
    """The widening filters at distance ``t``."""
    if name == "box":
        return F.when((t > -0.5) & (t <= 0.5), 1.0).otherwise(0.0)
    if name == "bilinear":
        return F.greatest(1 - F.abs(t), F.lit(0.0))
    if name == "hamming":
        return F.when(F.abs(t) < 1, _sinc(t) * (0.54 + 0.46 * F.cos(np.pi * t))).otherwise(0.0)
    if name == "bicubic":
        return _cubic(t, CUBIC["pillow"])
    return F.when((t >= -3) & (t < 3), _sinc(t) * _sinc(t / 3)).otherwise(0.0)


def _tap(src: Column, w: Column) -> Column:
    return F.struct(src.cast("int").alias("src"), w.cast("double").alias("w"))


def _normalized(taps: Column) -> Column:
    def scaled(ts: Column) -> Column:
        total = F.aggregate(ts, F.lit(0.0), lambda acc, t: acc + t["w"])
        return let(
            F.struct(ts.alias("ts"), total.alias("total")),
            lambda b: F.transform(b["ts"], lambda t: _tap(t["src"], t["w"] / b["total"])),
        )

    return let(taps, scaled)


def _neighbours(start: Column, fraction: Column, src: Column, name: str) -> Column:
    weights = {
        "bilinear": lambda t: 1 - F.abs(t),
        "bicubic": lambda t: _cubic(t, CUBIC["cv2"]),
        "lanczos": lambda t: _sinc(t) * _sinc(t / 4),
    }[name]

    def taps(b: Column) -> Column:
        return F.array(
            *[
                _tap(
                    F.least(F.greatest(b["start"] + k, F.lit(0)), src - 1),
                    weights(b["fraction"] - k),
                )
                for k in NEIGHBOURS[name]
            ]
        )

    bound = F.struct(start.cast("int").alias("start"), fraction.alias("fraction"))
    found = let(bound, taps)
    return _normalized(found) if name == "lanczos" else found


def axis_taps(
    src: Column, dst: Column, interpolation: str, backend: str, shrinking: Column
) -> Column:
    """For each of ``dst`` targets, an array of ``(src, w)``.

    ``shrinking`` tells whether the image shrinks along both axes; only the
    area kernel asks.
    """
    check_kernel(interpolation, backend)
    scale = src / dst

    def bound(start: Column, name: str, at: Column) -> Column:
        return _neighbours(start, at - start, src, name)

    def interpolated(d: Column) -> Column:
        at = (d + 0.5) * scale - 0.5
        if interpolation == "bilinear":
            at = F.greatest(at, F.lit(0.0))
        return let(at, lambda p: bound(F.floor(p), interpolation, p))

    def area(d: Column) -> Column:
        lo, hi = d * scale, F.least((d + 1) * scale, src.cast("double"))
        cells = F.sequence(F.floor(lo).cast("int"), (F.ceil(hi) - 1).cast("int"))
        parts = F.transform(
            cells, lambda s: _tap(s, F.least(hi, s + 1.0) - F.greatest(lo, s.cast("double")))
        )
        covered = _normalized(F.filter(parts, lambda t: t["w"] > AREA_TOLERANCE))
        start = F.floor(d * scale)
        fraction = F.greatest((d + 1) - (start + 1) / scale, F.lit(0.0))
        linear = _neighbours(start, fraction - F.floor(fraction), src, "bilinear")
        return F.when(shrinking, covered).otherwise(linear)

    def widened(d: Column) -> Column:
        widen = F.greatest(scale, F.lit(1.0))
        reach = SUPPORT[interpolation] * widen
        center = (d + 0.5) * scale
        first = F.greatest(center - reach + 0.5, F.lit(0.0)).cast("int")
        last = F.least((center + reach + 0.5).cast("int"), src) - 1
        return _normalized(
            F.transform(
                F.sequence(first, last),
                lambda s: _tap(s, _filter(interpolation, (s - center + 0.5) / widen)),
            )
        )

    def nearest(d: Column) -> Column:
        shift = 0.0 if backend == "cv2" else 0.5
        return F.array(_tap(F.least(F.floor((d + shift) * scale), src - 1), F.lit(1.0)))

    if interpolation == "nearest":
        taps = nearest
    elif backend == "pillow":
        taps = widened
    else:
        taps = area if interpolation == "area" else interpolated
    return F.transform(F.sequence(F.lit(0), dst - 1), taps)


# -- numpy ------------------------------------------------------------------


def _np_cubic(t: np.ndarray, a: float) -> np.ndarray:
    t = np.abs(t)
    near = (a + 2) * t**3 - (a + 3) * t**2 + 1
    far = a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a
    return np.where(t < 1, near, np.where(t < 2, far, 0.0))


@lru_cache(maxsize=256)
def weight_matrix(src: int, dst: int, interpolation: str, backend: str, shrinking: bool) -> np.ndarray:
    """Weights as a ``dst`` × ``src`` matrix."""
    return weight_band(src, dst, 0, dst, 0, src, interpolation, backend, shrinking)


def weight_band(
    src: int, dst: int, first: int, last: int, lo: int, hi: int, interpolation: str, backend: str, shrinking: bool
) -> np.ndarray:
    """The weights of targets ``first`` .. ``last``, all of whose sources lie in ``lo`` .. ``hi``."""
    check_kernel(interpolation, backend)
    scale = src / dst
    d, x = np.arange(first, last)[:, None], np.arange(lo, hi)[None, :]
    if interpolation == "nearest":
        shift = 0.0 if backend == "cv2" else 0.5
        return (x == np.minimum(np.floor((d + shift) * scale), src - 1)).astype(float)
    if backend == "pillow":
        widen = max(scale, 1.0)
        reach, center = SUPPORT[interpolation] * widen, (d + 0.5) * scale
        t = (x - center + 0.5) / widen
        w = {
            "box": lambda: ((t > -0.5) & (t <= 0.5)).astype(float),
            "bilinear": lambda: np.maximum(1 - np.abs(t), 0),
            "hamming": lambda: np.where(
                np.abs(t) < 1, np.sinc(t) * (0.54 + 0.46 * np.cos(np.pi * t)), 0.0
            ),
            "bicubic": lambda: _np_cubic(t, CUBIC["pillow"]),
            "lanczos": lambda: np.where((t >= -3) & (t < 3), np.sinc(t) * np.sinc(t / 3), 0.0),
        }[interpolation]()
        first = np.trunc(np.maximum(center - reach + 0.5, 0))
        last = np.minimum(np.trunc(center + reach + 0.5), src) - 1
        w = w * ((x >= first) & (x <= last))
    elif interpolation == "area" and shrinking:
        hi = np.minimum((d + 1) * scale, src)
        w = np.minimum(hi, x + 1) - np.maximum(d * scale, x)
        w = np.where(w > AREA_TOLERANCE, w, 0.0)
    else:
        if interpolation == "area":
            start = np.floor(d * scale)
            at = np.maximum((d + 1) - (start + 1) / scale, 0)
            at, name = start + at - np.floor(at), "bilinear"
        else:
            at, name = (d + 0.5) * scale - 0.5, interpolation
            if name == "bilinear":
                at = np.maximum(at, 0)
            start = np.floor(at)
        w = np.zeros((last - first, hi - lo))
        for k in NEIGHBOURS[name]:
            t = at - start - k
            weight = {
                "bilinear": lambda: 1 - np.abs(t),
                "bicubic": lambda: _np_cubic(t, CUBIC["cv2"]),
                "lanczos": lambda: np.sinc(t) * np.sinc(t / 4),
            }[name]()
            w += weight * (x == np.clip(start + k, 0, src - 1))
    return w / w.sum(axis=1, keepdims=True)
