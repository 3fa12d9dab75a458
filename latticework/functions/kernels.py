"""Pair kernels as expressions over columns of a target (prefix a) and a source (prefix b). Those of all-pairs sums (reciprocal, rpy, stokes) take
numpy arrays as well."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions.scalar import rsqrt


def separation(a: list[Column], b: list[Column]) -> tuple[list[Column], Column]:
    """Differences and their squared length."""
    d = [x - y for x, y in zip(a, b)]
    return d, sum((x * x for x in d[1:]), d[0] * d[0])


def _choose(condition, yes, no):
    if isinstance(condition, Column):
        return F.when(condition, yes).otherwise(no)
    return np.where(condition, yes, no)


def reciprocal(r2):
    """1 / r, 0 where the points coincide."""
    if isinstance(r2, Column):
        return rsqrt(r2)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.sqrt(r2)
        np.divide(1.0, out, out=out)
    out[r2 == 0] = 0.0
    return out


def gauss(r2: Column, length: float) -> Column:
    return F.exp(-r2 / (length * length))


def matern32(r2: Column, length: float) -> Column:
    s = F.sqrt(r2) * (math.sqrt(3.0) / length)
    return (1.0 + s) * F.exp(-s)


def gauss_array(length: float):
    """The same over a numpy array of squared distances."""
    def kernel(r2: np.ndarray) -> np.ndarray:
        t = np.asarray(r2 * (-1.0 / (length * length)))
        return np.exp(t, out=t)

    return kernel


def matern32_array(length: float):
    def of(r2):
        s = np.sqrt(r2) * (math.sqrt(3.0) / length)
        return (1.0 + s) * np.exp(-s)

    return of


# A vector kernel is t1 q + t2 (q . e) e for the unit separation e; these give t1 and t2 of the distance (squared, itself, inverse or 0).
Terms = tuple[Column, Column] | tuple[np.ndarray, np.ndarray]


def rpy(r2, r, inv, radius: float = 0.2, viscosity: float = 1.0) -> Terms:
    """Rotne-Prager-Yamakawa mobility, with its branch for overlapping spheres (r < 2 radius)."""
    c = 1.0 / (6.0 * math.pi * radius * viscosity)
    near = r < 2.0 * radius
    s = inv * inv * (2.0 * radius * radius)
    t1 = _choose(near, c - r * (c * 9.0 / 32.0 / radius), inv * (0.75 * c) * (1.0 + s / 3.0))
    t2 = _choose(near, r * (c * 3.0 / 32.0 / radius), inv * (0.75 * c) * (1.0 - s))
    return t1, t2


def stokes(r2, r, inv, radius: float = 0.25, viscosity: float = 0.5) -> Terms:
    """Stokeslet; a point acts on itself by 1 / (6 pi radius viscosity)."""
    c = 1.0 / (6.0 * math.pi * radius * viscosity)
    t = _choose(r2 == 0, c, inv * (0.75 * c * radius))
    return t, t
