"""Drift-diffusion model as column expressions.

``ez_parameters`` is the closed-form estimate of Wagenmakers, van der Maas and
Grasman (2007). ``wiener_density`` is the first-passage density in the two
series of Navarro and Fuss (2009) with a fixed number of terms.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Contamination mixture of the likelihood (5 % uniform outliers).
P_OUTLIER = 0.05
OUTLIER_DENSITY = 0.1


def edge_corrected(p: Column, n: Column) -> Column:
    """Move proportions 0, 1/2 and 1 off the points where the equations fail."""
    half_trial = 1 / (2 * n)
    return F.when(p == 0, half_trial).when(p == 1, 1 - half_trial).when(p == 0.5, 0.5 + half_trial).otherwise(p)


def ez_parameters(p: Column, n: Column, mean_rt: Column, var_rt: Column, s: float = 1.0) -> dict[str, Column]:
    """Drift ``v``, boundary ``a`` and non-decision time ``t``; null without RT variance."""
    p = edge_corrected(p, n)
    odds = F.ln(p / (1 - p))
    power = F.when(var_rt > 0, odds * (odds * p * p - odds * p + p - 0.5) / var_rt)
    v = F.when(power > 0, F.signum(p - 0.5) * s * F.pow(power, F.lit(0.25)))
    a = s * s * odds / v
    y = -v * a / (s * s)
    decision_time = (a / (2 * v)) * (1 - F.exp(y)) / (1 + F.exp(y))
    return {"v": v, "a": a, "t": mean_rt - decision_time}


def wiener_density(rt: Column, response: Column, v: Column, a: Column, t: Column, z: Column,
                   terms: int = 7) -> Column:
    """Density of a response at the upper (1) or lower (0) boundary at time ``rt``.

    ``z`` is the relative starting point. Below a scaled time of 0.25 the
    small-time series is used, above it the large-time series; seven terms keep
    the truncation error of either below 1e-9.
    """
    drift = F.when(response == 1, -v).otherwise(v)
    start = F.when(response == 1, 1 - z).otherwise(z)
    u = (rt - t) / (a * a)
    small = None
    for k in range(-(terms // 2), terms // 2 + 1):
        place = start + 2.0 * k
        term = place * F.exp(-(place * place) / (2 * u))
        small = term if small is None else small + term
    small = small / F.sqrt(2 * math.pi * u * u * u)
    large = None
    for k in range(1, terms + 1):
        term = k * F.exp(-(k * k * math.pi * math.pi / 2) * u) * F.sin(k * math.pi * start)
        large = term if large is None else large + term
    large = math.pi * large
    shape = F.greatest(F.when(u < 0.25, small).otherwise(large), F.lit(0.0))
    travel = F.exp(-drift * a * start - drift * drift * (rt - t) / 2) / (a * a)
    return F.when(rt > t, shape * travel).otherwise(F.lit(0.0))


def wiener_loglik(rt: Column, response: Column, v: Column, a: Column, t: Column, z: Column,
                  terms: int = 7) -> Column:
    """Log-likelihood of one trial under the contaminated model."""
    density = wiener_density(rt, response, v, a, t, z, terms)
    return F.ln((1 - P_OUTLIER) * density + P_OUTLIER * OUTLIER_DENSITY)


CHUNK_POINTS = 1 << 16  # stays in a core's cache
FACTORS = 16  # densities multiplied before one logarithm: each is at least that of an outlier, so nothing underflows
LARGEST = 1e15


def _exp(x: np.ndarray) -> np.ndarray:
    """exp in place; what would be below 1e-304 is that, as numbers near the smallest one are slow."""
    return np.exp(np.maximum(x, -700.0, out=x), out=x)


def _series(u: np.ndarray, start: np.ndarray, terms: int) -> np.ndarray:
    """The density's shape for every start at scaled times ``u``: (starts, len(u)), 0 where u is not positive.

    ``start`` has a row per start, with one value for all times or one per time.
    """
    out = np.zeros((len(start), len(u)))
    each = start.shape[1] > 1
    small, large = np.flatnonzero((u > 0) & (u < 0.25)), np.flatnonzero(u >= 0.25)
    if len(small):
        near, own = u[small], start[:, small] if each else start
        rate = -0.5 / near
        total = np.zeros((len(start), len(small)))
        for k in range(-(terms // 2), terms // 2 + 1):
            place = own + 2.0 * k
            if np.min(place * place) < 25:  # beyond it the term is below 1e-20 at every time of this branch
                term = _exp(place * place * rate)
                term *= place
                total += term
        out[:, small] = total / np.sqrt(2 * math.pi * near * near * near)
    if len(large):
        far, own = u[large], start[:, large] if each else start
        decay = _exp(-(math.pi * math.pi / 2) * far)
        square, step = decay.copy(), decay * decay * decay  # decay to the power k * k, and from it to the next
        total = np.zeros((len(start), len(large)))
        for k in range(1, terms + 1):
            if k * math.exp(-(k * k * math.pi * math.pi / 8)) < 1e-18:  # below the precision at every time of this branch
                break
            total += (k * math.pi * np.sin(k * math.pi * own)) * square
            square *= step
            step *= decay
            step *= decay
        out[:, large] = total
    return np.maximum(out, 0.0, out=out)


def _log_sum(density: np.ndarray, count: np.ndarray, largest: float) -> np.ndarray:
    """Counted sum of logarithms over the last axis; single trials are multiplied first. No density is above ``largest``."""
    single = count == 1
    total = 0.0
    if not single.all():
        total = np.log(density[..., ~single]) @ count[~single]
        density = density[..., single]
    if not largest < LARGEST:
        density = np.minimum(density, LARGEST)
    factors = 1
    while factors < FACTORS and density.shape[-1] > 1:  # halves are multiplied, four times at most
        half = density.shape[-1] // 2
        first, rest = density[..., :half], density[..., 2 * half:]
        first *= density[..., half:2 * half]
        if rest.shape[-1]:
            total = total + np.log(rest[..., 0])
        density, factors = first, 2 * factors
    return total + np.log(density).sum(axis=-1)


def grid_loglik(rt: np.ndarray, upper: np.ndarray, count: np.ndarray, v: np.ndarray, a: np.ndarray, t: np.ndarray,
                z: np.ndarray, terms: int = 7) -> np.ndarray:
    """Summed contaminated log-likelihood of counted trials at every point of v x a x t x z.

    The series depend on a, t and z only and are shared by all drifts. Trials are
    taken in chunks and lie along the last axis, so memory depends on the grid and not
    on their number.
    """
    total = np.zeros((len(v), len(a), len(t), len(z)))
    chunk = max(FACTORS, CHUNK_POINTS // total.size)
    wide = a * a
    for side in (True, False):
        own = np.flatnonzero(upper == side)
        start, drift = (1 - z, -v) if side else (z, v)
        lift = drift[:, None, None, None, None] * a[:, None, None, None] * start[:, None]  # v, a, 1, z, 1
        apart = np.abs(lift).max(initial=0.0) < 300  # else one factor alone could overflow
        rise = (1 - P_OUTLIER) * np.exp(-lift) if apart else None
        for at in range(0, len(own), chunk):
            some = own[at:at + chunk]
            time = rt[some] - t[:, None]
            u = time / wide[:, None, None]  # a, t, trial
            shape = _series(u.ravel(), start[:, None], terms).reshape(len(z), *u.shape) / wide[:, None, None]
            shape = np.ascontiguousarray(shape.transpose(1, 2, 0, 3))  # a, t, z, trial
            spent = (drift * drift / 2)[:, None, None, None, None] * np.maximum(time, 0.0)[:, None]  # v, 1, t, 1, trial
            largest = math.inf
            if apart:
                density = shape * np.exp(-spent)
                density *= rise
                largest = shape.max() * rise.max() + P_OUTLIER * OUTLIER_DENSITY
            else:
                density = (1 - P_OUTLIER) * shape * np.exp(-lift - spent)
            density += P_OUTLIER * OUTLIER_DENSITY
            total += _log_sum(density, count[some], largest)
    return total


def grid_logliks(rt: np.ndarray, upper: np.ndarray, count: np.ndarray, sizes: np.ndarray, v: np.ndarray, a: np.ndarray,
                 t: np.ndarray, z: np.ndarray, terms: int = 7) -> np.ndarray:
    """``grid_loglik`` of many small groups at once.

    Group i has the next ``sizes[i]`` trials, at least one, and row i of each axis.
    """
    points = v.shape[1] * a.shape[1] * t.shape[1] * z.shape[1]
    out = np.empty((v.shape[1], a.shape[1], t.shape[1], z.shape[1], len(sizes)))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    low = 0
    while low < len(sizes):  # groups in chunks, at least one
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + max(FACTORS, CHUNK_POINTS // points), side="right")) - 1)
        some = slice(ends[low], ends[high])
        own = np.repeat(np.arange(low, high), sizes[low:high])
        side = upper[some].astype(bool)
        start, drift, wide = np.where(side, 1 - z.T[:, own], z.T[:, own]), np.where(side, -v.T[:, own], v.T[:, own]), a.T[:, own]
        time = rt[some] - t.T[:, own]
        u = time / (wide * wide)[:, None]  # a, t, trial
        shape = _series(u.ravel(), np.tile(start, (1, wide.shape[0] * time.shape[0])), terms).reshape(len(start), *u.shape)
        shape = shape.transpose(1, 2, 0, 3) / (wide * wide)[:, None, None]  # a, t, z, trial
        lift = drift[:, None, None, None] * wide[:, None, None] * start  # v, a, 1, z, trial
        spent = (drift * drift)[:, None, None, None] * np.maximum(time, 0.0)[:, None] / 2  # v, 1, t, 1, trial
        density = np.minimum((1 - P_OUTLIER) * shape * np.exp(-lift - spent) + P_OUTLIER * OUTLIER_DENSITY, LARGEST)
        out[..., low:high] = np.add.reduceat(count[some] * np.log(density), ends[low:high] - ends[low], axis=-1)
        low = high
    return np.moveaxis(out, -1, 0)


def start_logliks(rt: np.ndarray, upper: np.ndarray, v: np.ndarray, a: np.ndarray, t: np.ndarray, z: np.ndarray, terms: int = 7) -> np.ndarray:
    """Contaminated log-likelihood of every trial, with its own v, a and t, at every z: (len(z), len(rt))."""
    out = np.empty((len(z), len(rt)))
    for side in (True, False):
        own = np.flatnonzero(upper == side)
        start, drift = (1 - z, -v) if side else (z, v)
        for at in range(0, len(own), CHUNK_POINTS // len(z) + 1):
            some = own[at:at + CHUNK_POINTS // len(z) + 1]
            wide, pull, time = a[some] * a[some], drift[some], rt[some] - t[some]
            shape = _series(time / wide, start[:, None], terms)
            shape *= (1 - P_OUTLIER) / wide
            shape *= np.exp(-(pull * a[some]) * start[:, None] - pull * pull * np.maximum(time, 0.0) / 2)
            shape += P_OUTLIER * OUTLIER_DENSITY
            out[:, some] = np.log(np.minimum(shape, LARGEST, out=shape), out=shape)
    return out
