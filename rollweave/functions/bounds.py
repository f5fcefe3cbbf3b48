"""Token-wise bounds of the probability ratio, soft clips and clip schedules, as Column builders.

A bound maps the old log-probability of a token to (lower, upper). All functions are plain arithmetic inside
whole-stage code generation, except the KL band, which has no closed form and bisects in Arrow batches.
Null log-probabilities give null bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

MIN_LOGP = -700.0
Bounds = tuple[Column, Column]


def clamp(x: Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    if lo is not None:
        x = F.greatest(x, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        x = F.least(x, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return x


def probability(logp: Column) -> Column:
    return F.exp(clamp(logp, MIN_LOGP, 0.0))


def _tv(p: Column, delta: float) -> Bounds:
    step = F.lit(delta) / p
    return clamp(1 - step, lo=0.0), F.least(1 + step, 1 / p)


def _chi2(p: Column, delta: float) -> Bounds:
    step = F.sqrt(F.lit(delta) * (1 - p) / p)
    return clamp(1 - step, lo=0.0), F.least(1 + step, 1 / p)


def divergence(f: Callable, p, r, floor: float = 1e-12):
    """p f(r) + (1-p) f((1-rp)/(1-p)) with both arguments floored; for Columns and arrays alike."""
    if isinstance(p, Column):
        return p * f(F.greatest(r, F.lit(floor))) + (1 - p) * f(F.greatest((1 - r * p) / (1 - p), F.lit(floor)))
    return p * f(np.maximum(r, floor)) + (1 - p) * f(np.maximum((1 - r * p) / (1 - p), floor))


def f_kl(u):
    return (-F.log(u) if isinstance(u, Column) else -np.log(u)) + u - 1


def f_tv(u):
    return 0.5 * (F.abs(u - 1) if isinstance(u, Column) else np.abs(u - 1))


def f_chi2(u):
    return (u - 1) * (u - 1)


def saturation(p: Column, delta: float, f: Callable = f_kl) -> tuple[Column, Column]:
    """Whether the simplex end r = 1/p, and r = 0, still lies within the trust region: (upper, lower)."""
    return divergence(f, p, 1 / p) <= delta, divergence(f, p, F.lit(0.0)) <= delta


def bisect(p: np.ndarray, delta: float, f: Callable, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper root of divergence(r) = delta by a fixed number of halvings, all tokens of a batch at once."""
    with np.errstate(all="ignore"):
        found = []
        for inner, outer in ((np.ones_like(p), np.zeros_like(p)), (np.ones_like(p), 1 / p)):
            end = outer.copy()
            for _ in range(rounds):
                mid = 0.5 * (inner + outer)
                inside = divergence(f, p, mid) < delta
                inner, outer = np.where(inside, mid, inner), np.where(inside, outer, mid)
            found.append(np.where(divergence(f, p, end) <= delta, end, 0.5 * (inner + outer)))
    return found[0], found[1]


def _solver(delta: float, f: Callable):
    @F.pandas_udf(Ty.StructType([Ty.StructField("lower", Ty.DoubleType()), Ty.StructField("upper", Ty.DoubleType())]))
    def solve(p: pd.Series) -> pd.DataFrame:
        lo, up = bisect(p.to_numpy(dtype=float, na_value=np.nan), delta, f)
        return pd.DataFrame({"lower": lo, "upper": up})

    return solve


def _bisected(f: Callable) -> Callable[[Column, float], Bounds]:
    def bounds(p: Column, delta: float) -> Bounds:
        s = _solver(delta, f)(p)
        return F.when(p.isNotNull(), s["lower"]), F.when(p.isNotNull(), s["upper"])

    return bounds


#: Divergences: name -> (bounds of (p, delta), lower bound as p goes to 1). Add a row to add a divergence.
DIVERGENCES: dict[str, tuple[Callable[[Column, float], Bounds], Callable[[float], float]]] = {
    "bandkl": (_bisected(f_kl), lambda d: math.exp(-d)),
    "bandtv": (_tv, lambda d: max(1 - d, 0.0)),
    "bandchi2": (_chi2, lambda d: 1.0),
}


def band(logp: Column, method: str = "bandkl", delta: float = 0.05, eps_low: float = 0.2, eps_high: float = 0.28, relax: bool = True, most: float = 100.0) -> Bounds:
    """Probability-aware bounds: the divergence's own, its limits at the ends of p, relaxed to 1 -/+ eps, then clamped to [0, 1] and [1, most]."""
    if method not in DIVERGENCES:
        raise ValueError(f"unknown divergence {method!r}; known: {sorted(DIVERGENCES)}")
    solve, at_one = DIVERGENCES[method]
    p = probability(logp)
    lower, upper = solve(p, delta)
    sure, rare = p > 1 - 1e-6, p < 1e-6
    upper = F.when(rare, 1 / clamp(p, lo=1e-12)).when(sure, F.lit(1.0)).otherwise(upper)
    lower = F.when(rare, F.lit(0.0)).when(sure, F.lit(at_one(delta))).otherwise(lower)
    if relax:
        lower, upper = clamp(lower, hi=1 - eps_low), clamp(upper, lo=1 + eps_high)
    return F.when(logp.isNotNull(), clamp(lower, 0.0, 1.0)), F.when(logp.isNotNull(), clamp(upper, 1.0, most))


def newton(p: np.ndarray, delta: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the KL divergence by Newton steps on log r, kept inside a bracket that halves where a step would leave it."""
    out = []
    with np.errstate(all="ignore"):
        top = -np.log(p)
        for side in (-1.0, 1.0):
            inner, outer = np.zeros_like(p), np.full_like(p, -745.0) if side < 0 else top.copy()
            x = np.clip(side * np.sqrt(2 * delta * (1 - p) / p), np.minimum(inner, outer), np.maximum(inner, outer)) / 2
            for _ in range(rounds):
                r = np.exp(x)
                gap = divergence(f_kl, p, r) - delta
                inner, outer = np.where(gap < 0, x, inner), np.where(gap < 0, outer, x)
                slope = -p + p * r * (1 - p) / np.maximum(1 - r * p, 1e-300)
                step = x - gap / slope
                inside = (step > np.minimum(inner, outer)) & (step < np.maximum(inner, outer))
                x = np.where(inside, step, 0.5 * (inner + outer))
            end = 0.0 * p if side < 0 else 1 / p
            out.append(np.where(divergence(f_kl, p, end) <= delta, end, np.exp(x)))
    return out[0], out[1]


def token_kl_bounds(logp: Column, delta: float, solve: str = "bisect", rounds: int = 50) -> Bounds:
    """Ratio bounds of a token under a KL budget from its old log-probability, by bisection or by safeguarded Newton steps."""
    if solve not in ("bisect", "newton"):
        raise ValueError(f"unknown solver {solve!r}")

    @F.pandas_udf(Ty.StructType([Ty.StructField("lower", Ty.DoubleType()), Ty.StructField("upper", Ty.DoubleType())]))
    def run(p: pd.Series) -> pd.DataFrame:
        x = p.to_numpy(dtype=float, na_value=np.nan)
        lo, up = bisect(x, delta, f_kl, rounds) if solve == "bisect" else newton(x, delta, rounds)
        return pd.DataFrame({"lower": lo, "upper": up})

    s = run(probability(logp))
    return F.when(logp.isNotNull(), s["lower"]), F.when(logp.isNotNull(), s["upper"])


def dcpo(logp: Column, eps_low: float = 0.16, eps_high: float = 0.2, most: float = 10.0, floor: float = 1e-12) -> Bounds:
    """1/2 +- 1/2 sqrt(1 +- 4 eps / q), the upper one under a ceiling."""
    if eps_low < 0 or eps_high < 0 or most < 1 or floor <= 0:
        raise ValueError("eps must not be negative, the ceiling at least 1 and the floor positive")
    q = clamp(probability(logp), lo=floor)
    low = 0.5 + 0.5 * F.sqrt(clamp(1 - F.lit(4 * eps_low) / q, lo=0.0))
    high = 0.5 + 0.5 * F.sqrt(1 + F.lit(4 * eps_high) / q)
    return clamp(low, 0.0, 1.0), clamp(high, 1.0, most)


def cubic(logp: Column, coefficients: tuple[float, float, float, float], method: str = "sub", floor: float = 1e-12, least: float = 0.0, most: float = 10.0) -> Bounds:
    """Bounds from a cubic change of p: up(p) and down(p) = -up(1 - p). "sub" clamps p + change to [0, 1] first, "div" does not."""
    a, b, c, d = (F.lit(float(x)) for x in coefficients)
    p, q = F.exp(logp), -F.expm1(logp)
    up = ((a * p + b) * p + c) * p + d
    down = -(((a * q + b) * q + c) * q + d)
    inv = 1 / clamp(p, lo=floor)
    if method == "sub":
        high, low = clamp(p + up, hi=1.0) * inv, clamp(p + down, lo=0.0) * inv
    elif method == "div":
        high, low = 1 + (a * p + b) * p + c + d * inv, 1 + down * inv
    else:
        raise ValueError("method is 'sub' or 'div'")
    high, low = clamp(high, least, most), clamp(low, least, most)
    return F.least(low, high), high


def cubic_coefficients(delta: float) -> tuple[float, float, float, float]:
    """Cubic with leading coefficient -4D through up(0) = D, up(1) = 0 and up(1/2) = H, D = 1 - e^-delta, H = sqrt(1 - e^-2delta) / 2."""
    big, half = -math.expm1(-delta), 0.5 * math.sqrt(-math.expm1(-2 * delta))
    return -4 * big, 8 * big - 4 * half, 4 * half - 5 * big, big


def _safe(x: Column, tiny: float) -> Column:
    return F.when(F.abs(x) < tiny, F.lit(tiny)).otherwise(x)


def soft_1seg(r: Column, low: Column, high: Column, k: float | None = None, tiny: float = 1e-12) -> Column:
    """One tanh through the middle of the bounds, asymptotic to both."""
    mid, half = 0.5 * (low + high), 0.5 * (high - low)
    slope = 1 / _safe(half, tiny) if k is None else F.lit(float(k))
    return mid + half * F.tanh(slope * (r - mid))


def soft_2seg(r: Column, low: Column, high: Column, k: float = 1.0, tiny: float = 1e-12) -> Column:
    """A tanh on each side of 1, continuous in value and slope; the identity where a side has no width."""
    up, down = high - 1, 1 - low
    side = F.when(r >= 1, 1 + up * F.tanh(F.lit(k) / _safe(up, tiny) * (r - 1))).otherwise(1 + down * F.tanh(F.lit(k) / _safe(down, tiny) * (r - 1)))
    return F.when((F.abs(up) < tiny) | (F.abs(down) < tiny), r).otherwise(side)


def _atanh(x: Column) -> Column:
    return 0.5 * (F.log1p(x) - F.log1p(-x))


def _split(low: Column, high: Column, rho: float) -> Bounds:
    return F.lit(rho) + (1 - rho) * low, F.lit(rho) + (1 - rho) * high


def _three(r: Column, e_low: Column, e_high: Column, below: Column, above: Column, between: Column | None = None) -> Column:
    return F.when(r <= e_low, below).when(r >= e_high, above).otherwise(r if between is None else between)


def soft_3seg(r: Column, low: Column, high: Column, rho: float = 0.1, tiny: float = 1e-12) -> Column:
    """Identity in the middle, tanh tails that meet it in value and slope."""
    e_low, e_high = _split(low, high, rho)

    def tail(width: Column, inner: Column, sign: int) -> Column:
        gap = width * width - inner * inner
        kappa = width / F.when(F.abs(gap) < tiny, F.signum(gap) * tiny).otherwise(gap)
        shift = _atanh(clamp(inner / _safe(width, tiny), tiny - 1, 1 - tiny)) - kappa * inner
        return F.when(F.abs(width) < tiny, r).otherwise(1 + width * F.tanh(kappa * (r - 1) + sign * shift))

    return _three(r, e_low, e_high, tail(1 - low, 1 - e_low, -1), tail(high - 1, e_high - 1, 1))


def soft_3seg_converge(r: Column, low: Column, high: Column, rho: float = 0.1, g: float = 1.0) -> Column:
    """Identity in the middle; each tail starts on it with slope 1 at its split and converges to its bound at rate g."""
    e_low, e_high = _split(low, high, rho)
    big, eps = math.exp(2 * g), float(np.finfo(float).eps)

    def tail(width: Column, bound: Column, edge: Column, sign: int) -> Column:
        a = width * (1 + big) / 2 if sign > 0 else width * (1 + big) / (2 * big)
        b = F.lit((1 + math.exp(-2 * g)) / 2 if sign > 0 else (1 + big) / 2) / clamp(width, lo=eps)
        c = edge - 2 * g * width * (big if sign > 0 else 1.0) / (1 + big)
        return a * F.tanh(b * (r - c)) + (bound - a if sign > 0 else bound + a)

    return _three(r, e_low, e_high, clamp(tail(e_low - low, low, e_low, -1), lo=0.0), tail(high - e_high, high, e_high, 1))


def _inner(r: Column, low: Column, high: Column, alpha_in: float, tiny: float) -> Column:
    t = math.tanh(alpha_in)
    up, down = high - 1, 1 - low
    return F.when(r <= 1, 1 + down / t * F.tanh(F.lit(alpha_in) / _safe(down, tiny) * (r - 1))).otherwise(1 + up / t * F.tanh(F.lit(alpha_in) / _safe(up, tiny) * (r - 1)))


def soft_rollback(r: Column, low: Column, high: Column, alpha: float = 0.1, activate: bool = False, alpha_in: float = 2.0, tiny: float = 1e-12) -> Column:
    """Identity (or a tanh) inside; outside pulled back by alpha tanh(r - 1)."""
    wide = F.lit(alpha) * (high / _safe(low, tiny)) * (high / _safe(low, tiny))
    below = low - alpha * F.tanh(r - 1) - alpha * F.tanh(1 - low)
    above = high - wide * F.tanh(r - 1) + wide * F.tanh(high - 1)
    return _three(r, low, high, below, above, _inner(r, low, high, alpha_in, tiny) if activate else None)


def soft_rollback_plus(r: Column, low: Column, high: Column, alpha: float = 0.1, gamma: float = 0.2, activate: bool = False, alpha_in: float = 2.0, tiny: float = 1e-12) -> Column:
    """As ``soft_rollback`` with slope gamma, measured from the bounds and scaled by the widths' ratio."""
    wide = F.lit(alpha) * (high - 1) / (1 - low)
    below = low - alpha * F.tanh(gamma * (r - low))
    above = high - wide * F.tanh(gamma * (r - high))
    return _three(r, low, high, below, above, _inner(r, low, high, alpha_in, tiny) if activate else None)


#: Soft clips by name.
SOFT_CLIPS: dict[str, Callable[..., Column]] = {
    "1seg": soft_1seg,
    "2seg": soft_2seg,
    "3seg": soft_3seg,
    "3seg_converge": soft_3seg_converge,
    "3seg_rollback": soft_rollback,
    "3seg_rollback_activate": lambda r, lo, hi, **k: soft_rollback(r, lo, hi, activate=True, **k),
    "3seg_rollback_plus": soft_rollback_plus,
    "3seg_rollback_plus_activate": lambda r, lo, hi, **k: soft_rollback_plus(r, lo, hi, activate=True, **k),
    "hard": lambda r, lo, hi: F.least(F.greatest(r, lo), hi),
    "none": lambda r, lo, hi: r,
}


def soft_clip(r: Column, low: Column, high: Column, method: str, **options: float) -> Column:
    if method not in SOFT_CLIPS:
        raise ValueError(f"unknown soft clip {method!r}; known: {sorted(SOFT_CLIPS)}")
    return SOFT_CLIPS[method](r, low, high, **options)


def decay_linear(t: Column, start: float, end: float) -> Column:
    return start + (end - start) * clamp(t, 0.0, 1.0)


def decay_hold_linear(t: Column, start: float, end: float, hold: float = 0.3) -> Column:
    hold = min(max(hold, 0.0), 0.999999)
    s = clamp(t, 0.0, 1.0)
    return F.when(s <= hold, F.lit(float(start))).otherwise(start + (end - start) / (1 - hold) * (s - hold))


def decay_cosine(t: Column, start: float, end: float) -> Column:
    return end + 0.5 * (start - end) * (1 + F.cos(math.pi * clamp(t, 0.0, 1.0)))


def decay_poly(t: Column, start: float, end: float, exponent: float = 2.0) -> Column:
    if exponent <= 0:
        raise ValueError("the exponent must be positive")
    return end + (start - end) * F.pow(1 - clamp(t, 0.0, 1.0), F.lit(float(exponent)))


def cycles(first: float, factor: float) -> list[tuple[float, float]]:
    """(start, length) of the cycles that cover [0, 1]; the last one is cut at 1."""
    if first <= 0 or factor <= 0:
        raise ValueError("cycle lengths must be positive")
    out, at, length = [], 0.0, first
    while at < 1 - 1e-12:
        out.append((at, min(length, 1 - at)))
        at += out[-1][1]
        length *= factor
    return out


def decay_restarts(t: Column, start: float, end: float, mode: str = "expanding", first: float = 0.15, factor: float = 2.0, decay: bool = False, gamma: float = 0.8, shape: str = "cosine") -> Column:
    """Warm restarts: cosine cycles (amplitude times gamma per cycle if ``decay``) or constant steps from start to end."""
    cs = cycles(first, 1.0 if mode == "fixed" else factor)
    s = clamp(t, 0.0, 1.0)
    out = None
    for k, (a, n) in reversed(list(enumerate(cs))):
        if shape == "cosine":
            y = end + 0.5 * (start - end) * (gamma**k if decay else 1.0) * (1 + F.cos(math.pi * (s - a) / n))
        elif shape == "constant":
            y = F.lit(start + (end - start) * k / (len(cs) - 1) if decay and len(cs) > 1 else float(start))
        else:
            raise ValueError(f"unknown shape {shape!r}")
        out = y if out is None else F.when(s < cs[k + 1][0], y).otherwise(out)
    return out


#: Schedules by name.
DECAYS: dict[str, Callable[..., Column]] = {"linear": decay_linear, "hold_linear": decay_hold_linear, "cosine": decay_cosine, "poly": decay_poly, "restarts": decay_restarts}


def decay(t: Column, method: str, start: float, end: float, **options: object) -> Column:
    if method not in DECAYS:
        raise ValueError(f"unknown schedule {method!r}; known: {sorted(DECAYS)}")
    return DECAYS[method](t, start, end, **options)
