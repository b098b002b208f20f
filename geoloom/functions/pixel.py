"""Pixel functions over an array column of band values (null: no data).

SKIP functions ignore nulls; PROP functions are null if any input is; any SKIP function becomes PROP on demand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def ieee_div(a: Column, b: Column) -> Column:
    """Division without errors: infinities and NaN."""
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.when(a > 0, F.lit(INF)).otherwise(F.lit(-INF)))).otherwise(a / F.when(b != 0, b))


def _sum(vals: Column, start: float = 0.0) -> Column:
    return F.aggregate(vals, F.lit(float(start)), lambda acc, x: acc + x)


def _round(v: Column, digits: int) -> Column:
    p = F.lit(10.0**digits)
    return F.signum(v) * F.floor(F.abs(v * p) + 0.5) / p


def _at(sorted_vals: Column, q: float) -> Column:
    """Linear interpolation at q (n - 1) in a sorted array."""
    place = F.lit(float(q)) * (F.size(sorted_vals) - 1)
    low = F.floor(place).cast("int")
    a, b = F.get(sorted_vals, low), F.get(sorted_vals, F.least(low + 1, F.size(sorted_vals) - 1))
    return a + (b - a) * (place - low)


def _mode(vals: Column) -> Column:
    """The most frequent value; the first seen wins ties."""
    best = F.aggregate(
        F.transform(vals, lambda x, i: F.struct(F.size(F.filter(vals, lambda y: y == x)).alias("n"), (-i).alias("i"), x.alias("v"))),
        F.struct(F.lit(0).alias("n"), F.lit(1).alias("i"), F.lit(None).cast("double").alias("v")),
        lambda acc, x: F.when((x["n"] > acc["n"]), F.struct(x["n"].alias("n"), x["i"].cast("int").alias("i"), x["v"].alias("v"))).otherwise(acc),
    )
    return best["v"]


SKIP: dict[str, Callable[..., Column]] = {
    "sum": lambda v, k=0.0: _sum(v, k),
    "mul": lambda v, k=1.0: F.aggregate(v, F.lit(float(k)), lambda acc, x: acc * x),
    "min": lambda v, k=None: F.array_min(v) if k is None else F.least(F.array_min(v), F.lit(float(k))),
    "max": lambda v, k=None: F.array_max(v) if k is None else F.greatest(F.array_max(v), F.lit(float(k))),
    "mean": lambda v: _sum(v) / F.size(v),
    "median": lambda v: _at(F.array_sort(v), 0.5),
    "mode": _mode,
    "geometric_mean": lambda v: _geometric(v),
    "harmonic_mean": lambda v: F.when(F.exists(v, lambda x: x == 0), 0.0).otherwise(_harmonic(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + ieee_div(F.lit(1.0), x)), F.size(v))),
    "quantile": lambda v, q=0.5: _at(F.array_sort(v), q),
}


def _geometric(v: Column) -> Column:
    """By logarithms, so that no product overflows; a negative product has no root."""
    odd = F.size(F.filter(v, lambda x: x < 0)) % 2 == 1
    size = F.exp(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.log(F.abs(x))) / F.size(v))
    return F.when(F.exists(v, lambda x: x == 0), 0.0).when(odd, F.lit(NAN)).otherwise(size)


def _harmonic(inverse: Column, n: Column) -> Column:
    return F.when(inverse > 0, n / F.when(inverse > 0, inverse)).otherwise(0.0)


PROP: dict[str, Callable[..., Column]] = {
    "sqrt": lambda v: F.sqrt(v),
    "log10": lambda v: F.log10(F.abs(v)),
    "exp": lambda v, base=2.718281828459045, fact=1.0: F.pow(F.lit(float(base)), v * fact),
    "pow": lambda v, power=1.0: F.pow(v, F.lit(float(power))),
    "inv": lambda v, k=1.0: ieee_div(F.lit(float(k)), v),
    "round": lambda v, digits=0: _round(v, digits),
    "dB": lambda v, fact=20.0: F.lit(float(fact)) * F.log10(F.abs(v)),
    "dB2amp": lambda v: F.pow(F.lit(10.0), v / 20.0),
    "dB2pow": lambda v: F.pow(F.lit(10.0), v / 10.0),
    "scale": lambda v, scale=1.0, offset=0.0: v * scale + offset,
}
PAIR: dict[str, Callable[[Column, Column], Column]] = {
    "diff": lambda a, b: a - b,
    "div": ieee_div,
    "norm_diff": lambda a, b: ieee_div(a - b, a + b),
}


def _interpolate(vals: Column, n: Column, t0: float, dt: float, t: float, kind: str) -> Column:
    place = (F.lit(float(t)) - t0) / dt
    low = F.greatest(F.lit(0), F.least(F.floor(place).cast("int"), n - 2))
    a, b, part = F.get(vals, low), F.get(vals, low + 1), place - low
    return a + (b - a) * part if kind == "interpolate_linear" else a * F.pow(ieee_div(b, a), part)


def apply(name: str, vals: Column, propagate: bool = False, **args: float) -> Column:
    """A pixel function over array<double>."""
    valid = F.filter(vals, lambda x: x.isNotNull())
    any_null = F.exists(vals, lambda x: x.isNull())
    if name in SKIP:
        out = F.when(F.size(valid) > 0, SKIP[name](valid, **args))
        return F.when(~any_null, out) if propagate else out
    if name in PROP:
        return PROP[name](F.get(vals, F.lit(0)), **args)
    if name in PAIR:
        return F.when(~any_null, PAIR[name](F.get(vals, F.lit(0)), F.get(vals, F.lit(1))))
    if name.startswith("interpolate_"):
        return F.when(~any_null, _interpolate(vals, F.size(vals), args["t0"], args["dt"], args["t"], name))
    if name == "replace_nodata":
        return F.coalesce(F.get(vals, F.lit(0)), F.lit(float(args.get("to", NAN))))
    raise ValueError(f"unknown pixel function {name}")


# Complex algebra over struct(re, im).
def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def cmul(a: Column, b: Column) -> Column:
    """a times the conjugate of b."""
    return complex_of(a["re"] * b["re"] + a["im"] * b["im"], a["im"] * b["re"] - a["re"] * b["im"])


def polar(amplitude: Column, phase: Column) -> Column:
    return complex_of(amplitude * F.cos(phase), amplitude * F.sin(phase))


def modulus(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def phase(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def conj(z: Column) -> Column:
    return complex_of(z["re"], -z["im"])


def intensity(z: Column) -> Column:
    return z["re"] * z["re"] + z["im"] * z["im"]
