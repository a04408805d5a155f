"""Complex numbers as structs of re and im."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(re, im) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def parts(z: Column) -> tuple[Column, Column]:
    return z["re"], z["im"]


def add(a, b):
    return make(a["re"] + b["re"], a["im"] + b["im"])


def subtract(a, b):
    return make(a["re"] - b["re"], a["im"] - b["im"])


def multiply(a, b):
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def divide(a, b):
    """a / b with b scaled by a power of two near its size, so that no square leaves the range; b is not zero."""
    size = F.greatest(F.abs(b["re"]), F.abs(b["im"]))
    scale = F.pow(F.lit(2.0), -F.floor(F.log2(size)).cast("double"))
    x, y = b["re"] * scale, b["im"] * scale
    norm = x * x + y * y
    p, q = a["re"], a["im"]
    return make((p * x + q * y) / norm * scale, (q * x - p * y) / norm * scale)


def is_zero(z):
    return (z["re"] == 0) & (z["im"] == 0)


def is_finite(z):
    inf = F.lit(float("inf"))
    return (F.abs(z["re"]) < inf) & (F.abs(z["im"]) < inf)


def equal(a, b):
    return (a["re"] == b["re"]) & (a["im"] == b["im"]) & ~(F.isnan(a["re"]) | F.isnan(a["im"]) | F.isnan(b["re"]) | F.isnan(b["im"]))


def magnitude(z):
    return F.hypot(z["re"], z["im"])


def phase(z):
    """The angle in [-pi, pi]; signed zeros count as zero, so the negative real axis has +pi."""
    return F.atan2(z["im"] + F.lit(0.0), z["re"] + F.lit(0.0))


def square_root(z):
    """The principal root, without cancellation."""
    re, im = parts(z)
    t = F.sqrt((F.abs(re) + F.hypot(re, im)) / 2)
    other = F.abs(im) / (2 * t)
    return F.when(is_zero(z), make(F.lit(0.0), F.lit(0.0))).when(re >= 0, make(t, im / (2 * t))).otherwise(make(other, F.when(im < 0, -t).otherwise(t)))


def exponential(z):
    return make(F.exp(z["re"]) * F.cos(z["im"]), F.exp(z["re"]) * F.sin(z["im"]))


def logarithm(z):
    return make(F.log(magnitude(z)), phase(z))


def from_polar(magnitude_: Column, angle: Column) -> Column:
    return make(magnitude_ * F.cos(angle), magnitude_ * F.sin(angle))
