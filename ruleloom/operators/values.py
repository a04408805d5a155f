"""Units, instants and durations: compile-time algebra and Column expressions."""

from __future__ import annotations

import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of the duration units (fixed values).
MILLIS = {"ms": 1, "s": 1000, "min": 60_000, "h": 3_600_000, "d": 86_400_000}
#: Instants lie within so many milliseconds of the epoch (fixed value).
INSTANT_LIMIT = 8_640_000_000_000_000


def tidy(unit: dict | None) -> dict:
    return {k: v for k, v in (unit or {}).items() if v}


def times(a: dict, b: dict, sign: int = 1) -> dict:
    return tidy({k: a.get(k, 0) + sign * b.get(k, 0) for k in [*a, *(k for k in b if k not in a)]})


def halved(unit: dict) -> dict | None:
    return None if any(v % 2 for v in unit.values()) else {k: v / 2 for k, v in unit.items()}


INSTANT = re.compile(
    r"(?P<y>\d{4}|[+-]\d{6})(?:-(?P<mo>\d\d)(?:-(?P<d>\d\d))?)?(?:T(?P<h>\d\d):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:\.(?P<f>\d+))?)?(?P<z>Z|[+-]\d\d:\d\d))?"
)


def _days(y: int, m: int, d: int) -> int:
    """Days from 1970-01-01 in the proleptic Gregorian calendar."""
    y -= m <= 2
    era = y // 400
    of_era = y - era * 400
    of_year = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146_097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year - 719_468


def _month_length(y: int, m: int) -> int:
    return 28 + (y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)) if m == 2 else 30 + (m + m // 8) % 2


def parse_instant(text: str) -> int | None:
    """Milliseconds since the epoch; None if the text is no instant. A date alone is UTC midnight; fractions are cut to three digits."""
    m = INSTANT.fullmatch(text)
    if not m or m["y"] == "-000000":
        return None
    y, mo, d = int(m["y"]), int(m["mo"] or 1), int(m["d"] or 1)
    h, mi, s = int(m["h"] or 0), int(m["mi"] or 0), int(m["s"] or 0)
    ms = int(((m["f"] or "") + "000")[:3])
    if not (1 <= mo <= 12 and 1 <= d <= _month_length(y, mo) and mi <= 59 and s <= 59 and (h <= 23 or h == 24 and not (mi or s or int(m["f"] or 0)))):
        return None
    offset = 0
    if m["z"] and m["z"] != "Z":
        oh, om = int(m["z"][1:3]), int(m["z"][4:])
        if oh > 23 or om > 59:
            return None
        offset = (oh * 60 + om) * (-1 if m["z"][0] == "-" else 1)
    out = _days(y, mo, d) * 86_400_000 + ((h * 60 + mi - offset) * 60 + s) * 1000 + ms
    return out if abs(out) <= INSTANT_LIMIT else None


def format_instant(ms: int) -> str:
    """The ISO form with milliseconds and Z; years outside 0 to 9999 take a sign and six digits."""
    days, rest = divmod(ms, 86_400_000)
    z = days + 719_468
    era, doe = divmod(z, 146_097)
    yoe = (doe - doe // 1460 + doe // 36_524 - doe // 146_096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    d, m = doy - (153 * mp + 2) // 5 + 1, mp + (3 if mp < 10 else -9)
    y = yoe + era * 400 + (m <= 2)
    year = f"{y:04d}" if 0 <= y <= 9999 else f"{y:+07d}"
    return f"{year}-{m:02d}-{d:02d}T{rest // 3_600_000:02d}:{rest // 60_000 % 60:02d}:{rest // 1000 % 60:02d}.{rest % 1000:03d}Z"


def _fdiv(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(float(b))).cast("long")


def instant_of_text(col: Column) -> Column:
    """parse_instant over a string column: a shape test, then integer arithmetic; NULL where the text is no instant."""
    pattern = "^" + re.sub(r"\?P<\w+>", "", INSTANT.pattern) + "$"
    part = lambda i: F.regexp_extract(col, pattern, i)
    number = lambda i, empty: F.when(part(i) == "", F.lit(empty)).otherwise(part(i).try_cast("long"))
    y, mo, d, h, mi, s = number(1, 0), number(2, 1), number(3, 1), number(4, 0), number(5, 0), number(6, 0)
    ms = F.rpad(part(7), 3, "0").try_cast("long")
    zone = part(8)
    oh, om = F.substring(zone, 2, 2).try_cast("long"), F.substring(zone, 5, 2).try_cast("long")
    offset = F.when(zone.isin("", "Z"), F.lit(0)).otherwise((oh * 60 + om) * F.when(zone.startswith("-"), -1).otherwise(1))
    yy = y - F.when(mo <= 2, 1).otherwise(0)
    era = _fdiv(yy, 400)
    yoe = yy - era * 400
    doy = _fdiv(153 * (mo + F.when(mo > 2, -3).otherwise(9)) + 2, 5) + d - 1
    days = era * 146_097 + yoe * 365 + _fdiv(yoe, 4) - _fdiv(yoe, 100) + doy - 719_468
    leap = (F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0))
    length = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    late = (h == 24) & (mi == 0) & (s == 0) & ~part(7).rlike("[1-9]")
    ok = (
        col.rlike(pattern.replace("$", "\\z").replace("^", "\\A")) & (part(1) != "-000000") & mo.between(1, 12) & (d >= 1) & (d <= length)
        & (mi <= 59) & (s <= 59) & ((h <= 23) | late) & (zone.isin("", "Z") | ((oh <= 23) & (om <= 59)))
    )
    out = days * 86_400_000 + ((h * 60 + mi - offset) * 60 + s) * 1000 + ms
    return F.when(ok & (F.abs(out) <= INSTANT_LIMIT), out)


def instant_of_time(col: Column, kind: str) -> Column:
    """Milliseconds of a timestamp, timestamp_ntz (taken as UTC) or date column."""
    if kind == "timestamp":
        return F.unix_millis(col)
    if kind == "date":
        return F.unix_date(col).cast("long") * 86_400_000
    day = F.unix_date(F.to_date(col)).cast("long")
    seconds = F.extract(F.lit("SECOND"), col).cast("decimal(8,6)")
    return day * 86_400_000 + F.hour(col).cast("long") * 3_600_000 + F.minute(col) * 60_000 + F.floor(seconds * 1000).cast("long")


def duration_order(a: Column, ua: str, b: Column, ub: str) -> Column:
    """-1, 0 or 1 by exact size, for finite magnitudes in their units.

    The finer magnitude is divided by the ratio of the units. Where the rounded quotient equals the coarser magnitude, the
    coarser one is split into two halves whose products with the ratio are exact, and what remains decides.
    """
    fa, fb = MILLIS[ua], MILLIS[ub]
    if fa > fb:
        return -duration_order(b, ub, a, ua)
    ratio = F.lit(float(fb // fa))
    q = a / ratio
    scale = F.when(F.abs(b) > 1e280, F.lit(2.0**-200)).otherwise(F.lit(1.0))
    x, y = a * scale, b * scale
    c = y * F.lit(134_217_729.0)
    high = c - (c - y)
    exact = F.signum((x - high * ratio) - (y - high) * ratio)
    return F.when(q < b, -1).when(q > b, 1).when(F.lit(fa == fb), 0).otherwise(exact).cast("int")


def balanced(op, items: list):
    """Combine by halves, so that a long list makes a shallow expression."""
    while len(items) > 1:
        items = [op(*items[i : i + 2]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


def finite(v: Column) -> Column:
    return F.abs(v) < F.lit(float("inf"))


def power_of(base, exponent: int, times_, one):
    """base ** exponent by squaring, for any product."""
    out, square = one, base
    while exponent:
        if exponent & 1:
            out = times_(out, square)
        exponent >>= 1
        if exponent:
            square = times_(square, square)
    return out


def total(columns):
    return reduce(lambda a, b: a + b, columns)


def units_equal(a: dict | None, b: dict | None) -> bool:
    return tidy(a) == tidy(b)


def divided(a: dict, b: dict) -> dict:
    return times(a, b, -1)


def number_text(x: float) -> str:
    """A double as JSON and scripts write it: the shortest digits that read back, exponents from 1e21 on and below 1e-6."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(float(x))).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = exponent + len(digits)  # the place of the decimal point from the first digit
    n = len(text)
    if n <= point <= 21:
        out = text + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        e = point - 1
        out = text[0] + ("." + text[1:] if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return "-" + out if sign else out


def text_of_number(col: Column) -> Column:
    """number_text over a column; NULL stays. Doubles whose plain text Java writes alike stay in generated code."""
    plain = (F.abs(col) >= F.lit(1e-3)) & (F.abs(col) < F.lit(1e7))
    java = F.regexp_replace(col.cast("string"), r"\.0$", "")
    return F.when(plain, java).when(col.isNotNull(), _number_text_udf()(F.when(~plain, col)))


def _number_text_udf():
    @F.pandas_udf("string")
    def text(xs):
        import pandas as pd

        return pd.Series([None if x is None else number_text(x) for x in xs.astype(object).where(xs.notna() | (xs != xs), None)], dtype=object)

    return text
