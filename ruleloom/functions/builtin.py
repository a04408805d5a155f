"""The built-in functions: what a `call` node can name. Each takes the lowering and its lowered arguments.

Arguments of a wrong count, kind or unit are wrong-type, known while lowering; arguments outside a function's domain and
results that aren't finite are domain errors of the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ruleloom.operators import complexnum as cx
from ruleloom.operators import values as val


def _why(code, message):
    from ruleloom.plans.lower import reason

    return reason(code, message)


def _extreme(name, better):
    def make(low, args):
        if not args:
            return low.wrong(args, f"{name} requires at least one number argument")
        if any(e.kind != "number" for e in args):
            return low.wrong(args, f"{name} requires number arguments only")
        if any((e.unit or {}) != (args[0].unit or {}) for e in args):
            return low.wrong(args, f"{name} requires arguments in the same unit")
        known = lambda c: reduce(lambda x, y: x & y, [x.isNotNull() for x in c])
        return low.checked(args, "number", lambda c: F.when(known(c), reduce(better, c)), unit=args[0].unit)

    return make


def _real(name, value, domain=None, message=None, keep_unit=False):
    """A function of one real number."""

    def make(low, args):
        if len(args) != 1 or args[0].kind != "number":
            return low.wrong(args, f"{name} requires exactly one number argument")
        if not keep_unit and args[0].unit:
            return low.wrong(args, f"{name} requires a dimensionless number")
        why = (lambda c: F.when(~domain(c[0]), _why("domain-error", message))) if domain else None
        body = (lambda c: F.when(domain(c[0]), value(c[0]))) if domain else lambda c: value(c[0])
        return low.checked(args, "number", body, why, args[0].unit if keep_unit else {})

    return make


def _half_away(x, places):
    """Halves away from zero, on the decimal text of the double, as Spark's round does; large values stay."""
    return F.round(x, places)


def _round(low, args):
    if len(args) not in (1, 2) or any(e.kind != "number" for e in args):
        return low.wrong(args, "round requires a number and, optionally, a number of decimal places")
    if len(args) == 1:
        return low.checked(args, "number", lambda c: _half_away(c[0], 0), unit=args[0].unit)
    if args[1].unit:
        return low.wrong(args, "round requires its decimal places to be a dimensionless number")
    whole = lambda c: c[1] == F.floor(c[1])
    why = lambda c: F.when(~whole(c), _why("domain-error", "round requires its decimal places to be an integer"))
    if args[1].literal is not None:
        p = args[1].literal
        if p != int(p):
            return low.wrong(args, "round requires its decimal places to be an integer", "number", "domain-error")
        return low.checked(args, "number", lambda c: F.when(c[1].isNotNull(), _half_away(c[0], max(-400, min(400, int(p))))), unit=args[0].unit)

    def any_places(c):
        # the scale of round must be constant: one branch for each scale a double can have digits at
        out = F.when(c[1] > 22, c[0]).when(c[1] < -22, F.lit(0.0))
        for p in range(-22, 23):
            out = out.when(c[1] == p, _half_away(c[0], p))
        return F.when(whole(c), out)

    return low.checked(args, "number", any_places, why, args[0].unit)


def _square_root(low, args):
    if len(args) != 1 or args[0].kind not in ("number", "complex"):
        return low.wrong(args, "squareRoot requires exactly one number or complex argument")
    unit = val.halved(args[0].unit or {})
    if unit is None:
        return low.wrong(args, "squareRoot requires every unit exponent to be even")
    if args[0].kind == "complex":
        return low.checked(args, "complex", lambda c: F.when(c[0].isNotNull(), cx.square_root(c[0])), unit=unit)
    why = lambda c: F.when(c[0] < 0, _why("domain-error", "squareRoot of a negative number is not a real number"))
    return low.checked(args, "number", lambda c: F.when(c[0] >= 0, F.sqrt(c[0])), why, unit)


def _exponential(low, args):
    if len(args) != 1 or args[0].kind not in ("number", "complex"):
        return low.wrong(args, "exponential requires exactly one number or complex argument")
    if args[0].unit:
        return low.wrong(args, "exponential requires a dimensionless number")
    if args[0].kind == "complex":
        return low.checked(args, "complex", lambda c: F.when(c[0].isNotNull(), cx.exponential(c[0])), unit={})
    return low.checked(args, "number", lambda c: F.exp(c[0]), unit={})


def _logarithm(low, args):
    if len(args) not in (1, 2) or args[0].kind not in ("number", "complex") or len(args) == 2 and args[1].kind != "number":
        return low.wrong(args, "logarithm requires a number or complex argument and, optionally, a number as its base")
    if args[0].unit:
        return low.wrong(args, "logarithm requires a dimensionless number")
    if len(args) == 2 and args[1].unit:
        return low.wrong(args, "logarithm requires its base to be a dimensionless number")
    is_complex = args[0].kind == "complex"
    inside = (lambda x: ~cx.is_zero(x)) if is_complex else (lambda x: x > 0)
    based = len(args) == 2
    good_base = (lambda c: (c[1] > 0) & (c[1] != 1)) if based else (lambda c: F.lit(True))

    def value(c):
        if is_complex:
            z = cx.logarithm(c[0])
            out = cx.make(z["re"] / F.log(c[1]), z["im"] / F.log(c[1])) if based else z
        elif not based:
            out = F.log(c[0])
        elif args[1].literal in (10, 2):
            out = F.log10(c[0]) if args[1].literal == 10 else F.log2(c[0])
        else:
            out = F.when(c[1] == 10, F.log10(c[0])).when(c[1] == 2, F.log2(c[0])).otherwise(F.log(c[0]) / F.log(c[1]))
        return F.when(inside(c[0]) & good_base(c), out)

    def why(c):
        text = "logarithm requires a complex number other than zero" if is_complex else "logarithm requires a number above zero"
        return F.when(~inside(c[0]), _why("domain-error", text)).when(~good_base(c), _why("domain-error", "logarithm requires its base to be above zero and not one"))

    return low.checked(args, args[0].kind, value, why, {})


def _magnitude(low, args):
    if len(args) != 1:
        return low.wrong(args, "magnitude requires exactly one argument")
    if args[0].kind not in ("number", "complex"):
        return low.wrong(args, "magnitude requires a number or a complex number")
    return low.checked(args, "number", lambda c: F.abs(c[0]) if args[0].kind == "number" else cx.magnitude(c[0]), unit=args[0].unit)


def _phase(low, args):
    if len(args) != 1 or args[0].kind != "complex":
        return low.wrong(args, "phase requires exactly one complex argument")
    why = lambda c: F.when(~cx.is_finite(c[0]), _why("domain-error", "phase requires finite components"))
    return low.checked(args, "number", lambda c: F.when(cx.is_finite(c[0]), cx.phase(c[0])), why, {})


def _arc_tangent2(low, args):
    if len(args) != 2 or any(e.kind != "number" for e in args):
        return low.wrong(args, "arcTangent2 requires exactly two number arguments")
    if any(e.unit for e in args):
        return low.wrong(args, "arcTangent2 requires dimensionless numbers")
    ok = lambda c: val.finite(c[0]) & val.finite(c[1])
    why = lambda c: F.when(~ok(c), _why("domain-error", "arcTangent2 requires finite arguments"))
    return low.checked(args, "number", lambda c: F.when(ok(c), F.atan2(c[0] + F.lit(0.0), c[1] + F.lit(0.0))), why, {})


def _within(x):
    return (x >= -1) & (x <= 1)


FUNCTIONS = {
    "minimum": _extreme("minimum", lambda a, b: F.when(b < a, b).otherwise(a)),
    "maximum": _extreme("maximum", lambda a, b: F.when(b > a, b).otherwise(a)),
    "absoluteValue": _real("absoluteValue", F.abs, keep_unit=True),
    "round": _round,
    "squareRoot": _square_root,
    "exponential": _exponential,
    "logarithm": _logarithm,
    "magnitude": _magnitude,
    "phase": _phase,
    "sine": _real("sine", F.sin),
    "cosine": _real("cosine", F.cos),
    "tangent": _real("tangent", F.tan),
    "arcSine": _real("arcSine", F.asin, _within, "arcSine requires a number from -1 to 1"),
    "arcCosine": _real("arcCosine", F.acos, _within, "arcCosine requires a number from -1 to 1"),
    "arcTangent": _real("arcTangent", F.atan),
    "arcTangent2": _arc_tangent2,
}
