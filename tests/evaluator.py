"""An independent evaluator for tests: plain Python over one row, written from the semantics and not from the lowering.

Values are (kind, value, unit); results are ("ok", value) or (code, None). Rows are dictionaries; lists of dictionaries are
collections.
"""

import math

ABSENT = ("not-found", None)


def ok(kind, v, unit=()):
    return "ok", (kind, v, tuple(sorted(unit)))


def reasons(results):
    bad = [r for r in results if r[0] != "ok"]
    return next((r for r in bad if r[0] == "not-yet-known"), bad[0])


def kleene(results, absorbing):
    if any(r[0] == "ok" and r[1] is absorbing for r in results):
        return "ok", absorbing
    return reasons(results) if any(r[0] != "ok" for r in results) else ("ok", not absorbing)


def predicate(n, row, acc=None):
    k = n["kind"]
    if k == "not":
        r = predicate(n["operand"], row)
        return ("ok", not r[1]) if r[0] == "ok" else r
    if k in ("and", "or"):
        return kleene([predicate(n["left"], row), predicate(n["right"], row)], k == "or")
    if k in ("allOf", "anyOf"):
        return kleene([predicate(x, row) for x in n["operands"]], k == "anyOf")
    if k == "compare":
        a, b = value(n["left"], row), value(n["right"], row)
        for r in (a, b):
            if r[0] != "ok":
                return r
        return compare(n["op"], a[1], b[1])
    if k == "textCompare":
        a, b = value(n["left"], row), value(n["right"], row)
        for r in (a, b):
            if r[0] != "ok":
                return r
        if a[1][0] != "text" or b[1][0] != "text":
            return "wrong-type", None
        return "ok", (a[1][1] == b[1][1]) == (n["op"] == "equals")
    if k == "memberOf":
        a = value(n["operand"], row)
        if a[0] != "ok":
            return a
        votes = []
        for c in n["candidates"]:
            r = value(c, row)
            if r[0] == "ok":
                r = ("wrong-type", None) if r[1][0] != a[1][0] or r[1][2] != a[1][2] else ("ok", r[1][1] == a[1][1])
            votes.append(r)
        r = kleene(votes, True)
        return ("ok", r[1] == (n["op"] == "in")) if r[0] == "ok" else r
    if k == "exists":
        r = value(n["operand"], row)
        return r if r[0] == "not-yet-known" else ("ok", r[0] != "not-found")
    if k in ("some", "every"):
        votes = []
        for item in row[n["collection"]]:
            f = predicate(n["filter"], item) if n.get("filter") else ("ok", True)
            votes.append(f if f[0] != "ok" else predicate(n["item"], item) if f[1] else ("ok", k == "every"))
        return kleene(votes, k == "some")
    raise AssertionError(k)


def compare(op, a, b):
    if a[0] == "text" or a[0] != b[0] or a[2] != b[2] or a[0] == "boolean" and op not in ("eq", "neq"):
        return "wrong-type", None
    x, y = a[1], b[1]
    return "ok", {"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y, "eq": x == y, "neq": x != y}[op]


def value(n, row, acc=None):
    k = n["kind"]
    if k == "accumulator":
        return acc or ("wrong-type", None)
    if k.endswith("Literal"):
        return ok(k[:-7], n["value"], (n.get("unit") or {}).items())
    if k == "reference":
        v = row.get(n["key"])
        if v is None:
            return ABSENT
        return ok("boolean" if isinstance(v, bool) else "text" if isinstance(v, str) else "number", v)
    if k == "negate":
        r = value(n["operand"], row, acc)
        return r if r[0] != "ok" else ok("number", -r[1][1], r[1][2]) if r[1][0] == "number" else ("wrong-type", None)
    if k == "arithmetic":
        a, b = value(n["left"], row, acc), value(n["right"], row, acc)
        for r in (a, b):
            if r[0] != "ok":
                return r
        return arithmetic(n["op"], a[1], b[1])
    if k == "conditional":
        if n.get("hitPolicy") == "unique":
            guards = [predicate(c["when"], row) for c in n["cases"]]
            hits = [i for i, g in enumerate(guards) if g == ("ok", True)]
            if len(hits) > 1:
                return "domain-error", None
            if any(g[0] != "ok" for g in guards):
                return reasons(guards)
            return value(n["cases"][hits[0]]["then"] if hits else n["fallback"], row, acc)
        for c in n["cases"]:
            g = predicate(c["when"], row)
            if g[0] != "ok":
                return g
            if g[1]:
                return value(c["then"], row, acc)
        return value(n["fallback"], row, acc)
    if k == "fold":
        members = []
        for item in row[n["collection"]]:
            f = predicate(n["filter"], item) if n.get("filter") else ("ok", True)
            if f[0] != "ok":
                return f
            if f[1]:
                members.append(item)
        c = n["combiner"]
        if c["mode"] == "reduce":
            out = value(c["initial"], row)
            for item in members:
                if out[0] != "ok":
                    return out
                out = value(c["combine"], item, out)
            return out
        best = None
        for item in members:
            r = value(c["item"], item)
            if r[0] != "ok":
                return r
            if best is None:
                best = r
                continue
            t = compare("gt" if c["mode"] == "max" else "lt", r[1], best[1])
            if t[0] != "ok":
                return t
            best = r if t[1] else best
        return best or ("domain-error", None)
    raise AssertionError(k)


def arithmetic(op, a, b):
    if a[0] != "number" or b[0] != "number":
        return "wrong-type", None
    x, y, u, w = float(a[1]), float(b[1]), dict(a[2]), dict(b[2])
    unit = u
    try:
        if op in ("add", "subtract"):
            if u != w:
                return "wrong-type", None
            out = x + y if op == "add" else x - y
        elif op in ("multiply", "divide"):
            sign = 1 if op == "multiply" else -1
            unit = {k: e for k in {*u, *w} if (e := u.get(k, 0) + sign * w.get(k, 0))}
            if op == "divide" and y == 0:
                return "domain-error", None
            out = x * y if op == "multiply" else x / y
        elif u or w:
            return "wrong-type", None
        elif op == "modulo":
            if y == 0:
                return "domain-error", None
            out = math.fmod(x, y)
        else:
            if x < 0 and y != int(y) or x == 0 and y < 0:
                return "domain-error", None
            out = x**y
    except OverflowError:
        return "domain-error", None
    return ok("number", out, unit.items()) if math.isfinite(out) else ("domain-error", None)
