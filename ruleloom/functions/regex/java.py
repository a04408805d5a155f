"""Java pattern text of a parsed pattern, and cheaper forms where a pattern is a plain literal with anchors."""

from __future__ import annotations


def _unit(u: int) -> str:
    return f"\\x{{{u:x}}}" if u < 33 or u > 126 or not chr(u).isalnum() else chr(u)


def _set(ranges, negated: bool) -> str:
    if not ranges:
        return "(?s:.)" if negated else "(?!)"
    return "[" + "^" * negated + "".join(_unit(a) if a == b else f"{_unit(a)}-{_unit(b)}" for a, b in ranges) + "]"


def render(node) -> str:
    kind = node[0]
    if kind == "lit":
        return _unit(node[1])
    if kind == "any":
        return "(?s:.)"
    if kind == "set":
        return _set(node[1], node[2])
    if kind == "start":
        return "\\A"
    if kind == "end":
        return "\\z"
    if kind == "cat":
        return "".join(f"(?:{render(p)})" if p[0] == "alt" else render(p) for p in _joined(node[1]))
    if kind == "alt":
        return "|".join(map(render, node[1]))
    _, inner, least, most = node
    mark = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((least, most)) or "{%d%s}" % (least, "" if most == least else f",{'' if most is None else most}")
    return f"(?:{render(inner)}){mark}"


def _joined(parts):
    """Literal surrogate pairs become one character, which is what Java matches."""
    out = []
    for p in parts:
        if p[0] == "lit" and 0xDC00 <= p[1] < 0xE000 and out and out[-1][0] == "lit" and 0xD800 <= out[-1][1] < 0xDC00:
            out[-1] = ("lit", 0x10000 + ((out[-1][1] - 0xD800) << 10) + p[1] - 0xDC00)
        else:
            out.append(p)
    return out


def fast_form(node):
    """("equals" | "startswith" | "endswith" | "contains", text) for anchored literals; None otherwise."""
    parts = list(node[1]) if node[0] == "cat" else [node]
    start = bool(parts) and parts[0][0] == "start"
    end = bool(parts) and parts[-1][0] == "end" and len(parts) > start
    body = parts[start : len(parts) - end]
    anything = ("rep", ("any",), 0, None)
    both = ("rep", ("set", tuple(_everything(body)), False), 0, None)
    if end and body and body[-1] in (anything, both):
        body, end = body[:-1], False
    if start and body and body[0] in (anything, both):
        body, start = body[1:], False
    if any(p[0] != "lit" for p in body):
        return None
    raw = b"".join(p[1].to_bytes(2, "little") for p in body)
    try:
        text = raw.decode("utf-16-le")
    except UnicodeDecodeError:
        return None
    return ({(True, True): "equals", (True, False): "startswith", (False, True): "endswith", (False, False): "contains"}[start, end], text)


def _everything(parts):
    """The ranges of the first class among the parts that covers every unit, as in [\\s\\S]."""
    for p in parts:
        if p[0] == "rep" and p[1][0] == "set" and not p[1][2]:
            at = 0
            for a, b in sorted(p[1][1]):
                if a > at:
                    break
                at = max(at, b + 1)
            if at > 0xFFFF:
                return p[1][1]
    return ()


def may_explode(node, inside: bool = False) -> bool:
    """Whether a backtracking matcher could need more than polynomial time: an unbounded repetition in a repetition."""
    if node[0] == "rep":
        many = node[3] is None or node[3] > 1
        if inside and many and (node[3] is None or node[3] != node[2]):
            return True
        return may_explode(node[1], inside or many)
    return any(may_explode(p, inside) for p in node[1]) if node[0] in ("cat", "alt") else False


def splits_astral(node) -> bool:
    """Whether a pattern tells UTF-16 units from characters: anything but literals may."""
    if node[0] in ("cat", "alt"):
        return any(map(splits_astral, node[1]))
    return node[0] in ("any", "set") or node[0] == "rep" and splits_astral(node[1])
