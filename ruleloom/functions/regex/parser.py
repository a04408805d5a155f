"""The grammar, over UTF-16 code units.

    alternation  a|b          concatenation  ab         group  (?:a)
    quantifiers  * + ? {n} {n,} {n,m}   (one each; a brace that isn't one of these is a literal)
    any unit     .            anchors  ^ $  (absolute; not quantifiable)
    classes      [a-z] [^a-z], with \\d \\D \\w \\W \\s \\S inside and out; ASCII only
    escapes      \\n \\r \\t \\f \\v \\0, \\xhh, \\uhhhh, and any punctuation

Captures, back-references, look-around, lazy or possessive quantifiers and flags are refused. A node is a tuple:
("lit", unit) ("any",) ("set", ranges, negated) ("start",) ("end",) ("cat", nodes) ("alt", nodes) ("rep", node, least, most).
"""

from __future__ import annotations

from functools import lru_cache

MAX_PATTERN, MAX_NESTING = 400_000, 128

#: Inclusive ranges of the shorthand classes (fixed values).
DIGIT = ((48, 57),)
WORD = ((48, 57), (65, 90), (95, 95), (97, 122))
SPACE = ((9, 13), (32, 32))
#: White space and line terminators of the wider dialect (fixed values).
WIDE_SPACE = ((9, 13), (32, 32), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233), (8239, 8239), (8287, 8287), (12288, 12288), (65279, 65279))
LINE_ENDS = ((10, 10), (13, 13), (8232, 8233))
CONTROL = {"n": 10, "r": 13, "t": 9, "f": 12, "v": 11, "0": 0}


class PatternError(ValueError):
    def __init__(self, index: int, reason: str):
        super().__init__(f"{reason} at index {index}")
        self.index, self.reason = index, reason


def units(text: str) -> list[int]:
    raw = text.encode("utf-16-le", "surrogatepass")
    return [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]


def inverse(ranges) -> tuple:
    out, at = [], 0
    for a, b in sorted(ranges):
        if a > at:
            out.append((at, a - 1))
        at = max(at, b + 1)
    return tuple(out + ([(at, 0xFFFF)] if at <= 0xFFFF else []))


def shorthand(letter: str, wide: bool = False) -> tuple:
    ranges = {"d": DIGIT, "w": WORD, "s": WIDE_SPACE if wide else SPACE}[letter.lower()]
    return inverse(ranges) if letter.isupper() else ranges


def range_contains(span, unit: int) -> bool:
    return span[0] <= unit <= span[1]


def char_class_matches(node, unit: int) -> bool:
    return any(a <= unit <= b for a, b in node[1]) != node[2]


class _Parser:
    def __init__(self, pattern: str, wide: bool):
        self.s, self.i, self.wide, self.depth = units(pattern), 0, wide, 0
        if len(self.s) > MAX_PATTERN:
            raise PatternError(MAX_PATTERN, "the pattern is too long")

    def peek(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return chr(self.s[k]) if k < len(self.s) else ""

    def fail(self, reason: str, at: int | None = None):
        raise PatternError(self.i if at is None else at, reason)

    def alternation(self):
        options = [self.concatenation()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.concatenation())
        return options[0] if len(options) == 1 else ("alt", tuple(options))

    def concatenation(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.quantified())
        return parts[0] if len(parts) == 1 else ("cat", tuple(parts))

    def quantified(self):
        start = self.i
        atom = self.atom()
        found = self.quantifier()
        if found is None:
            return atom
        if atom[0] in ("start", "end"):
            self.fail("an anchor can't be quantified", start)
        if self.peek() == "?":
            self.fail("lazy quantifiers aren't supported")
        if self.peek() == "+":
            self.fail("possessive quantifiers aren't supported" if not self.wide else "nothing to repeat")
        if self.quantifier() is not None:
            self.fail("a quantifier can't follow a quantifier", self.i - 1)
        return ("rep", atom, *found)

    def quantifier(self):
        c = self.peek()
        if c and c in "*+?":
            self.i += 1
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        if c != "{":
            return None
        k = self.i + 1
        digits = ["", ""]
        which = 0
        while k < len(self.s) and chr(self.s[k]) in "0123456789,":
            if chr(self.s[k]) == ",":
                which += 1
                if which > 1:
                    return None
            else:
                digits[which] += chr(self.s[k])
            k += 1
        if k >= len(self.s) or chr(self.s[k]) != "}" or not digits[0]:
            return None
        least = int(digits[0])
        most = least if which == 0 else int(digits[1]) if digits[1] else None
        if most is not None and most < least:
            self.fail("the numbers of a quantifier are out of order")
        self.i = k + 1
        return least, most

    def atom(self):
        c = self.peek()
        self.i += 1
        if c == "(":
            if self.peek() != "?":
                self.fail("capturing groups aren't supported; use (?:...)", self.i - 1)
            if self.peek(1) != ":":
                self.fail("look-around, named groups and flags aren't supported", self.i - 1)
            self.i += 2
            self.depth += 1
            if self.depth > MAX_NESTING:
                self.fail("groups are nested too deeply")
            inner = self.alternation()
            if self.peek() != ")":
                self.fail("a group isn't closed")
            self.i += 1
            self.depth -= 1
            return inner if inner[0] not in ("start", "end") else ("cat", (inner,))
        if c == "[":
            return self.char_class()
        if c == ".":
            return ("set", LINE_ENDS, True) if self.wide else ("any",)
        if c == "^":
            return ("start",)
        if c == "$":
            return ("end",)
        if c == "\\":
            return self.escape()
        if c in "*+?":
            self.fail("there is nothing to repeat", self.i - 1)
        return ("lit", ord(c))

    def escape(self, inside: bool = False):
        c = self.peek()
        if not c:
            self.fail("a backslash ends the pattern", self.i - 1)
        self.i += 1
        if c in "dDwWsS":
            return ("set", shorthand(c, self.wide), False)
        if c in CONTROL:
            if c == "0" and self.peek().isdigit():
                self.fail("octal escapes aren't supported", self.i - 1)
            return ("lit", CONTROL[c])
        if c in "xu":
            size = 2 if c == "x" else 4
            text = "".join(map(chr, self.s[self.i : self.i + size]))
            if len(text) == size and all(x in "0123456789abcdefABCDEF" for x in text):
                self.i += size
                return ("lit", int(text, 16))
            self.fail("a hexadecimal escape is incomplete", self.i - 1)
        if c == "b" and inside:
            return ("lit", 8)
        if c.isalnum() and ord(c) < 128:
            self.fail("back-references aren't supported" if c.isdigit() else f"the escape '\\{c}' isn't supported", self.i - 1)
        return ("lit", ord(c))

    def char_class(self):
        start = self.i - 1
        negated = self.peek() == "^"
        self.i += negated
        ranges: list = []
        while True:
            c = self.peek()
            if not c:
                self.fail("a character class isn't closed", start)
            if c == "]":
                self.i += 1
                return ("set", tuple(ranges), negated)
            low = self.class_atom()
            if self.peek() == "-" and self.peek(1) not in ("]", ""):
                at = self.i
                self.i += 1
                high = self.class_atom()
                if low[0] != "lit" or high[0] != "lit":
                    self.fail("a range needs single characters at both ends", at)
                if high[1] < low[1]:
                    self.fail("a range is out of order", at)
                ranges.append((low[1], high[1]))
            elif low[0] == "lit":
                ranges.append((low[1], low[1]))
            else:
                ranges.extend(low[1])

    def class_atom(self):
        c = self.peek()
        self.i += 1
        return self.escape(True) if c == "\\" else ("lit", ord(c))


@lru_cache(4096)
def _parsed(pattern: str, wide: bool):
    p = _Parser(pattern, wide)
    tree = p.alternation()
    if p.i < len(p.s):
        p.fail("a closing parenthesis has no partner")
    return tree


def parse(pattern: str):
    return _parsed(pattern, False)


def parse_ecma(pattern: str):
    """The subset of flag-less ECMAScript patterns that this grammar covers, with that dialect's `.` and `\\s`."""
    return _parsed(pattern, True)
