"""A matcher whose work is bounded by states times input: sets of states, no backtracking. Search semantics."""

from __future__ import annotations

from ruleloom.functions.regex.parser import parse, units

MAX_STATES, MAX_INPUT, MAX_WORK = 100_000, 1_000_000, 100_000_000


class InputTooLarge(ValueError):
    pass


class Automaton:
    """Instructions: ("set", ranges, negated, next), ("split", a, b), ("at", "start" or "end", next), ("done",)."""

    def __init__(self, tree):
        self.code: list[list] = []
        self.start = self._build(tree, self._add(["done"]))

    def _add(self, instruction) -> int:
        if len(self.code) >= MAX_STATES:
            raise InputTooLarge("the pattern needs too many states")
        self.code.append(instruction)
        return len(self.code) - 1

    def _build(self, node, then: int) -> int:
        kind = node[0]
        if kind == "lit":
            return self._add(["set", ((node[1], node[1]),), False, then])
        if kind == "any":
            return self._add(["set", (), True, then])
        if kind == "set":
            return self._add(["set", node[1], node[2], then])
        if kind in ("start", "end"):
            return self._add(["at", kind, then])
        if kind == "cat":
            for part in reversed(node[1]):
                then = self._build(part, then)
            return then
        if kind == "alt":
            out = self._build(node[1][-1], then)
            for part in reversed(node[1][:-1]):
                out = self._add(["split", self._build(part, then), out])
            return out
        _, inner, least, most = node
        if most is None:
            loop = self._add(["split", 0, then])
            self.code[loop][1] = self._build(inner, loop)
            then = loop
        else:
            end = then
            for _ in range(most - least):
                then = self._add(["split", self._build(inner, then), end])
        for _ in range(least):
            then = self._build(inner, then)
        return then

    def test(self, text: str) -> bool:
        s = units(text)
        n, code = len(s), self.code
        if n > MAX_INPUT or len(code) * (n + 1) > MAX_WORK:
            raise InputTooLarge("the text is too long for this pattern")
        now: set[int] = set()
        for i in range(n + 1):
            now.add(self.start)
            todo, seen, sets = list(now), set(now), []
            while todo:
                op = code[todo.pop()]
                if op[0] == "done":
                    return True
                if op[0] == "set":
                    sets.append(op)
                    continue
                follow = (op[1], op[2]) if op[0] == "split" else (op[2],) if (i == 0 if op[1] == "start" else i == n) else ()
                for k in follow:
                    if k not in seen:
                        seen.add(k)
                        todo.append(k)
            if i < n:
                u = s[i]
                now = {op[3] for op in sets if any(a <= u <= b for a, b in op[1]) != op[2]}
        return False


def compile_pattern(pattern: str) -> Automaton:
    return Automaton(parse(pattern))


def test_pattern(pattern: str, text: str) -> bool:
    return compile_pattern(pattern).test(text)


test_pattern.__test__ = False
