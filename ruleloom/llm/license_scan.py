"""License scans: fuzzy search for short notices.

Texts are lower-cased (A-Z) and cut into words; the search runs over the words joined by single spaces, so spans are
words and line breaks or punctuation play no part. A notice with up to k edits is cut into k + 1 exact seeds: by the
pigeonhole principle one of them is unharmed in any place with at most k edits. Every seed hit gives a candidate region, just large
enough for the notice around it, on which the regex library's bounded-error matching confirms the edits and gives the
best span; regions are judged one by one, even where they overlap, so no notice hides its neighbour. License codes and version numbers must stand in a span without edits (a final
"0" may be missing), so a notice of another license or version is no place. Of overlapping spans the one with the fewest edits stays. Base phrases are found exactly, at every place.

Defined results: null and empty texts have no words, labels or places and score 0; repeated rows are scanned each;
long texts are scanned whole. Output columns replace columns of equal name.
"""

from __future__ import annotations

import bisect

import numpy as np
import regex
from pyspark.sql import DataFrame

from ruleloom.llm.common import ALNUM, append_columns, blobs

#: Base phrases: exact words and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Notices that the method searches with errors, and their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("mozilla public license version 2 0", "mpl-2"),
]

#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

#: License codes, which like numbers allow no edits.
CODES = {"mit", "cc", "by", "nc"}

SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, spans array<struct<label: string, start: int, end: int, edits: int, text: string>>"
)


class Notice:
    def __init__(self, text: str, label: str, chars_per_edit: int):
        self.label, self.size = label, len(text)
        self.edits = max(1, len(text) // chars_per_edit)
        cuts = [i * len(text) // (self.edits + 1) for i in range(self.edits + 2)]
        raw = text.encode()
        self.seeds = [(raw[a:b], a) for a, b in zip(cuts, cuts[1:])]
        runs = "".join(f" {w}" if w in CODES or w.isdigit() else "\n" for w in text.split()).split("\n")
        self.fixed = [regex.compile((r[:-2] + r"(?: 0 | (?!\d))" if r.endswith(" 0") else r + " ").encode()) for r in runs if r]
        self.pattern = regex.compile(rb"(?b)(?:" + regex.escape(raw) + rb"){e<=%d}" % self.edits)

    def places(self, text: bytes):
        """(start, end, edits) in bytes, found from seeds and confirmed."""
        begins = set()
        for seed, offset in self.seeds:
            at = text.find(seed)
            while at >= 0:
                begins.add(at - offset)
                at = text.find(seed, at + 1)
        found = set()
        for begin in begins:
            m = self.pattern.search(text, max(0, begin - self.edits), begin + self.size + self.edits)
            if m:
                found.add((m.start(), m.end(), sum(m.fuzzy_counts)))
        return found

    def keeps_codes(self, line: bytes, a: int, b: int) -> bool:
        """Whether the codes and numbers stand unedited among the words of a span."""
        first, last = line.rfind(b" ", 0, a + 1), line.find(b" ", b - 1)
        return all((m := p.search(line, first, last + 2)) and m.start() < last for p in self.fixed)


def apart(hits: list[tuple], begin: int = 2, end: int = 3) -> list[tuple]:
    """Of hits in order of preference those that overlap no earlier one, by their places."""
    begins, ends, out = [], [], []
    for hit in hits:
        a, b = hit[begin], hit[end]
        k = bisect.bisect_left(ends, a + 1)  # the first kept one that ends after a
        if k == len(begins) or b <= begins[k]:
            begins.insert(k, a)
            ends.insert(k, b)
            out.append(hit)
    return sorted(out, key=lambda h: h[begin])


def scan(text: bytes | None, notices: list[Notice], base=BASE):
    words = text.translate(ALNUM).split() if text else []
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    line = b" " + b" ".join(words) + b" "
    starts, labels, score = [], set(), 0.0
    for phrase, label in base:
        key = b" " + phrase.encode() + b" "
        at = line.find(key)
        while at >= 0:
            starts.append(at)
            labels.add(label)
            score = 1.0
            at = line.find(key, at + 1)
    hits = [(e, -(b - a), a, b, n.label, n.size) for n in notices for a, b, e in n.places(line) if n.keeps_codes(line, a, b)]
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) if starts or hits else ()
    word = lambda at: int(np.searchsorted(spaces, at))  # noqa: E731  (words that start at or before a space)
    spans = []
    for e, _, a, b, label, size in apart(sorted(hits)):
        spans.append((label, word(a) - (line[a] != 32), word(b) - 1, e, line[a:b].decode("utf-8", "replace").strip()))
        score = max(score, 1.0 - e / size)
    every = sorted(labels | {s[0] for s in spans})
    return (
        len(words), len(starts), word(min(starts)) if starts else None, word(max(starts)) if starts else None,
        ",".join(sorted(labels)), ",".join(every), score, spans,
    )


def scan_licenses(df: DataFrame, text: str = "text", notices=NOTICES, base=BASE, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Append word count, base places, labels, score and the confirmed spans (word positions from 0, both ends included)."""
    names = [c.split()[0] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")]

    def make():
        compiled = [Notice(t, label, chars_per_edit) for t, label in notices]

        def work(batch):
            rows = [scan(t, compiled, base) for t in blobs(batch, text)]
            out = dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}
            out["spans"] = [[dict(zip(("label", "start", "end", "edits", "text"), s)) for s in row] for row in out["spans"]]
            return out

        return work

    return append_columns(df, SCHEMA, make)
