"""License scan: fuzzy search for short notices.

A notice with at most ``k`` edits is cut into ``k + 1`` pieces; by the pigeonhole principle every match holds at
least one piece unchanged.  All pieces of all notices are looked up at once with an Aho-Corasick automaton; each
hit gives a window in which a match must lie.  Windows of a notice that begin within its edits of each other are one,
so a window is less than two notices long, however many there are.  In each window the ``regex`` library's
bounded-error matching verifies the edits (insertions, deletions, substitutions) and gives the span with the fewest,
digits unchanged; a bit-parallel edit distance rules out windows without one before.  The best spans are taken first and cut out of the other windows, so the spans of a notice never
overlap, and the work grows with the hits.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifier and text of each notice.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved"),
)
#: Allowed edits: this share of a notice's length, rounded down, but at least one.
EDIT_RATE = 0.08


def fold(text: str) -> str:
    """Lower case, character by character, so that places don't move."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def allowed(notice: str, rate: float = EDIT_RATE) -> int:
    return max(1, int(len(notice) * rate))


def least_edits(masks: dict[str, int], size: int, text: str) -> int:
    """Fewest edits between a notice of ``size`` characters and any run of ``text`` (Myers' bit-parallel columns).

    ``masks`` has the places of each character in the notice.
    """
    top, every = 1 << size - 1, (1 << size) - 1
    plus, minus, score, best = every, 0, size, size
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & every, plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & every, down << 1 & every
        plus, minus = down | ~(xv | up) & every, up & xv
        if score < best:
            best = score
    return best


def best_spans(find, windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint ``start, end, edits`` within the windows: the best match of all first, the leftmost of equals.

    ``find(a, b)`` gives the best match between two places, or None.
    """
    found: list[tuple[int, int, int, int, int]] = []

    def search(a: int, b: int) -> None:
        m = find(a, b) if a < b else None
        if m:
            heapq.heappush(found, (*m, a, b))

    for a, b in windows:
        search(a, b)
    out: list[tuple[int, int, int]] = []  # by start
    while found:
        edits, start, end, a, b = heapq.heappop(found)
        at = bisect_right(out, (start, end, edits))
        near = [s for s in out[max(0, at - 1) : at + 1] if s[0] < end and start < s[1]]
        if not near:
            out.insert(at, (start, end, edits))
            continue
        # what is taken is longer than what a window holds besides a match, so few pieces are searched again
        free = a
        for s in near:
            search(free, min(b, s[0]))
            free = max(free, s[1])
        search(free, b)
    return out


def resolve(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping spans ``notice, start, end, edits`` those with the fewest edits stay, then the longest, the first.

    A span within a longer one goes before that, however few its edits: it is part of the other's notice.
    """
    # within a longer one: of those that begin no later, some ends no earlier
    outer, reach = [], (-1, -1)  # furthest end, and the start it has
    for s in sorted(spans, key=lambda r: (r[1], -r[2], r[3], r[0])):
        if s[2] > reach[0] or (s[1], s[2]) == (reach[1], reach[0]):
            outer.append(s)
            reach = max(reach, (s[2], s[1])) if s[2] > reach[0] else reach
    kept: list[tuple[int, int, int, int]] = []  # by start, disjoint
    for span in sorted(outer, key=lambda r: (r[3], r[1] - r[2], r[1], r[0])):
        at = bisect_right(kept, span[1], key=lambda k: k[1])
        if not any(k[1] < span[2] and span[1] < k[2] for k in kept[max(0, at - 1) : at + 1]):
            kept.insert(at, span)
    return kept


def compile_notice(notice: str, edits: int):
    import regex

    # digits are met exactly, and a version at the end isn't cut off; the sum of edits of all parts is checked after
    parts = [p if p.isdigit() else f"(?:{regex.escape(p)}){{e<={edits}:[^0-9]}}" for p in re.split(r"([0-9])", fold(notice)) if p]
    return regex.compile("(?be)" + "".join(parts) + ("(?![0-9])" if notice[-1].isdigit() else ""))


class Scanner:
    def __init__(self, notices: Iterable[tuple[str, str]] = NOTICES, rate: float = EDIT_RATE) -> None:
        import ahocorasick

        self.notices = [(name, text, allowed(text, rate)) for name, text in notices]
        self.patterns = [compile_notice(text, k) for _, text, k in self.notices]
        self.masks: list[dict[str, int]] = []
        for _, text, _ in self.notices:
            masks: dict[str, int] = defaultdict(int)
            for j, c in enumerate(fold(text)):
                masks[c] |= 1 << j
            self.masks.append(dict(masks))
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text, k) in enumerate(self.notices):
            cuts = [round(j * len(text) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    raise ValueError(f"too many edits for the notice {text!r}")
                pieces[fold(text)[a:b]].append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        """``notice number, start, end, edits`` of the spans of ``text``, in order of place."""
        low = fold(text)
        begins: dict[int, set[int]] = defaultdict(set)
        for last, (size, uses) in self.automaton.iter(low):
            for i, offset in uses:
                begins[i].add(last + 1 - size - offset)
        out = []
        for i, own in begins.items():
            _, notice, k = self.notices[i]
            windows: list[tuple[int, int]] = []
            first = None
            for at in sorted(own):
                if first is None or at > first + k:
                    first = at
                    windows.append((max(0, at - k), 0))
                windows[-1] = (windows[-1][0], min(len(low), at + len(notice) + k))
            out += [(i, *span) for span in best_spans(self._finder(i, low), windows)]
        return resolve(out)

    def _finder(self, i: int, low: str):
        """The best match of a notice between two places of a text: edits, start, end.  A text repeated is searched once."""
        _, notice, k = self.notices[i]
        pattern, masks, seen = self.patterns[i], self.masks[i], {}

        def find(a: int, b: int) -> tuple[int, int, int] | None:
            part = low[a:b]
            if part not in seen:
                # the distance tells at once where no run comes near, which the expression would try at length
                m = pattern.search(part) if least_edits(masks, len(notice), part) <= k else None
                seen[part] = (sum(m.fuzzy_counts), m.start(), m.end()) if m and sum(m.fuzzy_counts) <= k else None
            m = seen[part]
            return m and (m[0], a + m[1], a + m[2])

        return find


SCHEMA = "doc_id bigint, license string, notice string, start_char int, end_char int, edits int, matched string"


def scan_licenses(docs: DataFrame, notices: Iterable[tuple[str, str]] = NOTICES, rate: float = EDIT_RATE) -> DataFrame:
    """``doc_id, license, notice, start_char, end_char, edits, matched``: one row for each span in each document.

    Case is ignored; places count characters from 0.  Of overlapping spans
    of different notices only the best stays (:func:`resolve`).  Null and empty texts have no rows, repeated documents have their rows each, a
    null id is kept, other columns are ignored, whatever their names, and an empty table has no rows.  Texts are searched
    whole, of any length and however many notices they nearly hold; nothing is shuffled.
    """
    wanted = tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted, rate)
        for batch in batches:
            out: list[tuple] = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc_id, text in zip(ids, texts):
                text = text.as_py()
                if text:
                    out += [(doc_id, scanner.notices[i][0], scanner.notices[i][1], a, b, k, text[a:b]) for i, a, b, k in scanner.scan(text)]
            columns = list(zip(*out)) if out else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
