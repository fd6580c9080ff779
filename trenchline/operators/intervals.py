"""Claims on a line, kept in order for quick questions about overlap."""

from __future__ import annotations

from collections.abc import Iterator
from math import frexp

import numpy as np


class Row:
    """Ranges sorted by start, in arrays that grow; inserting moves what lies behind."""

    def __init__(self) -> None:
        self.n, self.start, self.end = 0, np.empty(16), np.empty(16)

    def insert(self, at: int, start: float, end: float, instead_of: int = 0) -> None:
        """Put a range at a place, in place of as many that stand there."""
        grown = self.n + 1 - instead_of
        for name, value in (("start", start), ("end", end)):
            a = getattr(self, name)
            if grown > len(a):
                a = np.concatenate([a, np.empty(len(a))])
                setattr(self, name, a)
            a[at + 1:grown] = a[at + instead_of:self.n].copy()
            a[at] = value
        self.n = grown

    def starts(self) -> np.ndarray:
        return self.start[:self.n]

    def ends(self) -> np.ndarray:
        return self.end[:self.n]


class Claims:
    """Accepted claims of one route.

    Ranges within another one never have the greatest overlap with anything, so that question
    is asked of the outermost ranges alone: both their starts and their ends rise, and those
    that meet a window stand side by side.  For questions about every claim, all are kept in
    rows of similar length (within a factor of two), so those that meet a window lie between
    two places of each row, with few others.
    """

    def __init__(self) -> None:
        self.outer = Row()
        self.by_length: dict[int, Row] = {}
        #: The route's chainage and windows, kept for the groups that come later.
        self.lines: dict = {}

    def add(self, start: float, end: float) -> None:
        row = self.by_length.setdefault(frexp(max(end - start, 0.0))[1], Row())
        row.insert(int(np.searchsorted(row.starts(), start)), start, end)
        starts, ends = self.outer.starts(), self.outer.ends()
        at = int(np.searchsorted(starts, start))
        # within the one before (which starts earlier) or one that starts here
        if (at and ends[at - 1] >= end) or (at < len(starts) and starts[at] == start and ends[at] >= end):
            return
        within = int(np.searchsorted(ends, end, side="right")) - at
        self.outer.insert(at, start, end, max(0, within))

    def overlaps(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Greatest overlap of each window with any one claim."""
        starts, ends = self.outer.starts(), self.outer.ends()
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(starts, end, side="left")
        out = np.zeros(len(start))
        live = np.flatnonzero(first < last)
        at = first[live]
        while len(live):
            out[live] = np.maximum(out[live], np.minimum(end[live], ends[at]) - np.maximum(start[live], starts[at]))
            at = at + 1
            on = at < last[live]
            live, at = live[on], at[on]
        return out

    def meeting(self, start: float, end: float) -> Iterator[tuple[float, float]]:
        """Every claim that shares more than a point with the window."""
        for length, row in self.by_length.items():
            starts, ends = row.starts(), row.ends()
            low, high = np.searchsorted(starts, start - 2.0 ** length, side="left"), np.searchsorted(starts, end, side="left")
            for i in range(low, high):
                if ends[i] > start:
                    yield float(starts[i]), float(ends[i])

    def duplicate(self, start: float, end: float) -> tuple[bool, bool]:
        """(any material conflict, any true duplicate) of a window with the claims."""
        material = true = False
        mine = max(1.0, abs(end - start))
        for s, e in self.meeting(start, end):
            over, its = min(end, e) - max(start, s), max(1.0, abs(e - s))
            least, similar = min(mine, its), min(mine, its) / max(mine, its)
            tolerance = min(30.0, max(5.0, least * 0.06))
            near = abs((start + end) / 2 - (s + e) / 2) <= max(25.0, least * 0.10)
            if over > tolerance and (over / least >= 0.12 or near):
                material = True
                true = true or near or (over / least >= 0.5 and similar >= 0.7) or over >= max(80.0, tolerance * 3.0)
        return material, true
