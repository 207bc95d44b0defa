"""Structure-aware chunks: offsets into a text, cut where headings, rules, blank lines or line ends allow."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in characters: wanted length, overlap with the chunk before, how far back a cut is looked for.
TARGET, OVERLAP, WINDOW = 1800, 270, 600
#: How far a cut's worth falls off at the far end of the window.
DECAY = 0.7
#: Worth of a cut before each kind of structure.
BREAKS = {
    r"^# .+$": 100,
    r"^## .+$": 90,
    r"^### .+$": 80,
    r"^#{4,6} .+$": 65,
    r"^(?:---|\*\*\*)\s*$": 60,
    r"\n\s*\n": 20,
    r"\n": 1,
}
FENCE = r"^(?:```|~~~)"
SCHEMA = "array<struct<seq:int,pos:int,length:int>>"

_breaks = [(re.compile(p, re.M), worth) for p, worth in BREAKS.items()]
_fence = re.compile(FENCE, re.M)


class _Outline:
    """Where a text may be cut: places in order with their worth, none inside a fence. Fences pair up; an odd last one is ignored."""

    def __init__(self, text: str):
        marks = [m.start() for m in _fence.finditer(text)]
        self.opens, self.closes = marks[0::2][: len(marks) // 2], marks[1::2]
        worth: dict[int, int] = {}
        for pattern, value in _breaks:
            for m in pattern.finditer(text):
                if value > worth.get(m.start(), 0) and not self.fenced(m.start()):
                    worth[m.start()] = value
        self.places = sorted(worth)
        self.worth = [worth[p] for p in self.places]

    def fenced(self, at: int) -> bool:
        """After a fence's start, up to and with the place where its end mark starts."""
        k = bisect_left(self.opens, at) - 1
        return k >= 0 and at <= self.closes[k]

    def cut(self, low: int, end: int, window: int, size: int) -> int:
        """The best place in [low, end], the first one of equals; else the next place after end; else the text's end."""
        i, j = bisect_left(self.places, low), bisect_right(self.places, end)
        if i < j:
            value = lambda k: self.worth[k] * (1 - ((end - self.places[k]) / window) ** 2 * DECAY)
            return self.places[max(range(i, j), key=value)]
        return self.places[j] if j < len(self.places) else size


def chunk(text: str | None, target: int = TARGET, overlap: int = OVERLAP, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(seq, pos, length) of a text's chunks, in code points. Blank and null texts have none, short ones have one."""
    if not (text or "").strip():
        return []
    size, outline = len(text), None if len(text) <= target else _Outline(text)

    def stop(at: int) -> int:
        """Where a chunk from `at` ends: at the text's end if that is in reach, else at the best break of the window before the target."""
        reach = at + target
        if reach >= size:
            return size
        best = outline.cut(max(at + overlap + 1, reach - window), reach, window, size)
        return best if best > at else reach

    def resume(at: int, end: int) -> int:
        """Where the next chunk begins: `overlap` before the end of the last, but not inside a fence."""
        back = max(end - overlap, at + 1)
        return end if outline.fenced(back) else back

    bounds = [(0, stop(0))]
    while bounds[-1][1] < size:
        at = resume(*bounds[-1])
        bounds.append((at, stop(at)))
    return [(seq, at, end - at) for seq, (at, end) in enumerate(bounds)]


def chunks(text: Column, target: int = TARGET, overlap: int = OVERLAP, window: int = WINDOW) -> Column:
    """array<struct<seq,pos,length>> of a text column; rows travel to Python in Arrow batches."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"seq": s, "pos": p, "length": n} for s, p, n in chunk(t, target, overlap, window)])

    return run(text)
