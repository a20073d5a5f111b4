"""Lines and tables of one page in plain Python.

The rules are those of quire.operators.layout and quire.operators.tables, which
state them as column expressions; this form serves pages with so many runs that
a fold over an array would be quadratic.  Tests hold the two against each other.
"""

from __future__ import annotations

#: Characters that keep to their neighbour on the right, on the left.
TIGHT_END = "([{<|｜=+-*/×÷≤≥≠≈∈∉⊂⊃⊆⊇∩∪∅∂∫∑∏√"
TIGHT_START = ")]}>|｜,.;:!?≤≥∈∉"
EPS = 2.0


def lines(runs: list[tuple]) -> list[tuple[str, float, float]]:
    """(text, x, y) of each line; runs: (text, x, y, width, size, ...) in order of emission."""
    if not runs:
        return []
    ordered = sorted(runs, key=order)
    text, left, top, width, height = ordered[0][:5]
    out, end = [], left + width
    for r in ordered[1:]:
        t, x, y, width, size = r[:5]
        drop, back = abs(top - y), end - x
        low, em = (height, size) if height < size else (size, height)
        if drop > 0.4 * low and drop > 1.0 or back > 1.2 * em and (back > 2.0 * em or drop > 0.1):
            out.append((text, left, top))
            text, left, top, height = t, x, y, size
        else:
            gap = -back
            if gap > 0 and t[:1] != " " and text[-1:] != " ":
                em = size if size > 1.0 else 1.0
                # without a character on either side nothing is tight
                tight = text and text[-1] in TIGHT_END or t and t[0] in TIGHT_START
                if gap > (0.5 if tight else 0.3) * em:
                    text += " "
            text += t
        end = x + width
    out.append((text, left, top))
    return out


def order(r: tuple) -> tuple:
    return -r[2], r[1]


def cluster(values: list[float]) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or abs(v - out[-1]) >= EPS:
            out.append(v)
    return out


def table(segments: list[tuple], runs: list[tuple]) -> tuple[list[list[str]] | None, list[tuple]]:
    """The cells of the page's valid table, if any, and the runs outside it."""
    xs = cluster([p for axis, p in segments if axis == "x"])
    ys = cluster([p for axis, p in segments if axis == "y"])[::-1]
    if len(xs) < 2 or len(ys) < 2:
        return None, runs
    cells, outside = [[""] * (len(xs) - 1) for _ in ys[1:]], []
    for r in runs:
        col = next((j for j in range(len(xs) - 1) if xs[j] - EPS <= r[1] < xs[j + 1] + EPS), None)
        row = next((i for i in range(len(ys) - 1) if ys[i] + EPS >= r[2] > ys[i + 1] - EPS), None)
        if col is None or row is None:
            outside.append(r)
            continue
        old = cells[row][col]
        cells[row][col] = old + (" " if old and not old.endswith(" ") else "") + r[0]
    filled = [c.strip() for line in cells for c in line if c.strip()]
    total = len(cells) * len(cells[0])
    if not filled or len(filled) / total < 0.3:
        return None, runs
    least = 3.0 if len(cells) >= 5 and len(cells[0]) >= 3 else 1.0 if total <= 4 else 2.0
    if sum(map(len, filled)) / len(filled) < least:
        return None, runs
    return cells, outside
