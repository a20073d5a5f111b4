"""Ruled tables: segments and runs to a grid of cells, as column expressions.

All rules of a page share one grid.  A run belongs to the first column and row
whose tolerance holds its origin; a cell joins its runs in order of emission; a
grid with too few or too short cells is decoration and not a table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.kernel.layout import EPS


def cluster(segments, axis: str):
    """Ascending positions of one axis; within EPS of the last kept one they are one."""
    values = F.array_sort(F.transform(F.filter(segments, lambda s: s["axis"] == axis), lambda s: s["pos"]))
    none = F.array().cast("array<double>")
    return F.aggregate(values, none, lambda kept, v: F.when((F.size(kept) == 0) | (v - F.element_at(kept, -1) >= EPS), F.concat(kept, F.array(v))).otherwise(kept))


def _first(n, holds):
    """The least k below n for which holds(k), else null."""
    return F.get(F.filter(F.sequence(F.lit(0), n - 1), holds), F.lit(0))


def column_of(xs, x):
    return _first(F.size(xs) - 1, lambda j: (x >= F.get(xs, j) - EPS) & (x < F.get(xs, j + 1) + EPS))


def row_of(ys, y):
    """ys descending."""
    return _first(F.size(ys) - 1, lambda i: (y <= F.get(ys, i) + EPS) & (y > F.get(ys, i + 1) - EPS))


def add_grid(pages):
    """Add xs (ascending) and ys (descending), null where they make no grid."""
    both = pages.withColumn("xs", cluster(F.col("segments"), "x")).withColumn("ys", F.reverse(cluster(F.col("segments"), "y")))
    grid = (F.size("xs") >= 2) & (F.size("ys") >= 2)
    return both.withColumn("xs", F.when(grid, F.col("xs"))).withColumn("ys", F.when(F.col("xs").isNotNull(), F.col("ys")))


def place_runs(pages):
    """Add placed: runs with the row and column that hold them, null outside the grid."""
    placed = F.transform("runs", lambda r: F.struct(row_of(F.col("ys"), r["y"]).alias("row"), column_of(F.col("xs"), r["x"]).alias("col"), r.alias("run")))
    return pages.withColumn("placed", F.when(F.col("xs").isNotNull(), placed))


def fill_cells(pages):
    """Add cells: array<array<string>>, top row first."""
    n_rows, n_cols = F.size("ys") - 1, F.size("xs") - 1

    def cell(i, j):
        mine = F.filter("placed", lambda p: (p["row"] == i) & (p["col"] == j))
        return F.aggregate(mine, F.lit(""), lambda t, p: F.concat(t, F.when((t != "") & ~t.endswith(" "), " ").otherwise(""), p["run"]["text"]))

    cells = F.transform(F.sequence(F.lit(0), n_rows - 1), lambda i: F.transform(F.sequence(F.lit(0), n_cols - 1), lambda j: cell(i, j)))
    return pages.withColumn("cells", F.when(F.col("xs").isNotNull(), cells))


def trimmed(c):
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def add_table(pages):
    """Add table (struct or null) and outside: the runs that are not in it."""
    filled = pages.withColumn("full", F.filter(F.transform(F.flatten("cells"), trimmed), lambda c: c != ""))
    rows, cols = F.size("cells"), F.size(F.get("cells", F.lit(0)))
    total, n = (rows * cols).cast("double"), F.size("full")
    mean = F.aggregate("full", F.lit(0), lambda a, c: a + F.char_length(c)) / n
    least = F.when((rows >= 5) & (cols >= 3), 3.0).when(total <= 4, 1.0).otherwise(2.0)
    valid = F.col("cells").isNotNull() & (n > 0) & (n / total >= 0.3) & (mean >= least)
    table = F.struct(rows.alias("rows"), cols.alias("cols"), F.col("cells").alias("cells"))
    out = filled.withColumn("table", F.when(valid, table))
    kept = F.transform(F.filter("placed", lambda p: p["row"].isNull() | p["col"].isNull()), lambda p: p["run"])
    return out.withColumn("outside", F.when(F.col("table").isNotNull(), kept).otherwise(F.col("runs")))
