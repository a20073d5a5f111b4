"""Runs to reading-order lines, as column expressions over a page row.

Runs are ordered top to bottom and left to right, then folded once: a run joins
the current line or starts the next, judged against the line's first run and the
end of its last.  Nothing is shuffled: a page's runs are one array.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.kernel.layout import TIGHT_END, TIGHT_START
from quire.sources.pdf import LINE


def ordered(runs):
    """Runs by y descending, x ascending, then order of emission."""
    keyed = F.transform(runs, lambda r: F.struct((-r["y"]).alias("ny"), r["x"].alias("x"), r["run_no"].alias("no"), r["text"].alias("t"), r["width"].alias("w"), r["font_size"].alias("fs")))
    return F.array_sort(keyed)


def _line(s):
    return F.struct(s["t"].alias("text"), s["x"].alias("x"), s["y"].alias("y"))


def fold_lines(runs):
    """array<struct<text, x, y>> of the lines of an array of runs."""
    start = F.struct(
        F.array().cast(f"array<{LINE}>").alias("done"),
        F.lit(None).cast("string").alias("t"),
        *[F.lit(0.0).alias(c) for c in ("x", "y", "fs", "end")],
    )

    def step(s, r):
        y = -r["ny"]
        drop, em, back = F.abs(s["y"] - y), F.greatest(s["fs"], r["fs"]), s["end"] - r["x"]
        tolerance = F.greatest(0.4 * F.least(s["fs"], r["fs"]), F.lit(1.0))
        breaks = (drop > tolerance) | (back > 2.0 * em) | ((back > 1.2 * em) & (drop > 0.1))
        gap, unit = r["x"] - s["end"], F.greatest(r["fs"], F.lit(1.0))
        last, first = F.right(s["t"], F.lit(1)), F.left(r["t"], F.lit(1))
        tight = ((last != "") & (F.instr(F.lit(TIGHT_END), last) > 0)) | ((first != "") & (F.instr(F.lit(TIGHT_START), first) > 0))
        wide = gap > F.when(tight, 0.5).otherwise(0.3) * unit
        space = F.when((last != " ") & (first != " ") & wide, " ").otherwise("")
        fresh = (r["t"].alias("t"), r["x"].alias("x"), y.alias("y"), r["fs"].alias("fs"), (r["x"] + r["w"]).alias("end"))
        new = F.struct(s["done"].alias("done"), *fresh)
        after = F.struct(F.concat(s["done"], F.array(_line(s))).alias("done"), *fresh)
        more = F.struct(s["done"].alias("done"), F.concat(s["t"], space, r["t"]).alias("t"), s["x"].alias("x"), s["y"].alias("y"), s["fs"].alias("fs"), (r["x"] + r["w"]).alias("end"))
        return F.when(s["t"].isNull(), new).when(breaks, after).otherwise(more)

    return F.aggregate(ordered(runs), start, step, lambda s: F.when(s["t"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(_line(s)))))
