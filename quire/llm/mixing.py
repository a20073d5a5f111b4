"""Mixing sources to target weights by entropy balancing.

Each source asks for a number of words (its token constraint).  Of all rates per
document that meet it, none above ``max_rate``, the ones closest to taking every
document once in the sense of entropy are ``min(max_rate, exp(l * size))``: an
exponential tilt by the document's size, with one multiplier ``l`` per source that
solves the convex dual.  Newton iterations find it: each sums gradient and Hessian
over all documents, grouped by source and size.  Rates are then rounded into whole
copies by a threshold on a hash of the id, set per source so that the words taken
come within half a document of the target.

The texts are read once for their sizes.  All later steps work on a row of a few
bytes per document, per distinct size, or on at most 4096 partial sums per source:
a source that holds a third of all rows is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.store import materialize

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_RATE = 2.0
NEWTON_STEPS = 100
#: Iterations between two written states.
BETWEEN = 4
#: Newton's method ends for a source when it misses its words by this share of them.
CLOSE = 1e-13
#: Sources up to which their table is broadcast.
SMALL = 100_000


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list, **sums) -> DataFrame:
    """Add the row's number from 0 as ``n`` and running totals of ``sums``, this row included.

    Rows are dealt by ranges of ``order``; only totals of each range meet in one task."""
    written = materialize(df.orderBy(*order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"n": F.lit(1)} | sums
    ranges = written.groupBy("part").agg(*[F.sum(c).alias(f"{k}_there") for k, c in sums.items()])
    ranges = ranges.select("part", *[F.coalesce(F.sum(f"{k}_there").over(earlier), F.lit(0)).alias(f"{k}_before") for k in sums])
    out = written.join(F.broadcast(ranges), "part")
    cols = {k: F.col(f"{k}_before") + F.sum(c).over(within) for k, c in sums.items()}
    cols["n"] = (cols["n"] - 1).cast("long")
    return out.select(*df.columns, *[c.alias(k) for k, c in cols.items()])


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, max_rate=MAX_RATE) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn.  A target
    stops at ``max_rate`` times its source's size; what it cannot use is reshared
    by weight (water filling: one level ``c`` with target = min(cap, c * weight)).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    pick = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("n"), F.lit(len(weights))).cast("int"))
    per = running(per, [by_name]).select("source", "source_size", pick.alias("w"), (F.col("source_size") * F.lit(float(max_rate))).alias("cap"))
    per = running(per, [F.col("cap") / F.col("w"), by_name], cap_upto=F.col("cap"), w_upto=F.col("w"))
    total, weight = per.agg(F.sum("source_size"), F.sum("w")).first()
    total, weight = float(total_share) * (total or 0), float(weight or 0)
    # the level if exactly the sources before this one are full
    level = (F.lit(total) - (F.col("cap_upto") - F.col("cap"))) / (F.lit(weight) - (F.col("w_upto") - F.col("w")))
    first = per.where(level * F.col("w") <= F.col("cap")).agg(F.min(F.struct(F.col("cap") / F.col("w"), F.col("n"), level.alias("c")))).first()[0]
    c = F.lit(first["c"] if first else float("inf"))
    return per.select("source", "source_size", F.when(c * F.col("w") >= F.col("cap"), F.col("cap")).otherwise(c * F.col("w")).alias("target"))


def rate_of(tilt, size, max_rate=MAX_RATE):
    """A document's rate; the tilt is null where every document is taken as often as it may be."""
    return F.when(tilt.isNull() & (size > 0), F.lit(float(max_rate))).otherwise(F.least(F.exp(F.coalesce(tilt, F.lit(0.0)) * size), F.lit(float(max_rate))))


def newton_tilts(sizes: DataFrame, targets: DataFrame, max_rate=MAX_RATE, steps=NEWTON_STEPS) -> DataFrame:
    """``source, source_size, target, tilt`` from ``sizes(source, size, n)`` and ``targets``.

    Each iteration sums, over the documents of a source, the words that its rates
    take (the dual's gradient, with the target) and their derivative (the Hessian,
    documents at max_rate have none).  The root lies between 0 and log(target /
    source_size) or log(max_rate), as sizes are 1 at least; a step that leaves the
    bracket known so far goes to its middle.  Sums are decimal, so they do not
    depend on their order.  An empty source has tilt 0, a full one none.
    """
    size, goal, cap = F.col("source_size").cast("double"), F.col("target"), F.lit(float(max_rate))
    full, zero = goal >= cap * size * (1 - 1e-12), F.lit(0.0)
    state = targets.select(
        F.col("source").alias("s"), "source_size", "target", F.when(~full | (size == 0), zero).alias("tilt"),
        F.when(goal < size, F.log(goal / size)).otherwise(zero).alias("low"), F.when(goal < size, zero).otherwise(F.log(cap)).alias("high"),
        (full | (size == 0) | (goal <= 0)).alias("done"),
    )
    taken = F.col("n") * F.col("size") * rate_of(F.col("tilt"), F.col("size"), max_rate)
    slope = F.when(F.exp(F.col("tilt") * F.col("size")) < cap, taken * F.col("size")).otherwise(zero)
    sized = sizes.where("size > 0")

    def iteration(state: DataFrame) -> DataFrame:
        """The sums of a source meet its state in the group itself: one join and one grouping."""
        here = sized.join(state, F.col("source").eqNullSafe(F.col("s"))).groupBy(*state.columns)
        sums = here.agg(F.sum(taken.cast("decimal(38,12)")).cast("double").alias("got"), F.sum(slope.cast("decimal(38,12)")).cast("double").alias("slope"))
        miss = F.col("got") - goal
        moved = (
            sums.withColumn("low", F.when(miss < 0, F.col("tilt")).otherwise(F.col("low")))
            .withColumn("high", F.when(miss > 0, F.col("tilt")).otherwise(F.col("high")))
            .withColumn("step", F.col("tilt") - miss / F.nullif(F.col("slope"), zero))
            .withColumn("next", F.when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step")).otherwise((F.col("low") + F.col("high")) / 2))
        )
        # the bracket may hold no number between its ends any more
        over = (F.abs(miss) <= goal * CLOSE) | (F.col("next") == F.col("tilt")) | (F.col("high") - F.col("low") <= 1e-18)
        return moved.select("s", "source_size", "target", F.when(F.col("done") | over, F.col("tilt")).otherwise(F.col("next")).alias("tilt"), "low", "high", (F.col("done") | over).alias("done"))

    state = materialize(state)
    out = state.where("done")
    for _ in range(0, steps, BETWEEN):
        state = state.where("not done")
        if not state.limit(1).count():
            break
        for _ in range(BETWEEN):
            state = iteration(state)
        state = materialize(state)
        out = out.unionAll(state.where("done"))
    else:
        out = out.unionAll(state.where("not done"))
    return out.select(F.col("s").alias("source"), "source_size", "target", "tilt")


def place_of(doc_id):
    """A document's place in its source's order: 52 bits of a hash of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10).cast("long")


def _rounded(tilt, size, u, max_rate=MAX_RATE):
    """(copies at least, place): a document is taken once more if its place is at most the source's ``last``.

    The place is its order by hash less the fraction of its rate, so that with
    ``last`` 0 a document is rounded up as often as its rate says; null at
    max_rate.  53 bits, from 0."""
    rate = rate_of(tilt, size, max_rate)
    base = F.floor(rate)
    place = u - F.floor((rate - base) * float(1 << 52)) + (1 << 52)
    return base.cast("long"), F.when(base < max_rate, place.cast("long"))


def mixing_plan(sized: DataFrame, max_rate=MAX_RATE, **params) -> tuple[DataFrame, bool]:
    """``s, source_size, target, tilt, last`` per source, and whether that is small
    enough to broadcast, from ``sized(doc_id, source, size, u)``."""
    sizes = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    per = sizes.select("source", (F.col("n") * F.col("size")).alias("size"))
    tilts = newton_tilts(sizes, source_targets(per, max_rate=max_rate, **params), max_rate)
    # one row per source: broadcast only while that stays under a checked bound
    small = tilts.limit(SMALL + 1).count() <= SMALL

    def with_goal(df, table):
        return df.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    named = tilts.withColumnRenamed("source", "s")
    base = F.floor(rate_of(F.col("tilt"), F.col("size"), max_rate)).cast("long")
    whole = with_goal(sizes, named.select("s", "tilt")).groupBy("source").agg(F.sum(F.col("n") * F.col("size") * base).alias("whole"))
    goal = named.join(whole, F.col("s").eqNullSafe(F.col("source"))).select("s", "source_size", "target", "tilt", (F.col("target") - F.col("whole")).alias("extra"))
    goal = materialize(goal)
    placed = with_goal(sized, goal.select("s", "tilt")).select("source", "size", _rounded(F.col("tilt"), F.col("size"), F.col("u"), max_rate)[1].alias("place"))
    placed = materialize(placed.where("place is not null and size > 0"))

    def narrowed(found):
        """extra per source with the bin found for it; sources without one are done."""
        a, b = goal.select("s", "extra").alias("a"), found.alias("b")
        return a.join(b, F.col("a.s").eqNullSafe(F.col("b.s"))).select("a.s", "extra", "bin_at", "before")

    def search(df, parts, done):
        """Find, per source, the bin in which the words taken pass ``extra``.

        df: source, bin, size.  Adds to goal the words before that bin and its number."""
        sums = df.groupBy("source", "bin").agg(F.sum("size").alias("words"))
        w = Window.partitionBy("source").orderBy("bin")
        cum = with_goal(sums, parts).withColumn("upto", F.sum("words").over(w) + F.col(done))
        first = cum.where(F.col("upto") > F.col("extra")).groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("m"))
        return first.select("s", F.col("m.bin").alias("bin_at"), F.col("m.before").alias("before"))

    # places have 53 bits; a level of the search looks at 12 of them
    top, mid = F.shiftright("place", 41), F.shiftright("place", 29)
    lean = goal.select("s", "extra", F.lit(0).cast("long").alias("zero"))
    b1 = materialize(search(placed.select("source", top.alias("bin"), "size"), lean, "zero"))
    g2 = narrowed(b1)
    in1 = with_goal(placed, g2).where(top == F.col("bin_at")).select("source", "place", "size")
    b2 = materialize(search(in1.select("source", mid.alias("bin"), "size"), g2.select("s", "extra", "before"), "before"))
    g3 = narrowed(b2)
    # one of 16 million bins per source: its rows are ordered one by one
    ties = with_goal(placed, g3).where(mid == F.col("bin_at")).groupBy("source", "place").agg(F.sum("size").alias("words"), F.first("extra").alias("extra"), F.first("before").alias("before"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("place")) + F.col("before")
    edge = (
        ties.withColumn("upto", upto)
        .where((F.col("upto") > F.col("extra")))
        .groupBy(F.col("source").alias("s"))
        .agg(F.min(F.struct("place", "upto", "words", "extra")).alias("m"))
        .select("s", F.when(F.col("m.upto") - F.col("m.extra") < F.col("m.extra") - (F.col("m.upto") - F.col("m.words")), F.col("m.place")).otherwise(F.col("m.place") - 1).alias("last"))
    )
    # without an edge every document goes up: the source has no words for more
    plan = materialize(
        goal.alias("g").join(edge.alias("e"), F.col("g.s").eqNullSafe(F.col("e.s")), "left")
        .select("g.s", "source_size", "target", "tilt", F.coalesce("last", F.lit(1 << 53)).alias("last"))
    )
    return plan, small


def _copies(p: str, size, u, max_rate=MAX_RATE):
    """Copies of a document by the plan columns below ``p``.  What is empty is taken once."""
    base, place = _rounded(F.col(f"{p}.tilt"), size, u, max_rate)
    return (base + F.when((place <= F.col(f"{p}.last")) & (size > 0), 1).otherwise(0)).cast("long")


def _planned(df: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    named = plan.select(F.col("s").alias("__mix_source"), F.struct("source_size", "target", "tilt", "last").alias("__mix"))
    return df.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("__mix_source"))).drop("__mix_source")


def _sized(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place_of(F.col("doc_id")).alias("u")))


def mix(docs: DataFrame, max_rate=MAX_RATE, **params) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken`` for every row.

    ``taken = copies * size``.  Copies are rounded by a hash of the id, so reruns
    agree; rows that share source, id and size share their number of copies.

    * Null text: size 0; what is empty is taken once.  Null source: a source of
      its own, last in order; null doc_id: hashed as the text 'null'.  Empty
      table: empty result.
    * A very long text is a document like others: below its source's target its
      rate is the lower, above it the higher, the longer it is.
    * A source whose words are all in one document is rounded to whole copies.
    * Other columns of ``docs`` are ignored.
    """
    sized, size = _sized(docs), F.col("size")
    out = _planned(sized, *mixing_plan(sized, max_rate, **params)).withColumn("copies", _copies("__mix", size, F.col("u"), max_rate))
    rate = rate_of(F.col("__mix.tilt"), size, max_rate)
    return out.select("doc_id", "source", "size", "__mix.source_size", "__mix.target", rate.alias("rate"), "copies", (F.col("copies") * size).alias("taken"))


def mixed_rows(docs: DataFrame, max_rate=MAX_RATE, **params) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    The plan has a row per source and is joined to the documents as they lie:
    the texts are not shuffled."""
    sized = _sized(docs)
    # counted below the join: above it the planner would count the words again for every mention
    known = docs.withColumn("__mix_size", word_count(F.col("text"))).withColumn("__mix_u", place_of(F.col("doc_id")))
    out = _planned(known, *mixing_plan(sized, max_rate, **params))
    out = out.withColumn("__copies", _copies("__mix", F.col("__mix_size"), F.col("__mix_u"), max_rate))
    out = out.where(F.col("__copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op8_mixing(spark, sf_dir):
    from quire.llm.store import read_table

    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT AS u
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source
), fill AS (  -- the excess is reshared by weight until none is above
  SELECT source, source_size, w, false AS full_, 0 AS round, 0.0::DOUBLE AS level FROM s0
  UNION ALL
  SELECT source, source_size, w, full_ OR nl * w >= 2.0 * source_size, round + 1, nl
  FROM (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (WHERE full_) OVER (), 0))
                  / nullif(sum(w) FILTER (WHERE NOT full_) OVER (), 0) AS nl FROM fill)
  WHERE round < 40
), t AS (
  SELECT source, source_size, full_, CASE WHEN full_ THEN 2.0 * source_size ELSE level * w END AS target
  FROM fill WHERE round = 40
), b AS (  -- the multiplier by halving: the words taken grow with it
  SELECT t.source, t.target, list(h) AS sizes, 0 AS round,
         CASE WHEN target < source_size THEN ln(target / source_size) ELSE 0.0 END::DOUBLE AS low,
         CASE WHEN target < source_size THEN 0.0 ELSE ln(2.0) END::DOUBLE AS high
  FROM t JOIN (SELECT source, {'size': size, 'n': count(*)} AS h FROM d WHERE size > 0 GROUP BY source, size) g
    ON g.source IS NOT DISTINCT FROM t.source
  WHERE NOT full_ GROUP BY ALL
  UNION ALL
  SELECT source, target, sizes, round + 1, CASE WHEN got < target THEN mid ELSE low END, CASE WHEN got < target THEN high ELSE mid END
  FROM (SELECT *, (low + high) / 2 AS mid,
               list_sum(list_transform(sizes, lambda x: x.n * x.size * least(2.0, exp((low + high) / 2 * x.size)))) AS got FROM b)
  WHERE round < 100
), r AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN full_ AND size > 0 THEN 2.0 ELSE least(2.0, exp(coalesce((low + high) / 2, 0.0) * size)) END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    LEFT JOIN (SELECT * FROM b WHERE round = 100) m ON m.source IS NOT DISTINCT FROM d.source
), c AS (
  SELECT *, floor(rate)::BIGINT AS base, size > 0 AND rate < 2 AS open_,
         CASE WHEN size > 0 AND rate < 2 THEN u - floor((rate - floor(rate)) * 4503599627370496)::BIGINT END AS place,
         target - sum(floor(rate)::BIGINT * size) OVER (PARTITION BY source) AS extra
  FROM r
), e AS (
  SELECT *, sum(size) FILTER (WHERE open_) OVER (PARTITION BY source ORDER BY place NULLS LAST) AS upto,
         sum(size) FILTER (WHERE open_) OVER (PARTITION BY source, place) AS words
  FROM c
), f AS (
  SELECT *, min(CASE WHEN open_ AND upto > extra THEN place END) OVER (PARTITION BY source) AS edge FROM e
)
SELECT doc_id, size, source_size, target,
  (base * size + CASE WHEN open_ AND (edge IS NULL OR place < edge OR (place = edge AND upto - extra < extra - (upto - words))) THEN size ELSE 0 END)::BIGINT AS taken
FROM f
"""
