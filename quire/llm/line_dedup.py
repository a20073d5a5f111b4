"""Line dedup: drop lines whose normalised key occurs in several documents.

Lines are exploded, their keys hashed, distinct documents counted per hash, and
the lines over the threshold dropped except in the smallest document id holding
them.  Built from DataFrame functions only.

Shuffles: the keyed lines (hash, id, position: no text) once by (hash, id) for
the count and once by hash for the join; the texts once by document.  The count
table is written first, so that the join has a plain exchange on either side and
adaptive execution can split a line that a third of all documents share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import ascii_lower, materialize

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line):
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped, <carry>`` for every row of ``docs(doc_id, text)``.

    * Null or empty text: one empty line, which is kept.
    * A line repeated inside one document only is kept; so are all lines whose
      key has fewer than ``min_chars`` code points.
    * In the smallest id that holds a repeated key all of its lines stay.
    * Rows that share a doc_id count as one document; each is returned.  Rows
      without a doc_id count together as one document that is never the smallest.
    * Columns of ``docs`` other than those in ``carry`` are ignored; an empty
      table gives an empty one.
    """
    rest = [F.struct(*[F.col(c) for c in carry]).alias("rest")] if carry else []
    kept_rest = ["rest.*"] if carry else []
    # th tells rows apart that share an id but not a text: positions are per text
    base = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *rest).select(
        "doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"), *["rest"] * bool(carry)
    )
    keyed = materialize(
        base.select("doc_id", "th", F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "th", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"))
    )
    repeated = materialize(
        keyed.groupBy("h", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h").agg(F.count("one").alias("n_docs"), F.min("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h", "keeper")
    )
    dropped = (
        keyed.join(repeated, "h")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    joined = base.join(dropped.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    n = F.size("lines")
    # array_except hashes, so a document of n lines costs O(n) however many go
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    kept = F.transform(left, lambda i: F.get(F.col("lines"), i))
    return joined.select(
        "doc_id",
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n").alias("text"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        *kept_rest,
    )


def op2_line_dedup(spark, sf_dir):
    from quire.llm.store import read_table

    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), rep AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS gone
  FROM keyed k LEFT JOIN rep r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
