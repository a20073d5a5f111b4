"""The corpus pipeline: stages over documents, each written and read again.

Counted as part of the subpackage quire.llm.  Every stage takes (spark, docs,
sf_dir) and works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.llm import near_dup, pieces, quality
from quire.llm.line_dedup import dedup_lines
from quire.llm.mixing import mixed_rows
from quire.llm.store import materialize, read_table


def keep_quality(spark, docs, sf_dir):
    """Documents whose score reaches the classifier's threshold; the others go.

    Every row is judged by its text, all of it, and keeps its columns.  Null and
    empty texts have the score of the bias alone; null ids and repeated rows stay
    what they are; an empty table stays empty, and without labels all scores are
    one share."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark, docs, sf_dir):
    """Every document with its repeated lines dropped and n_chars counted anew.

    A null text becomes an empty one.  Rows that share an id count as one document,
    rows without an id as one that is never the smallest; each row is kept, with
    all other columns whatever their names.  Empty table: empty."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *others).alias("__others"))
    out = dedup_lines(packed, carry=["__others"])
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[(made[c] if c in made else F.col(f"__others.`{c}`")).alias(c) for c in docs.columns])


def keep_one_of_each_group(spark, docs, sf_dir):
    """One row of each group of similar texts: the one with the smallest doc_id, null ids last.

    Rows are told apart by id and content, so different texts under a null or
    repeated id are decided each on its own; ties go by hashes of text and row.
    Texts without words, null ones too, are one group.  All columns are kept; an
    empty table stays empty; a very long text is one set of shingles."""
    row = F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", F.md5(F.col("text").cast("binary")).alias("text"), F.xxhash64(*[f"`{c}`" for c in docs.columns]).alias("row"))
    named = docs.withColumn("__row", row)
    groups = near_dup.join_similar(named.select(F.col("__row").alias("doc_id"), "text"))
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    kept = named.join(stay, F.col("__row").eqNullSafe(F.col("__stay")), "left_semi")
    return kept.dropDuplicates(["__row"]).select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them; those it does not take go.

    Null sources are one source, empty texts are taken once, null ids share one
    place in the order; all columns are kept.  Empty table: empty."""
    return mixed_rows(docs)


def encode_pieces(spark, docs, sf_dir):
    """Every remaining row as piece ids, with a digest of the text decoded from them.

    Null and empty texts have no ids.  Rows are kept as often as they come; other
    columns go.  Empty table: empty; very long texts are encoded whole."""
    return pieces.encode_and_check(docs.select("doc_id", "text"), pieces.public_model())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]
#: A fitted classifier, chosen-path search and a tokenizer have no SQL form; the
#: stages are tested against brute force in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
