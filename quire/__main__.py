"""python -m quire PATH [text|md|html|json]: print what the files below PATH hold."""

from __future__ import annotations

import sys

KINDS = {"text": "paged", "md": "markdown", "markdown": "markdown", "html": "html", "json": "json"}


def main(args: list[str]) -> int:
    if not 1 <= len(args) <= 2 or (len(args) == 2 and args[1] not in KINDS):
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from quire.operators.extract import read_pdfs
    from quire.ship import ship

    spark = SparkSession.builder.master("local[*]").appName("quire").config("spark.ui.enabled", "false").getOrCreate()
    ship(spark)
    frames, kind = read_pdfs(spark, args[0], glob="*"), KINDS[args[1] if len(args) == 2 else "text"]
    for row in frames.rendered(kind).toLocalIterator():
        print(row[kind])
    failed = frames.errors.toLocalIterator()
    worst = 0
    for row in failed:
        print(f"{row.doc_id}: {row.error_code}: {row.error_message}", file=sys.stderr)
        worst = 1
    spark.stop()
    return worst


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
