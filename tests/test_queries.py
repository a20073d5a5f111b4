"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from quire.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame) -> list[tuple]:
    cols = sorted(frame.columns)
    clean = frame[cols].astype(object).where(frame[cols].notna(), None)
    return sorted(map(tuple, clean.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, small_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    want, got = con.execute(ORACLE[name]).df(), QUERIES[name](spark, small_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)


def test_dropmalformed_reads_all_lines(spark, small_dir):
    from quire.plans.queries import LINES, broken, readable_lines, writer

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small_dir}/documents.parquet'")
    want = con.execute(f"SELECT * FROM ({LINES}) WHERE doc_id % 6 IN (0, 5)").df()
    assert want.page_no.max() > 1 and rows(readable_lines(spark, small_dir).toPandas()) == rows(want)
    assert len(broken(4, "a\n" * 500)) > len(broken(4, "a"))
    assert writer.image_pdf(1, 1, b"a", "a\n" * 60).count(b"/Contents") == 2


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
