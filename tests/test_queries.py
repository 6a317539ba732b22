"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from voxplan.plans import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, sf_dir, sql, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    if name in oracles.SQL:  # the smallest tables have no recording of some purposes
        assert rows(got) == rows(sql.execute(oracles.SQL[name]).df())
    else:
        assert len(got)


def test_every_row_of_the_survey_has_a_query():
    counts = {"io": 6, "sg": 8, "sp": 3, "fr": 2, "ft": 4, "vq": 8, "qa": 8, "hm": 6, "sc": 5, "st": 2}
    for kind, n in counts.items():
        assert {int(q[2]) for q in queries.QUERIES if q[:2] == kind} == set(range(1, n + 1))
    assert set(queries.QUERIES) - set(oracles.SQL) == {"ft3_lpc", "ft4_lsf", "st1_stream_recognize", "st1_stream_wav"}
