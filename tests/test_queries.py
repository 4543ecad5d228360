"""Every query of the reference's operators runs; those with SQL equal DuckDB's result."""

import math

import duckdb
import pytest

from covaria.plans import entries

SF = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events embeddings".split()
QUERIES, SQL = entries.queries(), entries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def table(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


@pytest.mark.parametrize("name", ["c14_natural_gradient_real", "c15_scaled_gaussian_estimator_real"])
def test_groups_of_many_samples_equal_sql(spark, tmp_path, name):
    """Two labels of 12,500 embeddings each, with vec_ids of their own."""
    c = duckdb.connect()
    c.sql(f"copy (select vec_id * 100000 + copy as vec_id, embedding, (vec_id % 2)::int as label from '{SF}/embeddings.parquet', (select unnest(range(25000 // (select count(*) from '{SF}/embeddings.parquet'))) as copy) k) to '{tmp_path}/embeddings.parquet' (format parquet)")
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    assert c.sql("select min(c) from (select count(*) as c from embeddings group by label) x").fetchall()[0][0] > 12000
    assert table(QUERIES[name](spark, str(tmp_path)).toPandas()) == table(c.sql(SQL[name]).df())


def test_one_primary_sample_a_trial(spark, tmp_path):
    """Rows that occur three times, vec_ids that are null, and a label whose first embedding is null."""
    c = duckdb.connect()
    source = f"'{SF}/embeddings.parquet', (select unnest(range(3)) as copy) k"
    c.sql(f"copy (select case when vec_id % 7 = 6 and label <> 3 then null else vec_id end as vec_id, case when label <> 3 or vec_id > (select min(vec_id) from '{SF}/embeddings.parquet' where label = 3) then embedding end as embedding, label from {source}) to '{tmp_path}/embeddings.parquet' (format parquet)")
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    got = table(QUERIES["d17_adaptive_matched_real"](spark, str(tmp_path)).toPandas())
    assert got == table(c.sql(SQL["d17_adaptive_matched_real"]).df()) and ("null", "3") in got
    for name in ("d17_adaptive_scm", "d17_adaptive_two_array_tyler"):
        rows = QUERIES[name](spark, str(tmp_path)).toPandas()
        assert sorted(rows["trial"]) == list(range(10))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    assert not any(isinstance(v, float) and math.isinf(v) for r in rows for v in r)


def test_entry_works_without_the_text_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(QUERIES) <= set(e.queries())
