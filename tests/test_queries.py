import duckdb
import pytest

from mirador.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df, columns):
    df = df[columns].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, con, name):
    got = q.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in q.ORACLE_SQL:
        want = con.execute(q.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_mismatch_rules(spark):
    got = q.variants_mismatch(spark, SF).toPandas()
    assert (got.partner_id != got.sample_id).all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
