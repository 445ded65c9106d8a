"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from veilframe import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents benchmark conversations".split()


def normal(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if pd.isna(x) else str(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, duck, name):
    got = catalogue.QUERIES[name](spark, small).toPandas()
    if name in catalogue.ORACLE_SQL:
        expected = duck.execute(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert normal(got) == normal(expected)
    else:
        assert len(got)


def test_contains_run_finds_short_items(spark, tmp_path):
    items = ["the", "red fox", "Fox ran away", "a b c d", "one two three four five", "one two three four five six", "...", "", None, "absent"]
    docs = ["The", "a red fox", "fox", "the fox ran away. a b c d e", "zero one two three four five six", "one two three four five", "", None, "a b c"]
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = normal(catalogue.contains_run(spark, str(tmp_path)).toPandas())
    assert got == normal(con.execute(catalogue.ORACLE_SQL["contains_run"]).df()) and len(got) == 8


@pytest.mark.parametrize("name", ["case_digest_doubles", "case_json_typed"])
def test_amounts_that_round_to_zero_keep_their_sign(spark, tmp_path, name):
    amounts = [-0.01, -0.49, -0.5, -0.51, -0.0, 0.0, 0.01, 0.49, 0.5, -1.5, 2.5, 9999.99]
    rows = [(k, f"Customer#{k}", x) for k, x in enumerate(amounts)]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert normal(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()) == normal(con.execute(catalogue.ORACLE_SQL[name]).df())


def test_case_json_typed_writes_any_amount_as_its_sql(spark, tmp_path):
    amounts = [539939.0, -377509.0, 1e8, 2e8, -8.851943143192172e17, 1.4106225656e17, 9.5e-5, 1e16, 5e-324, float("nan"), float("inf"), float("-inf"), 1.7e300, None, 1.0]
    rows = [(k, f"Customer#{k}", x) for k, x in enumerate(amounts)] + [(99, None, 1.25)]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = normal(catalogue.case_json_typed(spark, str(tmp_path)).toPandas())
    assert got == normal(con.execute(catalogue.ORACLE_SQL["case_json_typed"]).df()) and len(got) == 16
