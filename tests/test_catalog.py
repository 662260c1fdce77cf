"""Every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from vellum import catalog, catalog_delivery, catalog_evidence, catalog_records  # noqa: F401

SF = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return cols, sorted((tuple(map(clean, r)) for r in frame[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalog.ORACLE_SQL[name]).df())


def test_cer_edges(spark):
    from pyspark.sql import functions as F

    from vellum.operators.validate import character_error_rate, kendall_tau

    got = spark.createDataFrame([("", ""), ("", "a"), ("ab", "ab"), ("a", "xyz")], "r string, h string").select(character_error_rate(F.col("r"), F.col("h")).alias("c")).collect()
    assert [r.c for r in got] == [0.0, 1.0, 0.0, 3.0]
    taus = spark.createDataFrame([([],), ([1],), ([1, 2, 3],), ([3, 2, 1],), ([1, 1],)], "o array<int>").select(kendall_tau(F.col("o")).alias("t")).collect()
    assert [r.t for r in taus] == [1.0, 1.0, 1.0, -1.0, 0.0]
