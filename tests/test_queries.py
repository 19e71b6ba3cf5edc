"""Every registered query against its SQL, as the driver compares them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from paperloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = plans.queries()[name](spark, sf_dir)
    cur = con.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    expected = sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())
    got = sorted(repr(tuple(r)) for r in df.select(*sorted(columns)).collect())
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'fr'").select("doc_id", "text")
    from pyspark.sql import functions as F

    from paperloom.functions.text import normalize

    plan = docs.select("doc_id", normalize(F.col("text"), use_nfkc=False).alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,fr)" in plan and "n_chars" not in plan.split("ReadSchema")[1][:120] and plan.count("ArrowEvalPython") == 1
