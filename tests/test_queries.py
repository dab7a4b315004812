"""Every registered query runs; those with a SQL twin agree with it."""

from __future__ import annotations

import duckdb
import pytest
from checks import connect, difference
from checks import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__
from trajlens.queries.bindings import nearest

QUERIES = __spark_entry__.queries()
ORACLE = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() == 10 and "is_outlier" in found.columns


def test_curves_round_ties_as_sql_does(spark, tmp_path):
    """Ratios such as 41 / 640 lie between two numbers of six digits: all of them up to 4,000, and one inside a curve."""
    duck = duckdb.connect()
    pairs = spark.range(1, 4001).select(F.explode(F.sequence(F.lit(1).cast("long"), "id")).alias("p"), F.col("id").alias("q"))
    ties = pairs.where("p * 2000000 % q = 0 AND (p * 2000000 div q) % 2 = 1")
    found = {(r.p, r.q): r.r for r in ties.select("p", "q", nearest(F.col("p") / F.col("q"), 6).alias("r")).collect()}
    sql = """SELECT p, q, round(p::DOUBLE / q::DOUBLE, 6) FROM range(1, 4001) a(q), range(1, 4001) b(p)
             WHERE p <= q AND p * 2000000 % q = 0 AND (p * 2000000 // q) % 2 = 1"""
    assert found == {(p, q): r for p, q, r in duck.execute(sql).fetchall()}

    users = [u for u in range(1, 1000) if u % 11][:640]
    # 41 positives first, then 599 negatives: (user_id + event_id) % 4 = 0 marks a positive
    events = [(4000 - u if i < 41 else 4001 - u, u, "a", float(1000 - i)) for i, u in enumerate(users)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(path)
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    for name in ("pr_curve", "roc_curve"):
        assert difference(QUERIES[name](spark, str(tmp_path)), duck, ORACLE[name]) is None
