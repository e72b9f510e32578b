"""Keep-first rules: the rows of one key do not meet in one task."""

import pytest
from pyspark.sql import functions as F

from seepage.operators import dedupe as U


@pytest.fixture
def plain(spark):
    """No help from Spark's run-time splitting."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rows_of_a_hot_key_are_left_out_before_the_join(plain, monkeypatch):
    # Two keys of 400 rows each, one of them null or not kept apart; pairs; rows without a key.
    df = plain.range(2_000).select("id", F.expr(
        "CASE id % 5 WHEN 0 THEN 'hot' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE concat('pair', id DIV 10) END").alias("serial"))
    want_empty = {r.id for r in df.where("coalesce(serial, '') = ''").collect()} | {
        r.id for r in df.where("serial <> ''").groupBy("serial").agg(F.min("id").alias("id")).collect()}
    want_all = {r.id for r in df.groupBy("serial").agg(F.min("id").alias("id")).collect()}
    monkeypatch.setattr(U, "HOT_ROWS", 50, raising=False)
    monkeypatch.setattr(U, "fits", lambda d, *a: d.count() < 100)  # the pairs do not fit, the hot keys do
    kept = U.keep_first_or_empty(df, "serial", ["id"], unique=True)
    assert {r.id for r in kept.collect()} == want_empty and kept.columns == df.columns
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan  # no broadcast before: hot rows went to the join
    places = kept.where("coalesce(serial, '') = ''").groupBy(F.spark_partition_id()).count().collect()
    assert len(places) > 4 and max(r[1] for r in places) < 400  # one or two tasks had all 800 before
    assert {r.id for r in U.keep_first(df, ["serial"], ["id"], unique=True).collect()} == want_all
    monkeypatch.setattr(U, "fits", lambda d, *a: False)
    assert {r.id for r in U.keep_first_or_empty(df, "serial", ["id"], unique=True).collect()} == want_empty
    monkeypatch.setattr(U, "fits", lambda d, *a: True)
    assert {r.id for r in U.keep_first_or_empty(df, "serial", ["id"], unique=True).collect()} == want_empty
