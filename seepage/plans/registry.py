"""Registry of queries over the test tables with their check SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seepage.plans.derived import DERIVED, closure
from seepage.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Tables whose texts are searched or parsed, with the key that deals their rows out.
SPREAD = {"documents": ("doc_id",), "pages": ("page_id",), "customer": ("c_custkey",), "orders": ("o_orderkey",),
          "part": ("p_partkey",), "lineitem": ("l_orderkey", "l_linenumber", "l_partkey"),
          "conversations": ("conv_id", "turn")}


class Tables:
    """The test tables and the inputs derived from them, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in DERIVED:
            table = self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
            return spread(table, *SPREAD[name]) if name in SPREAD else table
        sql, inputs = DERIVED[name]
        return self.spark.sql(sql.format(**{i: f"{{{i}}}" for i in inputs}), **{i: getattr(self, i) for i in inputs})


def query(name: str, sql: str | None = None, uses: tuple = ()):
    """Register a function of Tables. ``uses`` names the derived inputs that the SQL reads."""

    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_derived(sql, uses)
        return fn

    return add


def with_derived(sql: str, uses: tuple) -> str:
    names = closure(uses)
    if not names:
        return sql
    parts = [f"{n} AS ({DERIVED[n][0].format(**{i: i for i in DERIVED[n][1]})})" for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[len('WITH '):]}"
    return f"WITH {', '.join(parts)} {body}"
