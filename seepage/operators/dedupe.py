"""Keep-first rules. All are aggregates with a map-side part, so a key that holds most rows is merged before the shuffle.

Where the order is of fixed width, only keys and ranks are aggregated and the rows themselves stay where they are.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.session import fits, settle


#: A key of this many rows is hot. There are at most MOST_HOT of them: with more rows in all, more make a key hot.
HOT_ROWS = 1_000
MOST_HOT = 100_000
#: Bits of the types that a packed rank may hold.
_BITS = {"boolean": 1, "tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "date": 32, "timestamp": 64}


def packed_rank(df: DataFrame, order) -> Column | None:
    """The order as one number of a fixed width, null first, which a hash aggregate can keep the least of; None if it is too wide."""
    kinds = [df.select(c).schema[0].dataType.simpleString() for c in order]
    if any(k not in _BITS for k in kinds) or sum(_BITS[k] + 1 for k in kinds) > 126:
        return None
    rank, wide = None, lambda n: F.lit(Decimal(n)).cast("decimal(38,0)")
    for c, kind in zip(order, kinds):
        if kind == "date":
            c = F.unix_date(c)
        elif kind == "timestamp":
            c = F.unix_micros(c)
        elif kind == "boolean":
            c = c.cast("int")
        half = 0 if kind == "boolean" else 2 ** (_BITS[kind] - 1)
        # 0 is null; what follows is shifted to 1 and above.
        place = F.coalesce(c.cast("decimal(38,0)") + wide(half + 1), wide(0))
        rank = place if rank is None else (rank * wide(2 ** (_BITS[kind] + 1))).cast("decimal(38,0)") + place
        rank = rank.cast("decimal(38,0)")
    return rank


def keep_first(df: DataFrame, keys, order, unique: bool = False, where: Column | None = None) -> DataFrame:
    """One row per key: the one that comes first in ``order`` (columns or expressions, ascending).

    ``unique`` says that the order tells any two rows of a key apart. If its
    columns are also of fixed width, nothing is sorted and no row moves: a hash
    aggregate of keys and ranks finds the keys that repeat and their least
    rank, with a map-side part, and the rows are filtered by that table, which
    is broadcast if it is small (measured) and joined by key otherwise. Before
    a join by key, rows of hot keys are filtered by those keys, which are
    broadcast, so one row of each is left, and rows for which ``where`` does not
    hold are dealt out by their ranks: no task gets the rows of one key.
    Otherwise the rows go through a sorted aggregate; the remaining columns
    do not break ties. Rows for which ``where`` does not hold are all kept.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rank = packed_rank(df, order) if unique else None
    if rank is None:
        chosen = df if where is None else df.where(where)
        place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
        best = F.min_by(F.struct(*df.columns), place).alias("_first")
        first = chosen.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best).select("_first.*")
        return first if where is None else first.unionByName(df.where(~F.coalesce(where, F.lit(False))))
    names = [f"_key{i}" for i in range(len(keys))]
    narrow = (df if where is None else df.where(where)).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], rank.alias("_rank"))
    repeated = narrow.groupBy(*names).agg(F.min("_rank").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = settle(repeated.withColumn("_deal", F.lit(0).cast("long")), "repeated")  # a written column stays a join key
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    kept = F.col("_least").isNull() | (F.col("_rank") == F.col("_least"))
    if where is not None:
        kept = kept | ~F.coalesce(where, F.lit(False))
    ranked, least = df.withColumn("_rank", rank), [*names, "_least"]
    if fits(repeated.select(*least)):
        return ranked.join(F.broadcast(repeated.select(*least)), same, "left").where(kept).select(*df.columns)
    hot = F.col("_n") >= max(HOT_ROWS, (repeated.agg(F.sum("_n")).first()[0] or 0) // MOST_HOT)
    few = repeated.where(hot).select(*least)
    if fits(few):
        ranked = ranked.join(F.broadcast(few), same, "left").where(kept).select(*df.columns, "_rank")
        repeated = repeated.where(~hot)
    if where is not None:
        ranked = ranked.withColumn("_own", F.when(where, F.lit(0)).otherwise(F.xxhash64("_rank")))
        same = same & (F.col("_own") == F.col("_deal"))
    return ranked.join(repeated.select(*least, "_deal"), same, "left").where(kept).select(*df.columns)


def keep_first_or_empty(df: DataFrame, key: str, order, unique: bool = False) -> DataFrame:
    """One row per non-empty key; rows without a key are all kept."""
    return keep_first(df, [key], order, unique, F.coalesce(F.col(key), F.lit("")) != "")


def dedupe_ordered(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values in the order of their first position."""
    return df.groupBy(value).agg(F.min(position).alias(position)).orderBy(position, value)


def union_distinct(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def union_tagged(frames: dict, tag: str) -> DataFrame:
    """All rows of all frames with the name of their origin."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def sample_per_group(df: DataFrame, group, order, n: int) -> DataFrame:
    """First ``n`` rows of each group; Spark drops the rest before the shuffle."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)

