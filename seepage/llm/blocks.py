"""Comparing all members of a bucket with each other, however large the bucket, without emitting its pairs.

Members of a large bucket are dealt into blocks by a hash. Every pair of
blocks is a group of its own, so a bucket that holds a third of all rows is
spread over many tasks and each holds two blocks at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def block_pairs(rows: DataFrame, keys: list[str], member: str, block: int = BLOCK) -> DataFrame:
    """Rows with ``lo``, ``hi`` and ``own``: the pair of blocks and the row's own block; sorted so that groups are runs."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("members")).filter(F.col("members") > block)
    sizes = sizes.select(*[F.col(k).alias(f"hot_{k}") for k in keys],
                         F.ceil(F.col("members") / block).cast("int").alias("parts"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"hot_{k}"))
        on = same if on is None else on & same
    dealt = rows.join(sizes, on, "left").drop(*[f"hot_{k}" for k in keys])
    own = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(member), F.col("parts"))).cast("int")
    pairs = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                    lambda c: F.struct(F.least("own", c).alias("lo"), F.greatest("own", c).alias("hi"))))
    dealt = dealt.withColumn("own", own).withColumn("pair", F.explode(pairs))
    dealt = dealt.select(*rows.columns, "own", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"))
    by = [*keys, "lo", "hi"]
    return dealt.repartition(*by).sortWithinPartitions(*by)


def whole_groups(batches, by: list[str], rows: int = 32_768):
    """Tables of whole groups (runs of equal ``by``) of about ``rows`` rows, with the number of each row's group."""
    held: list[pa.RecordBatch] = []
    count = 0

    def marks(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in by:
            column = table.column(name).combine_chunks()
            values = column.fill_null("" if pa.types.is_string(column.type) else 0).to_numpy(zero_copy_only=False)
            missing = column.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= (values[1:] != values[:-1]) | (missing[1:] != missing[:-1])
        return new

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            new = marks(table)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield table.slice(0, last), np.cumsum(new[:last]) - 1
                table = table.slice(last)
            held, count = table.to_batches(), table.num_rows
    if count:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.cumsum(marks(table)) - 1


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
