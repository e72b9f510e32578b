"""Places of rows in a total order, without a window over the whole table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seepage.session import settle


def _free(df: DataFrame, name: str) -> str:
    """A column name that the table does not use, in any case."""
    used = {c.lower() for c in df.columns}
    while name in used:
        name += "_"
    return name


def placed(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """Rows with their place from 1 in ``order`` (columns or sort expressions), without gaps.

    Rows are dealt to tasks by ranges of the order and sorted there; a task's
    rows start after those of the ranges before it, of which there is one count
    a task. Rows that the order does not tell apart follow as they came, and
    many of them may be dealt to several tasks. The rows are written before
    they are dealt, so that a repeated task gives the same ones. The result is
    in the shared folder, one range a file. A column called ``name`` is replaced.
    """
    df = df.drop(name)
    row, at, part, n, base = (_free(df, c) for c in ("_row", "_at", "_part", "_n", "_base"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = settle(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    dealt = rows.repartitionByRange(*order, F.col(row)).sortWithinPartitions(*order, F.col(row)).drop(row)
    # The number holds the task in its upper bits and the row's place in the task in the 33 lower ones.
    numbered = settle(dealt.withColumn(at, F.monotonically_increasing_id()), "ranges").withColumn(part, F.shiftright(at, 33))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = numbered.groupBy(part).agg(F.count(F.lit(1)).alias(n)).select(  # one row a task
        part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(bases), part).select(*df.columns, (inside + F.col(base) + 1).alias(name))
