"""Writers: JSON, CSV and text, one folder per target, kind, run and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage.functions.hosts import clean_domain


def _sorted(col: Column, kind: T.DataType) -> Column:
    """The value with the fields of all its structs in name order."""
    if isinstance(kind, T.StructType):
        fields = [_sorted(col[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(col, lambda x: _sorted(x, kind.elementType))
    return col


def _flat(field: T.StructField) -> Column:
    """The value as one CSV cell: lists joined by ', ', other nested values as JSON."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.ArrayType) and not isinstance(
        field.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)
    ):
        return F.array_join(col.cast("array<string>"), ", ").alias(field.name)
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col).alias(field.name)
    return col


def write_json(df: DataFrame, path: str) -> None:
    """One object per line, keys sorted at every level."""
    cols = [_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name)]
    df.select(*cols).write.json(path)


def write_csv(df: DataFrame, path: str, columns=None) -> None:
    """Rows under a header; nested values flattened."""
    df = df.select(*columns) if columns else df
    df.select(*[_flat(f) for f in df.schema]).write.option("header", True).option("escape", '"').csv(path)


def write_txt(df: DataFrame, path: str, columns, separator: str = " ") -> None:
    """One item per line."""
    df.select(F.concat_ws(separator, *[F.col(c).cast("string") for c in columns]).alias("value")).write.text(path)


def export_findings(df: DataFrame, base: str, target: str, kind: str, run_ts: str, formats: str = "json",
                    txt_columns=None) -> dict[str, str]:
    """Write the rows in every format named in ``formats``; returns format to path.

    The rows are computed once and kept until the last format is written.
    """
    name = target_name(df, target)
    root = f"{base.rstrip('/')}/target={name}/kind={kind}/run_ts={run_ts}"
    kept = df.persist()
    paths = {}
    try:
        if "json" in formats:
            paths["json"] = f"{root}/format=json"
            write_json(kept, paths["json"])
        if "csv" in formats:
            paths["csv"] = f"{root}/format=csv"
            write_csv(kept, paths["csv"])
        if "txt" in formats:
            paths["txt"] = f"{root}/format=txt"
            write_txt(kept, paths["txt"], txt_columns or [kept.columns[0]])
    finally:
        kept.unpersist()
    return paths


def export_report(report: DataFrame, base: str, target: str, module: str, run_ts: str, formats: str = "csv") -> str:
    """Write a long report (section, item, url, detail), one folder per section and format; returns the root."""
    name = target_name(report, target)
    root = f"{base.rstrip('/')}/target={name}/kind={module}/run_ts={run_ts}"
    by_section = lambda df: df.write.partitionBy("section")
    kept = report.persist()
    try:
        if "json" in formats:
            by_section(kept.select("section", "detail", "item", "url")).json(f"{root}/format=json")
        if "csv" in formats:
            by_section(kept).option("header", True).option("escape", '"').csv(f"{root}/format=csv")
        if "txt" in formats:
            line = F.concat_ws(" | ", "item", "url", "detail").alias("value")
            by_section(kept.select("section", line)).text(f"{root}/format=txt")
    finally:
        kept.unpersist()
    return root


def target_name(df: DataFrame, target: str) -> str:
    """The target as a folder name."""
    return df.sparkSession.range(1).select(clean_domain(F.lit(target)).alias("t")).first().t.replace(".", "_")


def stamped(df: DataFrame, **provenance: str) -> DataFrame:
    """Rows with where they came from and when they were found."""
    marks = {name: F.lit(value) for name, value in provenance.items()}
    return df.withColumns({**marks, "discovered_at": F.current_timestamp()})
