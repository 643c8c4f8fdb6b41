"""Sinks of features, targets, scores and selections: whole loads as Parquet or CSV, with narrow types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types of the sink: real numbers as floats, small counts and flags as bytes or shorts.
REAL = "float"


def narrowed(df: DataFrame, keep: Sequence[str] = ("ts",), small: Mapping[str, str] | None = None) -> DataFrame:
    """Doubles and decimals as floats, the columns in `small` as the type given there (byte, short); what doesn't fit a small type becomes null."""
    small, out = small or {}, []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if f.name in small:
            c = c.try_cast(small[f.name])
        elif kind in ("double", "decimal") and f.name not in keep:
            c = c.cast(REAL)
        out.append(c.alias(f.name))
    return df.select(*out)


def write(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = ()) -> None:
    """A full load: what was at the path is replaced. form: parquet or csv (with a header; arrays as text joined by commas)."""
    if form == "csv":
        text = [F.concat_ws(",", F.col(f"`{f.name}`").cast("array<string>")).alias(f.name) if f.dataType.typeName() == "array" else F.col(f"`{f.name}`") for f in df.schema.fields]
        df.select(*text).write.mode("overwrite").partitionBy(*by).option("header", True).csv(path)
    elif form == "parquet":
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
    else:
        raise ValueError(f"no sink for {form}")
