"""Writers for the interchange form, and the guard that fails a run on violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, TimestampType

from signpost.functions.text import iso_instant


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, ArrayType):
        value = F.array_join(name, " | ")
    elif isinstance(kind, TimestampType):
        value = iso_instant(name)
    elif isinstance(kind, DateType):
        value = F.date_format(name, "yyyy-MM-dd")
    else:
        value = F.col(name).cast("string")
    return F.coalesce(value, F.lit("")).alias(name)


def interchange(df: DataFrame, fields: Sequence[str], strict: bool = False) -> DataFrame:
    """Fields in order as text: booleans ``true``/``false``, lists joined, missing ``''``.

    ``strict`` refuses columns that are not in ``fields``; otherwise they are dropped.
    """
    missing = [f for f in fields if f not in df.columns]
    extra = [c for c in df.columns if c not in fields]
    if missing or (strict and extra):
        raise ValueError(f"columns do not match the schema: missing {missing}, unknown {extra}")
    return df.select(*[_as_text(df, f) for f in fields])


def write_csv(df: DataFrame, path: str, fields: Sequence[str], strict: bool = False) -> None:
    (
        interchange(df, fields, strict).write.mode("overwrite")
        .option("header", True).option("emptyValue", "").option("escape", '"')
        .csv(path)
    )


def write_json(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """JSON lines; one object per record, characters unescaped."""
    interchange(df, fields).write.mode("overwrite").json(path)


def write_sorted(df: DataFrame, path: str, order: Sequence[Column | str]) -> None:
    """Parquet in presentation order (range-partitioned, so the sort is spread over tasks)."""
    df.orderBy(*order).write.mode("overwrite").parquet(path)


def require_clean(violations: DataFrame, shown: int = 20) -> None:
    """Fail the run when any violation exists."""
    rows = violations.limit(shown).collect()
    if rows:
        raise SystemExit("validation failed: " + "; ".join(str(tuple(r)) for r in rows))
