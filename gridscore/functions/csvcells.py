"""CSV cells with the report's quoting rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore import domain


def csv_text(name: str, value: Column) -> Column:
    """A text cell: formulas are defused, quotes only where needed or demanded; null is empty."""
    safe = F.when(value.rlike(r"\A[=+\-@\t\r\n]"), F.concat(F.lit("'"), value)).otherwise(value)
    needs = F.lit(True) if name in domain.CSV_FORCE_QUOTE else safe.rlike('[",\r\n]')
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when((F.length(safe) > 0) & needs, quoted).otherwise(safe), F.lit(""))


def csv_number(name: str, value: Column, is_double: bool) -> Column:
    """A number cell: six decimals for the fixed columns; not-a-number and null are empty."""
    usable = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value) if is_double else value
    if name in domain.CSV_SIX_DECIMALS:
        text = F.format_string("%.6f", usable.cast("double"))
        return F.coalesce(F.when(usable.isNotNull(), text), F.lit(""))
    plain = F.when(usable == F.floor(usable), F.floor(usable).cast("string")).otherwise(usable.cast("string")) if is_double else usable.cast("string")
    return F.coalesce(plain, F.lit(""))


def csv_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One text line per row (column ``value``), cells in the given order."""
    types = dict(df.dtypes)
    cells = []
    for name in columns:
        kind, value = types[name], F.col(name)
        if kind == "string":
            cells.append(csv_text(name, value))
        elif kind == "boolean":
            cells.append(F.coalesce(value.cast("string"), F.lit("")))
        else:
            cells.append(csv_number(name, value, kind in ("double", "float")))
    return df.withColumn("value", F.concat_ws(",", *cells))
