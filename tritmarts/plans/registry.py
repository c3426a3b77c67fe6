"""Registry of runnable queries and their independent SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r6(x: Column | str) -> Column:
    """Six decimals; the nudge keeps exact halves on one side in every engine.

    Whole numbers are what they are, without the decimal arithmetic of ``round``.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(F.rint(x) == x, x + 0.0).otherwise(F.round(x + 1e-9, 6))


#: fractions rounded one by one; the code of more in one method is more than the JVM compiles (8,000 bytes)
FEW = 8


def tidy(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Integers as BIGINT, fractions rounded, lists as text: one shape to compare.

    Many fractions are rounded as one list, whose code does not grow with their number.
    """
    fields = df.schema.fields
    rounded = {f.name: r6(F.col(f"`{f.name}`")) for f in fields if f.name not in skip and f.dataType.typeName() in ("double", "float", "decimal")}
    if len(rounded) > FEW:
        df = df.withColumn("_rounded", F.transform(F.array(*[F.col(f"`{n}`").cast("double") for n in rounded]), r6))
        rounded = {n: F.col("_rounded")[i] for i, n in enumerate(rounded)}
    out = []
    for f in fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if f.name in skip:
            out.append(c)
        elif kind in ("byte", "short", "integer"):
            out.append(c.cast("bigint").alias(f.name))
        elif f.name in rounded:
            out.append(rounded[f.name].alias(f.name))
        elif kind == "array":
            out.append(F.array_join(c.cast("array<string>"), "|").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
