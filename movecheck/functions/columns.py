"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ident(name: str) -> Column:
    """The column with exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    Lambdas of array functions would otherwise work out an outer expression again for
    every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def six_digits(value: Column) -> Column:
    """``value`` rounded to six significant digits."""
    text = F.format_string("%.6g", value.cast("double"))
    return F.when(value.isNotNull(), text).try_cast("double")


def round_report(df: DataFrame) -> DataFrame:
    """Every double or float column of a finished report at six significant digits."""
    return df.select(
        *[
            six_digits(ident(name)).alias(name) if kind in ("double", "float") else ident(name)
            for name, kind in df.dtypes
        ]
    )


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def join_by(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` where null keys match each other, keeping ``left``'s keys.

    Segments may be null; a plain equi-join would silently drop those rows.
    """
    renamed = right.select(
        *[ident(c).alias(f"__r_{c}") if c in on else ident(c) for c in right.columns]
    )
    condition = all_of(ident(c).eqNullSafe(ident(f"__r_{c}")) for c in on)
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in on])
