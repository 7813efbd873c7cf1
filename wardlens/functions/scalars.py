"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as Python's str methods and \s see it, as a character class and as a set to trim.
WHITESPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHITESPACE_SET = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: str | Column) -> Column:
    """Numeric coercion: anything that is not a finite number becomes NULL."""
    parsed = col(value).try_cast("double")
    infinite = F.lit(float("inf"))
    return F.when(F.isnan(parsed) | (F.abs(parsed) == infinite), None).otherwise(parsed)


def timestamp(value: str | Column) -> Column:
    """Date coercion: unparseable text becomes NULL."""
    return col(value).try_cast("timestamp_ntz")


def strip(value: str | Column) -> Column:
    """Trim any whitespace; looks at the ends only."""
    return F.btrim(col(value), F.lit(WHITESPACE_SET))


def collapse_whitespace(value: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(value), f"{WHITESPACE}+", " "))


def explode_once(frame: DataFrame, keys: list[str | Column], array: str) -> DataFrame:
    """``(keys, position, item)`` of an array column that is costly to compute.

    An inner explode makes the optimizer repeat the array expression in a
    non-empty filter below it; the outer form is computed once.
    """
    rows = frame.select(*keys, F.posexplode_outer(array).alias("position", "item"))
    return rows.where("position IS NOT NULL")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def ratio(part: Column, whole: Column) -> Column:
    """Division in doubles, NULL where the denominator is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def scalar(frame: DataFrame, expression: Column) -> Column:
    """A one-row aggregate as an uncorrelated scalar subquery."""
    return frame.select(expression.alias("value")).scalar()


def lookup(frame: DataFrame, key: str, value: Column) -> Column:
    """A short keyed table (one row per label or column name) as a map-valued scalar subquery."""
    return scalar(frame, F.map_from_entries(F.collect_list(F.struct(F.col(key).alias("key"), value.alias("value")))))


def share_of_total(grouped: DataFrame, rows: str) -> Column:
    """Sum of ``rows`` over all groups, sharing the shuffle that built them."""
    return scalar(grouped, F.sum(rows))


def stack(frame: DataFrame, pairs: list[tuple[str, Column]], label: str, value: str, kind: str = "double") -> DataFrame:
    """Turn the columns of a one-row frame into ``(label, value)`` rows."""
    entries = F.array(*[F.struct(F.lit(name).alias(label), c.cast(kind).alias(value)) for name, c in pairs])
    return frame.select(F.explode(entries).alias("entry")).select("entry.*")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def compute_once(frame: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """Costly columns behind a generator, so later filters cannot repeat them below it."""
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return frame.select(*keep, F.inline(packed))
