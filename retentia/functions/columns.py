"""Column expressions and schema helpers; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp0(c: ColumnLike) -> Column:
    """Negative values become 0; null stays null (``greatest`` would make it 0)."""
    c = as_col(c)
    return F.when(c < 0, F.lit(0)).otherwise(c)


def int_date(c: ColumnLike) -> Column:
    """An integer ``yyyyMMdd`` as a date; text that is no date becomes null."""
    return F.try_to_date(as_col(c).cast("string"), "yyyyMMdd")


def date_int(c: ColumnLike) -> Column:
    """A date as an integer ``yyyyMMdd``."""
    c = as_col(c)
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def newest(old: ColumnLike, new: ColumnLike) -> Column:
    """The update where there is one, the earlier value elsewhere."""
    return F.coalesce(as_col(new), as_col(old))


def valid_or(c: ColumnLike, low, high, default) -> Column:
    """Values inside [low, high] are kept; all others, null included, get ``default``."""
    c = as_col(c)
    return F.when(c.between(low, high), c).otherwise(F.lit(default))


def at_least(c: ColumnLike, threshold) -> Column:
    """1 where ``c >= threshold``, else 0 (null counts as below)."""
    return F.when(as_col(c) >= threshold, 1).otherwise(0)


def above(c: ColumnLike, threshold: float) -> Column:
    """1 where ``c > threshold`` (strict), else 0."""
    return F.when(as_col(c) > threshold, 1).otherwise(0)


def percent(c: ColumnLike) -> Column:
    return as_col(c) * F.lit(100.0)


def text_or(c: ColumnLike, default: str) -> Column:
    """The value as text, ``default`` for null."""
    return F.coalesce(as_col(c).cast("string"), F.lit(default))


def log_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """ln(a / b), with 0 where the ratio or its log is infinite; null where a or b is."""
    a, b = as_col(a), as_col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.log(F.try_divide(a, b)), F.lit(0.0)))


def map_groups(c: ColumnLike, groups: Mapping[int, Sequence], default: int) -> Column:
    """Group number of a value; ``groups`` is group -> its values."""
    c = as_col(c)
    out = None
    for group, values in groups.items():
        hit = c.isin(list(values))
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return F.lit(default) if out is None else out.otherwise(default)


def date_parts(df: DataFrame, c: str, year: str, month: str, weekday: str) -> DataFrame:
    """Adds the year, the English month name and the English weekday name of a date."""
    return df.withColumns(
        {
            year: F.year(c),
            month: F.date_format(c, "MMMM"),
            weekday: F.date_format(c, "EEEE"),
        }
    )


def fill_sentinels(df: DataFrame, mapping: Mapping[str, object]) -> DataFrame:
    """Null fill per column, each with its own sentinel."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in mapping.items()})


def fill_all(
    df: DataFrame, text: str | None = None, number: float | None = None, except_: Sequence[str] = ()
) -> DataFrame:
    """Null fill of the whole frame but ``except_``: one sentinel for text, one for numbers."""
    filled = [c for c in df.columns if c not in except_]
    if text is not None:
        df = df.na.fill(text, filled)
    if number is not None:
        df = df.na.fill(number, filled)
    return df


def clean_columns(df: DataFrame) -> DataFrame:
    """Names stripped, in lower case, inner whitespace runs as one underscore."""
    return df.toDF(*["_".join(name.lower().split()) for name in df.columns])


def suffix_columns(df: DataFrame, suffix: str, except_: Sequence[str] = ()) -> DataFrame:
    """All names but those in ``except_`` get ``suffix``."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in except_})


def key_hash(key: ColumnLike, salt: str = "") -> Column:
    """Hex digest of a key: the same on any partitioning and in any engine."""
    text = as_col(key).cast("string")
    return F.md5(F.concat(F.lit(salt), text) if salt else text)
