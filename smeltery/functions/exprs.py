"""Column expressions shared by the builders and reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trimmed(value) -> Column:
    """Trim; blank text becomes NULL."""
    text = F.trim(as_col(value))
    return F.when(text != "", text)


def blank_to(value, default) -> Column:
    """Trim, then the default for NULL or blank text."""
    return F.coalesce(trimmed(value), default if isinstance(default, Column) else F.lit(default))


def empty_to(value, default) -> Column:
    """The default for NULL or the empty string; text of spaces is kept as it is."""
    column = as_col(value)
    return F.when(column.isNull() | (column == ""), F.lit(default)).otherwise(column)


def null_to(value, default) -> Column:
    return F.coalesce(as_col(value), F.lit(default))


def join_nonblank(separator: str, *parts: Column) -> Column:
    """Parts that hold text, joined; concat_ws leaves NULL parts out."""
    return F.concat_ws(separator, *[trimmed(p) for p in parts])


def lookup(value, table: Mapping[int, str], default: str) -> Column:
    """Code to label by a small fixed table."""
    column = as_col(value)
    result = F.lit(default)
    for code, label in table.items():
        result = F.when(column == code, F.lit(label)).otherwise(result)
    return result


def ladder(value, steps: Iterable[tuple[float, object]], otherwise, at_most: bool = False) -> Column:
    """First threshold reached wins: ``value >= step`` or, with ``at_most``, ``value <= step``."""
    column = as_col(value)
    chain = None
    for bound, label in steps:
        hit = column <= bound if at_most else column >= bound
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(otherwise)


def date_key(value) -> Column:
    """Date as the integer YYYYMMDD."""
    day = as_col(value)
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def key_date(value) -> Column:
    return F.to_date(as_col(value).cast("string"), "yyyyMMdd")


def money(value, precision: int = 15) -> Column:
    return as_col(value).cast(T.DecimalType(precision, 2))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Floating division, NULL where the denominator is zero or NULL."""
    bottom = denominator.cast("double")
    return F.when(bottom != 0, numerator.cast("double") / bottom)


def money_ratio(numerator: Column, denominator: Column, precision: int = 15) -> Column:
    """Exact decimal division rounded half up to cents; NULL on a zero denominator."""
    top = numerator.cast(T.DecimalType(24, 2))
    bottom = denominator.cast(T.DecimalType(20, 2))
    return F.round(F.when(bottom != 0, top / bottom), 2).cast(T.DecimalType(precision, 2))


def stable_id(*parts: Column) -> Column:
    """First 24 hex digits of the SHA-256 over the parts put end to end."""
    return F.substring(F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 24)


def masked(value) -> Column:
    """SHA-256 bytes; NULL for NULL or empty text."""
    column = as_col(value)
    return F.when(column != "", F.unhex(F.sha2(column, 256)))


def whole_years(start: Column, end: Column) -> Column:
    """Days between, floor-divided by 365."""
    return F.floor(F.datediff(end, start) / F.lit(365)).cast("int")


def tolerant_number(value) -> Column:
    """Text to number, thousands separators and currency signs dropped, 0 where it does not parse."""
    text = as_col(value).cast("string")
    cleaned = F.regexp_replace(text, r"[^0-9.\-]", "")
    number = F.coalesce(text.try_cast("double"), cleaned.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number).otherwise(F.lit(0.0))


def tolerant_date(value) -> Column:
    """Eight-digit or ISO date text; NULL for anything that is no calendar date."""
    text = F.trim(as_col(value).cast("string"))
    compact = F.when(text.rlike(r"^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))
    iso = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(compact, iso)


def tolerant_list(value) -> Column:
    """A JSON list of text, or one bare text as a list of one."""
    column = as_col(value)
    parsed = F.from_json(column, T.ArrayType(T.StringType()))
    return F.when(F.trim(column).startswith("["), parsed).when(trimmed(column).isNotNull(), F.array(F.trim(column)))


def stamp(df: DataFrame, run_ts, validity: bool = True) -> DataFrame:
    """Validity and load columns, from the run time handed in."""
    now = F.lit(run_ts).cast("timestamp_ntz")
    df = df.withColumn("is_valid", F.lit(True))
    if validity:
        df = df.withColumn("valid_from", now).withColumn("valid_to", F.to_date(F.lit("9999-12-31")))
    return df.withColumn("_etl_timestamp", now)
