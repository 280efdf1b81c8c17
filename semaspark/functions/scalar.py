"""Scalar functions whose results must not depend on the engine."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def timeframe(at: Column, frame: str, is_date: bool = False) -> Column:
    """A timestamp or date at one of the time frames, as it is displayed."""
    if frame in ("raw", "time"):
        return at.cast("date") if is_date else at
    if frame == "date":
        return at.cast("date")
    if frame == "week":
        return F.date_trunc("WEEK", at).cast("date")
    if frame == "month":
        return F.date_format(at, "yyyy-MM")
    if frame == "quarter":
        return F.concat(F.year(at).cast("string"), F.lit("-Q"), F.quarter(at).cast("string"))
    if frame == "year":
        return F.year(at)
    raise ValueError(f"unknown time frame '{frame}'")


def hour_diff(start: Column, end: Column) -> Column:
    """Hour boundaries between two times."""
    return F.timestamp_diff("HOUR", F.date_trunc("HOUR", start), F.date_trunc("HOUR", end))


def day_diff(start: Column, end: Column) -> Column:
    """Days between two dates."""
    return F.datediff(end.cast("date"), start.cast("date"))


def local_to_utc(zone: Column, at: Column) -> Column:
    """Wall clock of a zone to that of UTC; of a repeated hour the earlier pass."""
    return F.convert_timezone(zone, F.lit("UTC"), at)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def normalised_status(c: Column, canonical: str = "Shipped") -> Column:
    """Trimmed; spellings of the canonical status become it."""
    return F.when(F.lower(F.trim(c)) == canonical.lower(), canonical).otherwise(F.trim(c))


def short_value(c: Column, limit: int = 160) -> Column:
    """Values over ``limit`` characters as the start of their hash."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.lit("sha:"), F.substring(F.sha2(c, 256), 1, 12)))


def _squeeze(s: str | None) -> str:
    return re.sub(r"[^a-z0-9]", "", (s or "").lower())


def fuzzy_equal(a: str | None, b: str | None) -> bool:
    """One begins the other, or their difference ratio is 0.85 at least, by
    letters and digits alone; an empty side equals nothing."""
    a, b = _squeeze(a), _squeeze(b)
    if not a or not b:
        return False
    return a.startswith(b) or b.startswith(a) or difflib.SequenceMatcher(None, a, b).ratio() >= 0.85


@F.pandas_udf(T.BooleanType())
def fuzzy_equal_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_equal(x, y) for x, y in zip(a, b, strict=True)])


def six_digits(v: Column) -> Column:
    """Numbers to six significant digits in scientific form, without trailing
    zeros; null as the empty text, either zero as 0."""
    text = F.regexp_replace(F.format_string("%.5e", v), r"\.?0+e", "e")
    return F.when(v.isNull(), "").when(v == 0, "0").otherwise(text)


def normalise(df: DataFrame) -> DataFrame:
    """Decimals as doubles and all whole numbers as bigints."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType | T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
