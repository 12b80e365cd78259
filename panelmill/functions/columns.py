"""Scalar functions and driver-side column resolution."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snake_case(name: str) -> str:
    """NFKC, anything but letters and digits to one underscore, lower case."""
    text = unicodedata.normalize("NFKC", name.lstrip("﻿"))
    return re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z]+", "_", text)).strip("_").lower()


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(snake_case(c) for c in df.columns))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC and strip; null stays null (P2). Spark has no Unicode normalisation of its own."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).strip())


@F.pandas_udf(T.StringType())
def slug(text: pd.Series) -> pd.Series:
    """A key of letters, digits and underscores. Letters outside ASCII stay, so that distinct keywords stay apart."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        flat = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return re.sub(r"[\W_]+", "_", flat.lower()).strip("_")

    return text.map(one)


def number(col: Column | str) -> Column:
    """Coerce to double; what is no number, and NaN, is null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def sector_id(col: Column | str) -> Column:
    """The first run of digits as int; null where there is none."""
    return F.nullif(F.regexp_extract(col, r"(\d+)", 1), F.lit("")).try_cast("int")


def month_of(text: Column | str) -> Column:
    """Month start of ``2019-Jan`` or of an ISO date (P5)."""
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MMM")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyy MMM")))
    return F.trunc(parsed, "MM")


def panel_id(month: Column | str, key: Column | str) -> Column:
    """``2024 Aug_sector 1``."""
    return F.concat(F.date_format(month, "yyyy MMM"), F.lit("_sector "), F.col(key) if isinstance(key, str) else key)


def id_month(col: Column | str) -> Column:
    return month_of(F.split(col, "_")[0])


def id_sector(col: Column | str) -> Column:
    return F.element_at(F.split(col, " "), -1).try_cast("int")


def select_columns(columns: Iterable[str], prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), exclude: Iterable[str] = ()) -> list[str]:
    """Names by prefix or suffix, without the excluded ones, in their order."""
    out = set(exclude)
    return [c for c in columns if c not in out and (c.startswith(prefixes) or c.endswith(suffixes))]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns from the schema alone."""
    out = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in out]


def align(df: DataFrame, columns: Iterable[str], absent: float | None = 0.0) -> DataFrame:
    """Exactly ``columns``, in order; absent ones are a constant."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(absent).cast("double").alias(c) for c in columns))


def missing_flag(col: str) -> Column:
    return F.col(col).isNull().cast("int").alias(f"{col}_was_missing")


def zero_flag(col: str) -> Column:
    return F.coalesce(F.col(col) == 0, F.lit(False)).cast("int").alias(f"{col}_is_zero")


def log1p_feature(col: str) -> Column:
    """log(1 + x) of the non-negative part."""
    return F.log1p(F.greatest(F.col(col), F.lit(0.0))).alias(f"{col}_log1p")


def ratio(a: Column, b: Column, absent: float | None = 0.0) -> Column:
    """a / b; null or zero divisors give ``absent``."""
    out = F.try_divide(a, b)
    return out if absent is None else F.coalesce(out, F.lit(absent))


def mean_across(columns: Iterable[str]) -> Column:
    """Mean of the non-null ones among columns."""
    cols = [F.col(c) for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(total, sum((c.isNotNull().cast("int") for c in cols), F.lit(0)))


def mapped(col: Column | str, known: dict[str, str]) -> tuple[Column, Column]:
    """Value of a literal map, or a sanitised key; and whether the key was unknown."""
    c = F.col(col) if isinstance(col, str) else col
    hit = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[c]
    return F.coalesce(hit, F.regexp_replace(F.lower(F.trim(c)), "[^0-9a-z]+", "_")), hit.isNull()


def natural_key(col: str) -> list[Column]:
    """Sort keys of names with a number in them: the number, then the name (O2)."""
    return [F.nullif(F.regexp_extract(col, r"(\d+)", 1), F.lit("")).try_cast("long"), F.col(col)]


def downcast(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns in narrower types (P13); fails, when run, on a value that doesn't fit."""

    def one(c: str) -> Column:
        if c not in kinds:
            return F.col(c)
        small = F.col(c).try_cast(kinds[c])
        lost = F.col(c).isNotNull() & small.isNull()
        return F.when(lost, F.raise_error(F.concat(F.lit(f"{c} does not fit {kinds[c]}: "), F.col(c).cast("string"))).cast(kinds[c])).otherwise(small).alias(c)

    return df.select(*map(one, df.columns))
