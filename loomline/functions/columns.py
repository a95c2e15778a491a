"""Column expressions and header rules of the reconciliation: all run inside code generation."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for a missing cell.
NULL_TOKENS = ("nan", "..")
_FOLD = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c) != c and unicodedata.normalize("NFD", c)[0].isascii()}


def clean_token(c: Column) -> Column:
    """Trimmed text; a token for a missing cell becomes ''. Null stays null, numbers become text."""
    text = F.trim(c.cast("string"))
    return F.when(F.lower(text).isin(*NULL_TOKENS), "").otherwise(text)


def clean_all(df: DataFrame) -> DataFrame:
    return df.select(*[clean_token(F.col(f"`{c}`")).alias(c) for c in df.columns])


def upper_trim(df: DataFrame, columns: list[str]) -> DataFrame:
    """Headers stripped, with `_` for spaces; the listed columns in capitals and trimmed."""
    renamed = df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])
    listed = {c.strip().replace(" ", "_") for c in columns}
    return renamed.select(*[F.upper(F.trim(F.col(f"`{c}`"))).alias(c) if c in listed else F.col(f"`{c}`") for c in renamed.columns])


def fold(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def fold_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[fold(c) for c in df.columns])


def upper_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def strip_accents(c: Column) -> Column:
    """Latin letters without their accents, by one translation; null becomes ''."""
    return F.translate(F.coalesce(c, F.lit("")), "".join(_FOLD), "".join(_FOLD.values()))


def strip_suffix(df: DataFrame, layer: str, keep_underscore: bool = False) -> DataFrame:
    """Headers without the layer's name at their end, and without the sign before it."""
    sign = r"\s*" if keep_underscore else r"[\s_]*"
    return df.toDF(*[re.sub(rf"{sign}{layer}$", "", c, flags=re.I) for c in df.columns])


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    return sorted(set(needed) - set(df.columns))


def require(df: DataFrame, needed: list[str]) -> DataFrame:
    if gone := missing_columns(df, needed):
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def any_filled(columns: list[str]) -> Column:
    """Whether one of the columns holds text."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(f"`{c}`")) != "", F.lit(False)) for c in columns])


def reorder(df: DataFrame, first: list[str]) -> DataFrame:
    """The given columns that exist, then the others."""
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def with_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns; those that df lacks are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, rounded; null where there is no whole."""
    return F.when(whole > 0, F.round(100.0 * part / whole, digits))


def table_of(c: Column) -> Column:
    """Last dotted part of a name."""
    return F.element_at(F.split(c, r"\."), -1)


def schema_of(c: Column) -> Column:
    """First dotted part of a name with several."""
    parts = F.split(c, r"\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, 1))


def object_type(c: Column, subquery: str = "SUBCONSULTA", table: str = "TABLA") -> Column:
    return F.when(c.startswith("SUBQUERY"), subquery).when(c.isNotNull(), table)


def is_control(c: Column) -> Column:
    """Whether the statement calls a control procedure."""
    return F.coalesce(c.rlike("(?i)_control"), F.lit(False))


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)</?(?:html|head|body|table|tr|th|td|b|font|center)\b[^>]*>", "")


def job_code(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"JOB\s+:?\s*(@\w+)", 1), F.lit(""))


def modified(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d{2}[/-]\d{2}[/-]\d{4})", 1), F.lit(""))
