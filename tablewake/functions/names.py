"""Names of tables and scripts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip


def stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]+$", "")


def qualify(name: Column, script: Column) -> Column:
    """A table without a schema is local to its script: ``t`` becomes ``<script>.t``."""
    return F.when(name.contains("."), name).when(name.isNotNull(), F.concat_ws(".", script, name))


def lookup_key(name: Column) -> Column:
    """The form in which names are compared: no outer blanks, upper case."""
    return F.upper(strip(name))


def spread_nulls(key: Column, *by: Column) -> Column:
    """Give null keys of an outer join's kept side values that match nothing and share no partition."""
    return F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64(*by).cast("string")))


def trim_strings(df: DataFrame) -> DataFrame:
    return _map_strings(df, strip)


def normalise_case(df: DataFrame) -> DataFrame:
    """Upper-case every string value."""
    return _map_strings(df, F.upper)


def _map_strings(df: DataFrame, change) -> DataFrame:
    return df.select([change(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])
