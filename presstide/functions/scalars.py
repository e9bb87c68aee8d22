"""Array, language, time and cast helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import persist_table
from .urlkeys import as_col

# The characters trimmed off a declared language, and those that
# may separate its code from a region.
LANGUAGE_TRIM = "\"' \t:-_,\n"
LANGUAGE_SEPARATORS = [":", "_", "-", " "]


def array_reverse(arr: Column | str) -> Column:
    return F.reverse(as_col(arr))


def array_uniq(arr: Column | str) -> Column:
    """Distinct elements, one null kept; null array stays null."""
    return F.array_distinct(as_col(arr))


def language_iso639(language: Column | str) -> Column:
    """Declared language to its 2- or 3-letter code, or ``invalid``."""
    code = F.lower(F.btrim(as_col(language), F.lit(LANGUAGE_TRIM)))
    return (
        F.when(F.length(code) <= 3, code)
        .when(F.substring(code, 3, 1).isin(LANGUAGE_SEPARATORS), F.substring(code, 1, 2))
        .when(F.substring(code, 4, 1).isin(LANGUAGE_SEPARATORS), F.substring(code, 1, 3))
        .when(code.isNotNull(), F.lit("invalid"))
    )


def lookup_language(df: DataFrame, language_col: str, iso639: DataFrame) -> DataFrame:
    """Add ``part3``: the code found by 2-letter code, 3-letter code or name.

    ``iso639`` has part1, part3 and ref_name. It is turned into one
    (kind, key, part3) table, so the facts are joined once, on the kind of
    lookup their text asks for.
    """
    code = F.lower(F.btrim(F.col(language_col), F.lit(LANGUAGE_TRIM)))
    sep3 = F.substring(code, 3, 1).isin(LANGUAGE_SEPARATORS)
    sep4 = F.substring(code, 4, 1).isin(LANGUAGE_SEPARATORS)
    kind = (
        F.when((F.length(code) == 2) | sep3, "part1")
        .when((F.length(code) == 3) | sep4, "part3")
        .otherwise("name")
    )
    key = (
        F.when(kind == "part1", F.substring(code, 1, 2))
        .when(kind == "part3", F.substring(code, 1, 3))
        .otherwise(code)
    )
    names = iso639.select(
        F.explode(
            F.array(
                F.struct(F.lit("part1").alias("kind"), F.col("part1").alias("key")),
                F.struct(F.lit("name").alias("kind"), F.lower("ref_name").alias("key")),
            )
        ).alias("n"),
        "part3",
    ).select(F.col("n.kind").alias("_kind"), F.col("n.key").alias("_key"), F.col("part3").alias("_part3"))
    names = names.filter(F.col("_key").isNotNull()).dropDuplicates(["_kind", "_key"])
    names = persist_table(names, "languages")
    out = df.withColumns({"_k": kind, "_v": key}).join(
        names, (F.col("_k") == F.col("_kind")) & (F.col("_v") == F.col("_key")), "left"
    )
    found = F.when(F.col("_k") == "part3", F.col("_v")).otherwise(
        F.coalesce("_part3", F.when(F.col("_v").isNotNull(), F.lit("invalid")))
    )
    return out.withColumn("part3", found).drop("_k", "_v", "_kind", "_key", "_part3")


def hour_of(ts: Column | str) -> Column:
    return F.date_trunc("HOUR", as_col(ts))


def day_of(ts: Column | str) -> Column:
    return F.date_trunc("DAY", as_col(ts))


def month_of(ts: Column | str) -> Column:
    return F.date_trunc("MONTH", as_col(ts))


def epoch(ts: Column | str) -> Column:
    """Seconds since 1970 in UTC."""
    return F.unix_timestamp(as_col(ts).cast("timestamp"))


def parse_time(text: Column | str) -> Column:
    """Text to timestamp; unreadable text gives null instead of failing the job."""
    return F.try_to_timestamp(as_col(text))


def seconds_from(ts: Column | str, origin: str = "1000-01-01") -> Column:
    """Distance of a time from ``origin``, in seconds."""
    return F.abs(epoch(ts) - F.unix_timestamp(F.lit(origin).cast("timestamp")))


def time_in(ts: Column | str, lo, hi, closed: bool = False) -> Column:
    """``lo <= ts < hi``; with ``closed`` the upper end is included.

    The ends take the column's own type, so the range reaches the file scan.
    """
    t = as_col(ts)
    return (t >= F.lit(lo)) & ((t <= F.lit(hi)) if closed else (t < F.lit(hi)))
