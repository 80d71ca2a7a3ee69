"""Text and time expressions shared by the resolver's stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def folded(c: Column) -> Column:
    return F.lower(strip(c))


def alias_norm(c: Column) -> Column:
    """Stripped, lower case, and every other character than [a-z0-9_] an underscore."""
    return F.regexp_replace(folded(c), "[^a-z0-9_]", "_")


def words(c: Column) -> Column:
    """Distinct runs of [a-z0-9] of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def epoch(c: Column) -> Column:
    """Seconds since 1970 of the four accepted layouts, UTC where there is no zone; 0 for anything else."""
    s = strip(c)
    whole = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}(Z|[+-]\d{2}:?\d{2})?$"), s)
    plain = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(whole, r"^([^Z+ ]*?[T ][\d:]+)", 1), "[T]", " "), F.lit("yyyy-M-d H:m:s"))
    sign = F.when(F.regexp_extract(whole, r"([+-])\d{2}:?\d{2}$", 1) == "-", -1).otherwise(1)
    zoned = whole.rlike(r":\d{1,2}[+-]\d{2}:?\d{2}$") & whole.contains("T")
    shift = F.regexp_extract(whole, r"[+-](\d{2}):?\d{2}$", 1).try_cast("int") * 3600 + F.regexp_extract(whole, r"[+-]\d{2}:?(\d{2})$", 1).try_cast("int") * 60
    odd = whole.contains(" ") & ~whole.rlike(r"^\S+ [\d:]+$")  # a zone only goes with T
    return F.coalesce(F.when(~odd, F.unix_timestamp(plain) - F.when(zoned, sign * shift).otherwise(0)), F.lit(0)).cast("double")
