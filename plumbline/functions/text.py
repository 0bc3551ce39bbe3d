"""Names, paths and captions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Device names that some file systems reserve.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{x}{i}" for x in ("COM", "LPT") for i in range(1, 10)))


def slashed(name: Column) -> Column:
    return F.translate(name, "\\", "/")


def basename(name: Column) -> Column:
    return F.element_at(F.split(slashed(name), "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(basename(name), r"(.)\.[^.]*$", "$1")


def resolved(base: Column, name: Column) -> Column:
    """``base`` joined with a name in which no ``output/`` is left."""
    return F.concat_ws("/", base, F.replace(slashed(name), F.lit("output/"), F.lit("")))


def number(text: Column) -> Column:
    """A number, or null where the text isn't one."""
    return text.try_cast("double")


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC form, for which Spark has no function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def slug(name: Column, longest: int = 120, ascii_only: bool = False) -> Column:
    """A safe file name: ``unnamed`` where nothing is left, reserved names after ``_``."""
    s = F.coalesce(name, F.lit(""))
    s = s if ascii_only else compatible(s)
    s = F.regexp_replace(s, r'[<>:"/\\|?*]', "_")
    s = F.regexp_replace(s, r"[\x00-\x1F]", "_")
    s = F.regexp_replace(F.regexp_replace(s, "[ \t]+", "_"), "_+", "_")
    s = F.regexp_replace(s, r"^[._ ]+|[._ ]+$", "")
    s = F.when(s == "", F.lit("unnamed")).otherwise(s)
    s = F.when(F.upper(s).isin(*RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
    return F.when(F.length(s) > longest, F.regexp_replace(F.left(s, F.lit(longest)), r"[._ ]+$", "")).otherwise(s)


def shortened(text: Column, longest: int, kept: int) -> Column:
    """A caption of at most ``longest`` characters: ``kept`` and an ellipsis where it is longer."""
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(kept)), F.lit("…"))).otherwise(text)
