"""French telephone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.policy import MAX_SCAN

# Where numbers stand.
LINK = r"(?i)tel:(\+?[\d\s.() -]{6,25})"
FREE = r"(?U)(?<![\d.])(?:\+33\s?|0033\s?|0)\s?[1-9](?:[\s. -]?\d{2}){4}(?![\d])"


def normalised(raw: Column) -> Column:
    """0X XX XX XX XX, or null."""
    digits = F.regexp_replace(raw, r"[^0-9+]", "")
    national = F.regexp_replace(digits, r"^(?:\+33|0033)", "0")
    return F.when(national.rlike(r"^0[1-9][0-9]{8}\z"), F.regexp_replace(national, r"([0-9]{2})(?=[0-9])", "$1 "))


def extract_phones(text: Column) -> Column:
    """The distinct numbers of a text, those of links first."""
    scanned = F.left(text, F.lit(MAX_SCAN))
    found = F.concat(F.regexp_extract_all(scanned, F.lit("(?U)" + LINK), F.lit(1)), F.regexp_extract_all(scanned, F.lit(FREE), F.lit(0)))
    return F.array_distinct(F.array_compact(F.transform(found, normalised)))
