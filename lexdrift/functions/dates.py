"""Publication dates in the layouts that papers use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import DATE_WORDS


def parse_date(raw: Column) -> Column:
    """Date of strings like 17-11-2025, Nov-Dec-2025, Fall-2025 or 17-11-2024-November-17; null for anything else, and for unknown words.

    A span gives its first month, a season its first day. What follows the first year is left out.
    """
    low = F.lower(raw)
    word = F.regexp_extract(low, "^[a-z]*", 0)
    known = F.element_at(F.create_map(*[F.lit(x) for pair in DATE_WORDS.items() for x in pair]), word)
    year = F.regexp_extract(low, r"-(\d{4})", 1)
    from_word = F.when((year != "") & known.isNotNull(), F.concat_ws("-", known, year))
    digits = F.regexp_extract(low, r"^(\d{1,2}-\d{1,2}-\d{4})", 1)
    return F.to_date(F.try_to_timestamp(F.when(word != "", from_word).otherwise(F.nullif(digits, F.lit(""))), F.lit("d-M-yyyy")))


def month_axis(year: Column, month: Column) -> Column:
    """Years with months as fractions."""
    return year + (month - 1) / 12
