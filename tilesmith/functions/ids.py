"""Identifiers and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zero_padded(x: Column | str, width: int = 5) -> Column:
    """Whole number with leading zeros; longer ones are not cut, null stays null."""
    return F.when(_c(x).isNotNull(), F.format_string(f"%0{width}d", _c(x).cast("bigint")))


def whole_text(x: Column | str, width: int | None = None) -> Column:
    """Number as text without decimals, null stays null. width: with leading zeros, which a numeric parse has lost."""
    text = F.format_string("%.0f", _c(x).cast("double"))
    return F.when(_c(x).isNotNull(), text if width is None else F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def flag(x: Column | str, no: str = "No", yes: str = "Yes") -> Column:
    """0 or 1; null for any other value."""
    return F.when(_c(x) == no, 0).when(_c(x) == yes, 1)


def any_flag(*flags: Column | str) -> Column:
    """1 - (1 - a)(1 - b)...: 1 if any of the 0/1 flags is; null if one is null."""
    return F.lit(1) - reduce(lambda a, b: a * b, (F.lit(1) - _c(f) for f in flags))


# Codes of events.
EVENT_CODES = {"none": 0, "ESKD": 1, "Death": 2, "Transplant": 3, "Dialysis": 4}


def event_code(name: Column | str) -> Column:
    codes = F.create_map(*(F.lit(v) for kv in EVENT_CODES.items() for v in kv))
    return codes[_c(name)]
