"""Fixed-decimal number formatting with Python's rounding.

Java's ``%.nf`` (``format_string``) rounds the shortest decimal form of a
double half-up, while the result log's text format rounds the exact binary
value (as C ``printf`` does), so a value such as 0.12345 can format
differently. Only values about half-way between two results (and very large
or infinite ones) can differ: those go through an Arrow-batched pandas UDF,
all others are formatted by the built-in function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _make(spec: str):
    @F.pandas_udf("string")
    def fmt(s: pd.Series) -> pd.Series:
        out = pd.Series(None, index=s.index, dtype=object)
        odd = s.notna()
        out[odd] = [format(float(v), spec) for v in s[odd]]
        return out

    return fmt


_CACHE: dict[str, object] = {}


def fixed(c: Column | str, digits: int, sign: bool = False) -> Column:
    """``f"{v:.{digits}f}"`` (``+`` sign for non-negative values when ``sign``); null stays null."""
    spec = f"{'+' if sign else ''}.{digits}f"
    if spec not in _CACHE:
        _CACHE[spec] = _make(spec)
    col = (F.col(c) if isinstance(c, str) else c).cast("double")
    scaled = F.abs(col) * F.lit(10.0 ** digits)
    odd = (F.abs(scaled - F.floor(scaled) - 0.5) < 1e-4) | (scaled >= 1e14)
    plain = F.format_string(f"%{'+' if sign else ''}.{digits}f", col)
    return F.when(col.isNull() | F.isnan(col), F.lit(None)).when(odd, _CACHE[spec](F.when(odd, col))).otherwise(plain)
