"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole, or `empty` where whole is zero."""
    out = F.try_divide(part.cast("double"), whole.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def decimal_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0


def histogram_bin(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bin of v among n equal ones on [lo, hi]: half-open, the last closed; NULL outside. Equal ends widen by 0.5 each way.

    The quotient can be off by one next to an edge, so it is compared with the edges themselves.
    """
    a, b = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    edge = lambda i: F.when(i == n, b).otherwise(a + i * ((b - a) / n))
    i = F.least(F.floor((v - a) / ((b - a) / n)), F.lit(n - 1)).cast("int")
    i = F.when((v < edge(i)) & (i > 0), i - 1).when((v >= edge(i + 1)) & (i < n - 1), i + 1).otherwise(i)
    return F.when((v >= a) & (v <= b), i)


def iso_date(label: Column) -> Column:
    """The first YYYY-MM-DD in a label, else an RFC 2822 date, else the label as it is."""
    found = F.regexp_extract(label, r"(\d{4}-\d{2}-\d{2})", 1)
    rfc = F.regexp_replace(label, r"^\w{3},\s*|\s+(GMT|UTC|[+-]\d{4})$", "")
    parsed = F.date_format(F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss")), "yyyy-MM-dd")
    return F.coalesce(F.nullif(found, F.lit("")), parsed, label)


def dms_parts(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees from a degrees-minutes-seconds pair; NULL where it doesn't match. Trailing text passes."""
    pattern = r"""^\s*(\d+)°(\d+)'([\d.]+)"([NS])\s+(\d+)°(\d+)'([\d.]+)"([EW])"""
    g = lambda i: F.regexp_extract(text, pattern, i)
    num = lambda i: g(i).try_cast("double")
    one = lambda i, minus: (num(i) + num(i + 1) / 60 + num(i + 2) / 3600) * F.when(g(i + 3) == minus, -1).otherwise(1)
    ok = F.rlike(text, F.lit(pattern))
    return F.when(ok, one(1, "S")), F.when(ok, one(5, "W"))
