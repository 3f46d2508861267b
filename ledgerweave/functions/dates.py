"""Dates as they appear on invoices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def invoice_date(c: Column) -> Column:
    """Date of the first ten characters, in one of three formats."""
    t = F.left(F.trim(c), F.lit(10))
    return F.coalesce(*[F.try_to_date(t, f) for f in ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy")])


def repaired_date(c: Column) -> Column:
    """O, I, l and S read as digits; points and dashes as slashes."""
    return F.translate(F.trim(F.coalesce(c, F.lit(""))), "OIlS.-", "0115//")


def repaired_digits_in_date(c: Column) -> Column:
    """O and z between digits read 0 and 2."""
    return F.regexp_replace(F.regexp_replace(c, r"(\d)[oO](\d)", "$10$2"), r"(\d)[zZ](\d)", "$12$2")


def _parts(c: Column) -> tuple[Column, Column, Column]:
    shape = r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})\s*$"
    # blank where the shape is not met: a cast of a blank text costs an exception a row
    return tuple(F.nullif(F.regexp_extract(c, shape, i), F.lit("")).try_cast("int") for i in (1, 2, 3))


def validated_date(c: Column, as_of: Column) -> Column:
    """D3: dd/MM/yyyy of a day-month-year text; a date that does not exist or lies after next year is null. A swapped day
    and month are set right as they are written, whatever their year."""
    d, m, y = _parts(c)
    shape = r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})\s*$"
    swapped = F.when((m > 12) & (d <= 12), F.regexp_replace(c, shape, "$2/$1/$3"))
    real = F.when(d.between(1, 31) & m.between(1, 12), F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))
    ok = (d <= 31) & (m <= 12) & real.isNotNull() & (y <= F.year(as_of) + 1)
    return F.when(d <= 31, F.coalesce(swapped, F.when(ok, F.format_string("%02d/%02d/%d", d, m, y))))


def checked_expiry(c: Column) -> Column:
    """dd/MM/yyyy padded when its parts are in range (1990-2100), else as it is."""
    d, m, y = _parts(c)
    ok = d.between(1, 31) & m.between(1, 12) & y.between(1990, 2100)
    return F.when(ok, F.format_string("%02d/%02d/%d", d, m, y)).otherwise(c)


def is_date_like(c: Column) -> Column:
    """a numeric date, or 6 to 8 digits."""
    return F.coalesce(F.regexp_like(F.trim(c), F.lit(r"^(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{6,8})$")), F.lit(False))
