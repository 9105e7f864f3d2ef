"""Rules that decide which fills may set a price."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of a stored price, and the rounding bound of integer amounts.
PRICE_FLOOR = 1e-12
PRICE_CEILING = 1e24 - 1
BOUND_MARGIN = 1000
BOUND_PRODUCT = 1_000_000
SCALE = 14
STORED = "decimal(38,14)"
#: The largest value of that type.
STORED_CEILING = "9" * 24 + "." + "9" * 14
PCT = "decimal(10,4)"


def stored(c: Column) -> Column:
    """A value as tables keep it; what is out of range is the sentinel 0."""
    return F.coalesce(c.try_cast(STORED), F.lit(0).cast(STORED))


def rounding_bound(a: Column, b: Column) -> Column:
    """Do two integer amounts give a price to within a tenth of a per cent?  Divided, so that no product overflows; in
    doubles, which hold every integer that is near a bound."""
    x, y = a.cast("double") - BOUND_MARGIN, b.cast("double") - BOUND_MARGIN
    return F.when((x > 0) & (y > 0), x >= F.ceil(F.lit(float(BOUND_PRODUCT)) / y)).otherwise(False)


def price_survives(p: Column) -> Column:
    """Is the price still a price after rounding to the stored scale?"""
    above = F.when(p >= 10 * PRICE_FLOOR, True).otherwise(F.round(p, SCALE) >= PRICE_FLOOR)  # rounding is slow and matters near the floor
    return F.coalesce(above & (p < 1e24), F.lit(False))


def price_forming(offer_priced: Column, a: Column, b: Column, p: Column) -> Column:
    """Offers state their price; the others need amounts large enough to imply one."""
    return (offer_priced | rounding_bound(a, b)) & price_survives(p)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 where b is 0, the sentinel for no price."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def zero(c: Column) -> Column:
    """The stored sentinel for what is missing."""
    return F.coalesce(c, F.lit(0.0))


def gated(close: Column, forming: Column) -> Column:
    """May a candle lend its prices to a coarser one?"""
    return (forming > 0) & (close >= PRICE_FLOOR)
