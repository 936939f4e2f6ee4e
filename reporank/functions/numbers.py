"""Rounding by the exact binary value of a double.

``F.round`` rounds the shortest decimal text of a double, so 0.00015 (which is a
little less than it looks) becomes 0.0002. These functions look at the value.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is_tie(value, digits):
    """True for a double exactly halfway between two numbers of ``digits`` decimals."""
    return F.pmod(value * 2.0 ** (digits + 1), F.lit(2.0)) == 1


def _text(value, digits):
    """Decimal text of the nearest number of ``digits`` decimals, ties to even."""
    pattern = "0." + "0" * digits if digits else "0"
    shown = F.call_function("format_number", value, F.lit(pattern))
    smallest = 10.0**-digits  # the formatter drops what is below one unit, even from a half on
    below = (F.abs(value) >= smallest / 2) & (F.abs(value) < smallest)
    unit = F.call_function("format_number", F.signum(value) * smallest, F.lit(pattern))
    return F.when(below, unit).otherwise(shown)


def round_even(value, digits: int) -> Column:
    """Nearest number of ``digits`` decimals, exact ties to the even one.

    Arithmetic decides, except next to a tie, where scaling may have rounded: there, and for
    numbers too large to scale, the decimal text does.
    """
    scaled = value * 10.0**digits
    unsure = (F.abs(F.pmod(scaled, F.lit(1.0)) - 0.5) < 1e-6) | ~(F.abs(scaled) < 1e9)
    exact = F.rint(scaled) / F.lit(10.0**digits)
    return F.when(unsure, _text(value, digits).cast("double")).otherwise(exact) + F.lit(0.0)


def _lifted(value, digits):
    scale = 10.0**digits
    up = (F.floor(value * scale) + 1) / F.lit(scale)
    return F.when(_is_tie(value, digits), up).otherwise(value)


def round_up(value, digits: int) -> Column:
    """Nearest number of ``digits`` decimals, exact ties to the larger one."""
    return round_even(_lifted(value, digits), digits)


def fixed_text(value, digits: int) -> Column:
    """Text with ``digits`` decimals, exact ties to the larger number."""
    return _text(_lifted(value, digits), digits)
