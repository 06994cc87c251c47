"""Money rules. Ledger money is DECIMAL(18,2); input is read wide and rounded on purpose."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from donorlake import fixed_values as fixed
from donorlake.functions.text import look_up
from donorlake.schemas import MONEY, WIDE_MONEY

# A decimal number as a whole text, with an optional exponent.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """Decimal value of a text, or null if the text is not exactly a number."""
    return F.when(text.rlike(_NUMBER), text.try_cast(WIDE_MONEY))


def from_minor(units: Column) -> Column:
    """Whole minor units (pence, cents) to major units."""
    return (units.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast(MONEY)


def max_amount(currency: Column) -> Column:
    """Largest accepted contribution in major units."""
    return look_up(currency, fixed.MAX_AMOUNT, fixed.DEFAULT_MAX_AMOUNT)


def capped_paypal_amount(amount: Column, currency: Column) -> Column:
    """Cap first, then two decimals half up."""
    wide = amount.cast(WIDE_MONEY)
    return F.round(F.least(wide, max_amount(currency).cast(WIDE_MONEY)), 2).cast(MONEY)


def capped_stripe_minor(amount: Column, currency: Column) -> Column:
    """Minor units cut toward zero, then capped. 64-bit throughout, so that no amount can wrap around the cap."""
    units = (amount.cast(WIDE_MONEY) * F.lit(100)).cast("bigint")
    return F.least(units, max_amount(currency).cast("bigint") * 100)


def show_amount(amount: Column, currency: Column) -> Column:
    """Two decimals followed by the currency, as in ``25.00GBP``."""
    return F.concat(F.round(amount, 2).cast(MONEY).cast("string"), currency)


def amount_part(text: Column) -> Column:
    """Number of an amount text whose last three characters are a known currency; null if either part is bad."""
    digits = F.substring(text, F.lit(1), F.greatest(F.length(text) - 3, F.lit(0)))
    return F.when(currency_part(text).isNotNull(), number(digits))


def currency_part(text: Column) -> Column:
    code = F.right(text, F.lit(3))
    return F.when(code.isin(*fixed.KNOWN_CURRENCIES), code)


def known_currency(text: Column) -> Column:
    """Upper-cased currency if it is a known one, else null."""
    code = F.upper(text)
    return F.when(code.isin(*fixed.KNOWN_CURRENCIES), code)


def display_amount(value: Column) -> Column:
    """Display rounding: two decimals (a whole number stays whole in value)."""
    return F.round(value, 2).cast(MONEY)


def progress_shift(total: Column, goal: Column) -> Column:
    """Whole percent by which a progress bar is shifted left: -100 at nothing, 0 at the goal or beyond."""
    capped = F.least(total.cast("double"), goal.cast("double"))
    return F.floor(F.try_divide(capped, goal.cast("double")) * 100 - 100).cast("bigint")
