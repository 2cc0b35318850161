"""Amounts: how a number is written and what a benefit saves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V

RATE_TYPES = ("percent", "cashback")
FLAT_TYPES = ("fixed", "gift_card")


def number_text(x: Column) -> Column:
    """A double written without a trailing ``.0`` and without an exponent."""
    plain = F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"0+$", "")
    return (
        F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string"))
        .when((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7), x.cast("string"))
        .otherwise(plain)
    )


def shekels(x: Column) -> Column:
    """₪ amount: whole numbers bare, others with two decimals."""
    return F.concat(
        F.lit("₪"),
        F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(
            F.format_string("%.2f", x)
        ),
    )


def to_cents(x: Column) -> Column:
    """Half-up to two decimals."""
    return F.floor(x * 100 + 0.5) / 100


def _capped_rate(amount: Column, value: Column, cap: Column) -> Column:
    raw = amount * value / 100
    return F.when(cap.isNotNull(), F.least(raw, cap)).otherwise(raw)


def saving_estimate(type_: Column, value: Column, min_spend: Column, cap: Column, cart: Column) -> Column:
    """ILS saved on the cart, or on a reference basket when the cart is unknown."""
    basket = F.coalesce(
        cart, F.greatest(F.coalesce(min_spend, F.lit(0.0)), F.lit(V.REFERENCE_BASKET))
    )
    raw = (
        F.when(type_.isin(*RATE_TYPES), _capped_rate(basket, value, cap))
        .when(type_.isin(*FLAT_TYPES), value)
        .when(type_ == "bogo", basket / 2)
        .otherwise(F.lit(0.0))
    )
    return to_cents(raw)


def saving_is_estimate(type_: Column, cart: Column) -> Column:
    return (
        F.when(type_.isin(*FLAT_TYPES), False).when(type_ == "bogo", True).otherwise(cart.isNull())
    )


def saving_on(type_: Column, value: Column, cap: Column, amount: Column) -> Column:
    """What one offer takes off a running amount."""
    return (
        F.when(amount <= 0, F.lit(0.0))
        .when(type_.isin(*RATE_TYPES), _capped_rate(amount, value, cap))
        .when(type_.isin(*FLAT_TYPES), F.least(value, amount))
        .otherwise(F.lit(0.0))
    )


def figure(type_: Column, value: Column) -> Column:
    return (
        F.when(type_.isin(*RATE_TYPES), F.concat(number_text(value), F.lit("%")))
        .when(type_.isin(*FLAT_TYPES), F.concat(F.lit("₪"), number_text(value)))
        .when(type_ == "bogo", F.lit(V.BOGO_FIGURE))
        .otherwise(F.lit(V.UNKNOWN_FIGURE))
    )


def unit(type_: Column) -> Column:
    return (
        F.when(type_.isin("percent", "fixed"), F.lit(V.UNIT_DISCOUNT))
        .when(type_ == "cashback", F.lit(V.UNIT_CREDIT))
        .when(type_ == "gift_card", F.lit(V.UNIT_GIFT))
        .when(type_ == "bogo", F.lit(V.BOGO_UNIT))
        .otherwise(F.lit(V.UNKNOWN_UNIT))
    )


def headline(type_: Column, value: Column) -> Column:
    """One-line form of an offer for notifications."""
    return (
        F.when(type_ == "bogo", F.lit(V.BOGO_FIGURE))
        .when(
            type_.isin(*RATE_TYPES, *FLAT_TYPES),
            F.concat_ws(" ", figure(type_, value), unit(type_)),
        )
        .otherwise(F.lit(V.UNKNOWN_UNIT))
    )


def saving_text(saving: Column, is_estimate: Column) -> Column:
    word = F.when(is_estimate, F.lit(V.SAVING_ESTIMATE_WORD)).otherwise(F.lit(V.SAVING_WORD))
    return F.concat(word, F.lit(" ₪"), F.floor(saving + 0.5).cast("bigint").cast("string"))


def offer_text(type_: Column, value: Column) -> Column:
    return F.concat(
        number_text(value), F.when(type_.isin(*RATE_TYPES), F.lit("%")).otherwise(F.lit(" ₪"))
    )
