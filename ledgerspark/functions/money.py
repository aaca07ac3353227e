"""Amounts and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SATS_PER_BTC = 100_000_000


def btc_to_sats(btc: Column) -> Column:
    """BTC to whole sats, half up, NULL-safe; text and decimals keep every digit."""
    return F.round(btc.cast("decimal(20,10)") * F.lit(SATS_PER_BTC), 0).cast("bigint")


def sats_to_btc(sats: Column) -> Column:
    return sats / F.lit(float(SATS_PER_BTC))


def round_half_up(value: Column, digits: int) -> Column:
    """Decimal rounding, so that ties do not depend on binary representation."""
    return F.round(value.cast("decimal(28,12)"), digits).cast("double")


def btc_text(btc: Column) -> Column:
    """Eight fixed decimals."""
    return F.format_string("%.8f", btc.cast("double"))
