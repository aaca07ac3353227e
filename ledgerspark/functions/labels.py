"""Label vocabulary: category weights, bands, exchange names, confidence levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity weight by category keyword; the first keyword contained wins.
CATEGORY_WEIGHTS = [
    ("sanction", 35.0),
    ("ransomware", 30.0),
    ("darknet", 28.0),
    ("mixer", 24.0),
    ("scam", 22.0),
    ("fraud", 20.0),
    ("high_risk_exchange", 16.0),
    ("exchange", 8.0),
]
DEFAULT_CATEGORY_WEIGHT = 10.0

# Lower bound of each band, highest first.
RISK_BANDS = [(75.0, "critical"), (50.0, "high"), (25.0, "medium")]

# Keyword in a lower-cased name -> exchange; the first keyword contained wins.
EXCHANGE_NAMES = [
    ("huobi", "Huobi"),
    ("binance", "Binance"),
    ("coinbase", "Coinbase"),
    ("kraken", "Kraken"),
    ("bitfinex", "Bitfinex"),
    ("okx", "OKX"),
    ("poloniex", "Poloniex"),
    ("kucoin", "KuCoin"),
    ("bybit", "Bybit"),
    ("bitstamp", "Bitstamp"),
    ("gemini", "Gemini"),
    ("bittrex", "Bittrex"),
    ("bitmex", "BitMEX"),
    ("gate.io", "Gate.io"),
    ("htx", "Huobi"),
    ("gate", "Gate.io"),
    ("bitget", "Bitget"),
    ("mexc", "MEXC"),
]

# Compliance mailbox by exchange.
COMPLIANCE_MAIL = [
    ("Huobi", "compliance@huobi.com"),
    ("Binance", "law_enforcement@binance.com"),
    ("Coinbase", "compliance@coinbase.com"),
    ("Kraken", "compliance@kraken.com"),
    ("Poloniex", "support@poloniex.com"),
    ("OKX", "compliance@okx.com"),
    ("Bybit", "compliance@bybit.com"),
    ("Bitstamp", "legal@bitstamp.net"),
    ("Bitfinex", "compliance@bitfinex.com"),
    ("Gate.io", "compliance@gate.io"),
]

# Note by attribution source.
SOURCE_NOTES = [
    ("exchange-intel/wallet_label",
     "Address attribution was provided by the BTC Exchange Intel Agent using an external wallet-label source."),
    ("exchange-intel/seed",
     "Address attribution was provided by the local BTC Exchange Intel Agent using a curated exchange seed."),
    ("exchange-intel/official_por",
     "Address attribution was provided by the local BTC Exchange Intel Agent "
     "using an official proof-of-reserves dataset."),
    ("exchange-intel/public_dataset",
     "Address attribution was provided by the BTC Exchange Intel Agent using a public address dataset."),
    ("exchange-intel/public_tagpack",
     "Address attribution was provided by the BTC Exchange Intel Agent using a public tag pack."),
    ("exchange-intel/community_label",
     "Address attribution was provided by the BTC Exchange Intel Agent using a public community source."),
    ("exchange-intel/address_lookup",
     "Address attribution was provided by the BTC Exchange Intel Agent "
     "through live address resolution against an external source."),
    ("local-db/EXCHANGE_INTEL",
     "Address attribution was loaded locally from a previously verified BTC Exchange Intel Agent result."),
    ("manual", "Exchange attribution was manually confirmed and entered by the analyst."),
]

# Labels counted as high risk in the binary evaluation.
POSITIVE_LABELS = ["high_risk", "sanctioned", "scam", "ransomware", "darknet"]


def first_match(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """An ordered CASE expression."""
    chain = reduce(lambda acc, case: acc.when(*case), cases, F)
    return chain.otherwise(otherwise)


def category_weight(category: Column) -> Column:
    lowered = F.lower(category)
    return first_match(
        [(lowered.contains(word), F.lit(weight)) for word, weight in CATEGORY_WEIGHTS],
        F.lit(DEFAULT_CATEGORY_WEIGHT),
    )


def reason_code(category: Column) -> Column:
    return F.concat(F.lit("EXPOSURE_TO_"), F.translate(F.upper(category), " -", "__"), F.lit("_ENTITY"))


def risk_band(score: Column) -> Column:
    return first_match([(score >= bound, F.lit(band)) for bound, band in RISK_BANDS], F.lit("low"))


def canonical_exchange_name(name: Column) -> Column:
    lowered = F.lower(name)
    return first_match([(lowered.contains(word), F.lit(label)) for word, label in EXCHANGE_NAMES], name)


def compliance_contact(name: Column) -> Column:
    squeezed = F.translate(F.lower(name), " .", "")
    return first_match(
        [(name == exchange, F.lit(mail)) for exchange, mail in COMPLIANCE_MAIL],
        F.concat(F.lit("compliance@"), squeezed, F.lit(".com")),
    )


def source_note(source: Column) -> Column:
    return first_match(
        [(source == key, F.lit(note)) for key, note in SOURCE_NOTES],
        F.concat(F.lit("Identified via "), source, F.lit(".")),
    )


def source_type_confidence(source_type: Column) -> Column:
    return F.when(source_type.isin("official_por", "seed"), "L1").otherwise("L2")


def is_evidential(exchange: Column, source: Column, confidence: Column) -> Column:
    """An exchange attribution that may carry a report: named, not inferred downstream, level 1 or 2."""
    return F.coalesce(
        (F.coalesce(exchange, F.lit("")) != "")
        & ~F.coalesce(source, F.lit("")).startswith("downstream-analysis")
        & confidence.isin("L1", "L2"),
        F.lit(False),
    )


def short_address(address: Column, left: int = 10, right: int = 6) -> Column:
    return (
        F.when(F.coalesce(address, F.lit("")) == "", F.lit("—"))
        .when(F.length(address) <= left + right + 1, address)
        .otherwise(F.concat(F.substring(address, 1, left), F.lit("…"), F.right(address, F.lit(right))))
    )


def is_positive_label(label: Column) -> Column:
    return label.isin(*POSITIVE_LABELS)
