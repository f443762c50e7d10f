"""Exact decimal cost of calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COST = "decimal(20,10)"


def cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """(tokens * price per million) / 10**6 in decimals wide enough to be exact; null if unpriced."""
    tokens = lambda c: c.cast("decimal(12,0)")
    price = lambda c: c.cast("decimal(12,6)")
    total = tokens(input_tokens) * price(input_price) + tokens(output_tokens) * price(output_price)
    return (total / F.lit(1_000_000).cast("decimal(7,0)")).cast(COST)
