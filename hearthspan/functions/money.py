"""Purchase-cost arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 1e18
# Upper bound of each band and its rate.
STANDARD = [(125_000, 0.0), (250_000, 0.02), (925_000, 0.05), (1_500_000, 0.10), (TOP, 0.12)]
FIRST_TIME = [(300_000, 0.0), (500_000, 0.05)]
NON_RESIDENTIAL = [(150_000, 0.0), (250_000, 0.02), (TOP, 0.05)]
FIRST_TIME_CEILING = 500_000
# Band edges tried beside the solved prices.
EDGES, FIRST_TIME_EDGES = (125_000, 250_000, 925_000), (300_000, 500_000)
FEES, BUFFER = 6_000, 15_000
ASSUMED_RATE, ASSUMED_TERM = 5.25, 30
NINTHS_OF_D = {"B": 7, "C": 8, "D": 9, "E": 11, "F": 13, "G": 15}


def banded(price: Column, bands) -> Column:
    """Progressive tax: each band taxes only the slice of the price inside it."""
    tax, low = F.lit(0.0), 0.0
    for high, rate in bands:
        tax = tax + F.greatest(F.lit(0.0), F.least(price.cast("double"), F.lit(float(high))) - low) * rate
        low = float(high)
    # half to even
    return F.when(price.isNotNull(), F.bround(tax))


def stamp_duty(price: Column, first_time: Column) -> Column:
    """First-time relief is a cliff, not a taper."""
    return F.when(first_time & (price <= FIRST_TIME_CEILING), banded(price, FIRST_TIME)).otherwise(banded(price, STANDARD))


def monthly_payment(price: Column, deposit_pct: Column, rate_pct: Column, years: Column) -> Column:
    """Repayment mortgage. Rates outside 1..15 %, terms and deposits outside their domain use the stated defaults."""
    rate = F.when(rate_pct.isNull() | ((rate_pct > 0) & ~rate_pct.between(1, 15)), F.lit(ASSUMED_RATE)).otherwise(rate_pct)
    term = F.when(years > 0, years).otherwise(F.lit(ASSUMED_TERM))
    deposit = F.when(deposit_pct.between(0, 100), deposit_pct).otherwise(F.lit(10.0))
    loan, r, n = price * (1 - deposit / 100), rate / 1200, term * 12
    paid = F.when(r <= 0, loan / n).otherwise(loan * r / (1 - F.pow(1 + F.when(r > 0, r), -n)))
    return F.when(deposit >= 100, F.lit(0.0)).otherwise(paid)


def _solved(funds: Column, bands) -> list[Column]:
    """The whole pounds at which the line of each band meets the funds, inside the band or not."""
    out, low, tax = [], 0.0, 0.0
    for high, rate in bands:
        # funds = price + tax + (price - low) * rate
        out.append(F.floor((funds - round(tax - low * rate, 2)) / round(1 + rate, 4)))
        tax += (high - low) * rate
        low = float(high)
    return out


def _points(price: Column, bands) -> Column:
    """Tax in hundredths of a percent of a pound, unrounded: whole numbers all through."""
    taxed, low = F.lit(0), 0
    for high, rate in bands:
        taxed = taxed + F.greatest(F.lit(0), F.least(price, F.lit(int(high))) - low) * round(rate * 10_000)
        low = int(high)
    return taxed


def max_affordable(funds: Column, first_time: Column, fees: int = FEES, buffer: int = BUFFER, renovation: int = 0) -> Column:
    """Largest whole-pound price, of those that the bands' lines and edges give, whose tax, fees, renovation and buffer fit; no search.

    Whether a price fits is decided in whole numbers. A quotient rounded below a whole pound still gives the pound under it.
    """
    left = funds - (fees + buffer + renovation)
    relief = lambda p: F.when(p <= FIRST_TIME_CEILING, _points(p, FIRST_TIME)).otherwise(_points(p, STANDARD))
    best = lambda prices, tax: F.array_max(F.filter(F.array(*prices), lambda p: (p >= 0) & (tax(p) <= (left - p) * 10_000)))
    plain = best(_solved(left, STANDARD) + [F.lit(e) for e in EDGES], lambda p: _points(p, STANDARD))
    first = best(_solved(left, STANDARD) + _solved(left, FIRST_TIME) + [F.lit(e) for e in FIRST_TIME_EDGES], relief)
    return F.when(left <= 0, F.lit(0)).otherwise(F.when(first_time, first).otherwise(plain))


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
