"""Token usage, prices and failures of requests."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of HTTP statuses of failed requests; a transient one may be tried again.
STATUS_CODES = {
    401: "unauthenticated",
    403: "forbidden",
    408: "request_timeout",
    429: "rate_limited",
    500: "dependency_failure",
    502: "dependency_failure",
    503: "dependency_overloaded",
    504: "request_timeout",
    529: "dependency_overloaded",
}
TRANSIENT = (408, 429, 500, 502, 503, 504, 529)


@dataclass(frozen=True)
class Price:
    """Prices of a million tokens; without a cached price, cached input costs what input costs."""

    input: Decimal
    output: Decimal
    cached: Decimal | None = None


@dataclass(frozen=True)
class Pricing:
    base: Price
    long_context: Price | None = None
    threshold: int | None = None
    reasoning_as_input: bool = False


def request_cost(pricing: Pricing, input_tokens: Column, output_tokens: Column, cached: Column, reasoning: Column) -> Column:
    """Cost of one request as decimal(38,12): the tier follows its input tokens; NULL if a needed count is unknown."""

    def tier(p: Price) -> Column:
        # narrow decimals, and a product for the division: their result keeps all twelve places
        price = lambda d: F.lit(str(d)).cast("decimal(12,6)")
        whole = lambda c: c.cast("decimal(13,0)")
        hit = cached if p.cached is not None else F.lit(0)
        thought = reasoning if pricing.reasoning_as_input else F.lit(0)
        total = whole(input_tokens - hit + thought) * price(p.input) + whole(hit) * price(p.cached if p.cached is not None else p.input) + whole(output_tokens - thought) * price(p.output)
        return (total * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(38,12)")

    if pricing.long_context is None:
        return tier(pricing.base)
    return F.when(input_tokens > pricing.threshold, tier(pricing.long_context)).when(input_tokens <= pricing.threshold, tier(pricing.base))


def reported(counts: Column, details: Column) -> Column:
    """A reported count; a zero that only the details hold is unknown."""
    return F.coalesce(counts, F.nullif(details, F.lit(0)))


def failure_code(status: Column) -> Column:
    """Code of a failed HTTP status."""
    out = F.when(status.isNull() | (status < 400), F.lit(None).cast("string"))
    for k, code in STATUS_CODES.items():
        out = out.when(status == k, code)
    return out.when((status < 500) & (status != 404), "request_rejected").otherwise("dependency_failure")


def retryable(status: Column) -> Column:
    return F.coalesce(status.isin(*TRANSIENT), F.lit(False))


def total_or_unknown(value: Column) -> Column:
    """A sum that is unknown as soon as one part is."""
    return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))
