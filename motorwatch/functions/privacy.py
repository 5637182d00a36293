"""Masking of personal data in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is masked, in this order, and by which token. The vehicle number goes
# first so that no later pattern eats part of it; bare digit runs go last. The phone pattern
# opens with a look at one character, which turns most positions of a text away at once.
VIN = r"\b(?=[A-HJ-NPR-Z0-9]*\d)[A-HJ-NPR-Z0-9]{17}\b"
PHONE = r"(?=[+(\d])(?<!\d)(?:\+?1[-.\s]?)?\(?\b\d{3}\b\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
LONG_NUMBER = r"\d{8,}"
MASKS = (("vin", VIN, "[VIN]"), ("phone", PHONE, "[PHONE]"), ("email", EMAIL, "[EMAIL]"), ("digits", LONG_NUMBER, "[NUM]"))


def _mask(masked_so_far: Column, original: Column, pattern: str, token: str) -> Column:
    masked = F.regexp_replace(masked_so_far, pattern, token)
    if pattern != EMAIL:
        return masked
    # Few texts hold an @, and looking for one is much cheaper than looking for an address.
    # The earlier steps neither add nor remove any, so the original text tells as well.
    return F.when(F.contains(original, F.lit("@")), masked).otherwise(masked_so_far)


def mask_personal(text: Column | str) -> Column:
    """Replace vehicle numbers, phones, e-mails and long digit runs; NULL stays NULL."""
    original = out = F.col(text) if isinstance(text, str) else text
    for _, pattern, token in MASKS:
        out = _mask(out, original, pattern, token)
    return out


def mask_tallies(text: Column | str) -> dict[str, Column]:
    """How many of each class were masked, each counted on the text the earlier steps left."""
    original = out = F.col(text) if isinstance(text, str) else text
    tallies = {}
    for name, pattern, token in MASKS:
        tallies[f"n_{name}"] = F.coalesce(F.regexp_count(out, F.lit(pattern)), F.lit(0))
        out = _mask(out, original, pattern, token)
    return tallies
