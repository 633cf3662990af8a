"""Column expressions: cleaning, parsing and labels. All run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.config import DATETIME_FORMATS, DEFAULT, FALSE_WORDS, PLACEHOLDERS, TRUE_WORDS, Config

# Shapes of numbers, formatted numbers, addresses, links and phone numbers.
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$|^\s*[-+]?(?i:inf|infinity)\s*$"
FORMATTED_NUMBER = r"^[-+]?[$€£₹¥]?\s?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?\s?%?$"
FORMATTING_CHARS = r"[,$€£₹¥%\s]"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
URL = r"^(https?://|www\.)\S+$"
PHONE = r"^\+?[\d\s\-().]{7,20}$"
PHONE_SEPARATOR = r"[\s\-()+]"
LEADING_ZERO = r"^0\d+$"
TOKEN = r"[a-z']{3,}"


def strip(c: Column) -> Column:
    """Without whitespace of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_placeholder(c: Column) -> Column:
    """Blank, or one of the tokens that mean missing; null for null."""
    key = F.lower(strip(c))
    return key.isin(*PLACEHOLDERS) | (key == "")


def without_placeholders(c: Column) -> Column:
    return F.when(~is_placeholder(c), c)


def parse_plain(c: Column) -> Column:
    """A number as it stands, else null."""
    return F.when(c.rlike(NUMBER), strip(c).try_cast("double"))


def parse_formatted(c: Column) -> Column:
    """A number with currency sign, thousands separators or percent sign; the percent sign doesn't scale."""
    return F.when(strip(c).rlike(FORMATTED_NUMBER), F.regexp_replace(c, FORMATTING_CHARS, "").try_cast("double"))


def parse_boolean(c: Column) -> Column:
    key = F.lower(strip(c))
    return F.when(key.isin(*TRUE_WORDS), True).when(key.isin(*FALSE_WORDS), False)


def parse_datetime(c: Column, name: str | None) -> Column:
    """By the stored format; 'mixed' or None takes the first format that parses, then ISO text."""
    if name in (None, "mixed"):
        ways = [F.try_to_timestamp(c, F.lit(p)) for _, p in DATETIME_FORMATS] + [c.try_cast("timestamp")]
        return F.coalesce(*ways).cast("timestamp_ntz")
    return F.try_to_timestamp(c, F.lit(dict(DATETIME_FORMATS)[name])).cast("timestamp_ntz")


def missing_level(pct: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(pct <= 0, "none").when(pct < cfg.missing_low, "low").when(pct < cfg.missing_moderate, "moderate").when(pct < cfg.missing_high, "high").otherwise("very_high")


def skew_class(skew: Column, cfg: Config = DEFAULT) -> Column:
    side = F.when(skew > 0, "right").otherwise("left")
    size = F.abs(skew)
    label = F.when(size < cfg.skew_symmetric, "approximately symmetric").when(size < cfg.skew_strong, F.concat(F.lit("moderately "), side, F.lit("-skewed"))).otherwise(F.concat(F.lit("strongly "), side, F.lit("-skewed")))
    return F.when(skew.isNotNull() & ~F.isnan(skew), label)


def strength_band(r: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(F.abs(r) < cfg.corr_low, "low").when(F.abs(r) < cfg.corr_high, "moderate").otherwise("high")


def cardinality_class(n: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(n <= cfg.card_low, "low").when(n <= cfg.card_high, "medium").otherwise("high")


def bias_corrected_skew(c: Column, n: Column) -> Column:
    """Sample skewness from the population one; null below 3 values or without spread."""
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))


def bias_corrected_kurtosis(c: Column, n: Column) -> Column:
    """Sample excess kurtosis from the population one; null below 4 values or without spread."""
    return F.when((n > 3) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)).cast("double") * ((n + 1) * F.kurtosis(c) + 6))


def cyclical(value: Column, period: int) -> tuple[Column, Column]:
    angle = value.cast("double") * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)
