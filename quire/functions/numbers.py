"""Number, option and identifier rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that ask for automatic or full-coverage page counts.
AUTO_WORDS = ("auto", "codex", "codex-auto", "codex-local", "local-codex", "本地codex", "自动")
COVERAGE_WORDS = ("full", "complete", "full-coverage", "complete-coverage", "full-book", "complete-book", "完整", "完整绘本", "尽可能完整")
TRUE_WORDS = ("1", "true", "yes", "on")
FALSE_WORDS = ("0", "false", "no", "off")


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity on doubles; null counts as 0."""
    scale = float(10**digits)
    return F.floor(F.coalesce(x.cast("double"), F.lit(0.0)) * scale + 0.5) / scale


def half_up_int(x: Column) -> Column:
    return F.floor(x.cast("double") + 0.5).cast("long")


def clamp(x: Column, low: int, high: int) -> Column:
    """Rounded and held between bounds; missing or 0 counts as the lower one."""
    rounded = half_up_int(F.coalesce(F.nullif(x.cast("double"), F.lit(0.0)), F.lit(float(low))))
    return F.least(F.lit(high).cast("long"), F.greatest(F.lit(low).cast("long"), rounded))


def spread_count(x: Column, fallback: int = 3, low: int = 1, high: int = 8, instead: Column | None = None) -> Column:
    """A page count option: text that is no number, or none at all, gives the fallback, or ``instead``; blank text counts as 0."""
    text = F.trim(x.cast("string"))
    number = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    valid = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(valid, clamp(number, low, high)).otherwise(clamp(F.lit(fallback) if instead is None else instead, low, high))


def flag(x: Column, default: bool = False) -> Column:
    word = F.lower(F.trim(x.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(default)


def positive_integer(x: Column, fallback: int) -> Column:
    number = F.trim(x.cast("string")).try_cast("double")
    return F.when(number >= 1, F.floor(number).cast("long")).otherwise(F.lit(fallback).cast("long"))


def is_auto(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin(*AUTO_WORDS)


def is_full_coverage(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin(*COVERAGE_WORDS)


def hash32(s: Column) -> Column:
    """The 31-polynomial hash of a text's UTF-16 units, in 32 signed bits."""
    units = F.encode(s, "UTF-16BE")
    at = F.sequence(F.lit(1), F.octet_length(units).cast("int") - 1, F.lit(2))
    unit = lambda i: F.conv(F.hex(F.substring(units, i, F.lit(2))), 16, 10).cast("long")
    total = F.aggregate(at, F.lit(0).cast("long"), lambda h, i: (h * 31 + unit(i)).bitwiseAND(0xFFFFFFFF))
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total)).cast("long")


def ocr_progress(done: Column, total: Column) -> Column:
    """Progress from 9 to 17 while pages are read."""
    some = (F.coalesce(total, F.lit(0)) > 0) & (F.coalesce(done, F.lit(0)) > 0)
    return F.when(some, F.greatest(F.lit(9), F.least(F.lit(17), 9 + half_up_int(done / total * 8)))).otherwise(9).cast("long")


def book_progress(image_progress: Column) -> Column:
    """Progress of the whole from that of its images: from 20, at most 98."""
    return F.least(F.lit(98), 20 + half_up_int(image_progress * 0.78)).cast("long")
