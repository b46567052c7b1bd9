"""Small scalar functions of the viewer: labels, escapes, names, themes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNTITLED, LABEL_LIMIT, LABEL_CUT, NAME_SEPARATOR = "(untitled)", 64, 61, ", "


def or_else(value: Column, default: str) -> Column:
    """``value``, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def label(title: Column) -> Column:
    """The title, cut to 61 code points and '...' where it has over 64."""
    text = or_else(title, UNTITLED)
    return F.when(F.length(text) > LABEL_LIMIT, F.concat(F.substring(text, 1, LABEL_CUT), F.lit("..."))).otherwise(text)


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def split_names(names: Column) -> Column:
    """The parts of a merged tag name; none of a null or empty one."""
    return F.when(F.length(names) > 0, F.split(names, NAME_SEPARATOR)).otherwise(F.array().cast("array<string>"))


def is_dark(color: Column) -> Column:
    """Whether #rrggbb has a luminance below 128; no colour, or one that can't be read, isn't dark.

    The weights are thousandths, so whole numbers decide: sums of doubles miss a luminance of exactly 128.
    """
    channel = lambda at: F.conv(F.substring(color, at, 2), 16, 10).cast("int")
    luminance = channel(2) * 299 + channel(4) * 587 + channel(6) * 114
    return F.coalesce(F.when(color.rlike(r"^#[0-9A-Fa-f]{6}"), luminance < 128_000), F.lit(False))
