"""Link extraction and link identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a link, and how long its part after '//' is.
LINK_PATTERN = r"(https?://[\w./]*\w{1})"
MIN_AFTER_SLASHES = 6


def extract_links(text: Column) -> Column:
    """All links of a text, in order, repeats kept.

    A link ends at the first character outside ``[A-Za-z0-9_./]``; it is kept
    when more than five characters follow ``//``. Null text gives no link.
    """
    found = F.regexp_extract_all(text, F.lit(LINK_PATTERN), F.lit(1))
    return F.filter(
        found,
        lambda link: F.length(F.substring_index(link, "://", -1)) >= MIN_AFTER_SLASHES,
    )


def link_key(link: Column) -> Column:
    """Stable 60-bit id of a link, from the leading hex digits of its md5."""
    return F.conv(F.substring(F.md5(link), 1, 15), 16, 10).cast("long")


def compose_link_id(link: Column, ident: Column) -> Column:
    """``link#id``; a null part is left out."""
    return F.concat_ws("#", link, ident.cast("string"))


def split_link_key(composed: Column) -> Column:
    """The id after the first ``#``, as text; null when there is none.

    Deviation: without ``#`` the original returned the whole text.
    """
    at = F.instr(composed, "#")
    return F.when(at > 0, F.substring(composed, at + 1, F.length(composed)))


def split_link(composed: Column) -> Column:
    """The link before the first ``#``; unchanged when there is none.

    Deviation: without ``#`` the original dropped the last character.
    """
    at = F.instr(composed, "#")
    return F.when(at > 0, F.substring(composed, F.lit(1), at - 1)).otherwise(composed)
