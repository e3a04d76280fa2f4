"""Text columns. Character classes follow Unicode, as the patterns' users expect of any language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.functions.columns import as_column

# Letters, digits and underscore of any script; valid in Java and RE2 alike.
WORD = r"\p{L}\p{N}_"
# Every Unicode blank, including the four ASCII separators Java leaves out.
BLANK = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# The same blanks, and what is neither word, blank nor kept sign, for scanning long texts: common letters fail the
# first, cheap test of the intersection (Java only).
_BLANKS = rf"[\x00-\x20\x7f-\x{{10ffff}}&&[{BLANK}]]"
_SYMBOLS = rf"[\x00-\x1f!-@\[-`{{-\x{{10ffff}}&&[^{WORD}{BLANK}.,!?-]]"


def strip_blanks(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), f"^[{BLANK}]+|[{BLANK}]+$", "")


def collapse_blanks(text: Column | str) -> Column:
    """Every run of blanks becomes one space; none at either end."""
    return F.trim(F.regexp_replace(as_column(text), f"{_BLANKS}+", " "))


def keep_plain_characters(text: Column | str) -> Column:
    """Drop all but word characters, blanks and ``. , ! ? -``."""
    return F.regexp_replace(as_column(text), f"{_SYMBOLS}+", "")


def clean_text(text: Column | str) -> Column:
    """NULL to empty, blanks collapsed, symbols dropped, trimmed.

    Symbols go after the blanks were collapsed, so a symbol standing alone leaves two spaces.
    """
    return F.trim(keep_plain_characters(collapse_blanks(F.coalesce(as_column(text), F.lit("")))))


def has_clean_text(text: Column | str) -> Column:
    """Whether :func:`clean_text` leaves anything, without cleaning: one character to keep is enough."""
    return F.coalesce(as_column(text).rlike(f"[{WORD}.,!?-]"), F.lit(False))


def trim_lower(text: Column | str) -> Column:
    return F.lower(strip_blanks(text))


def trim_title(text: Column | str) -> Column:
    return F.initcap(strip_blanks(text))


def tokens(text: Column | str, lowercase: bool = True) -> Column:
    """Array of the text's words, in order; empty for NULL."""
    column = F.coalesce(as_column(text), F.lit(""))
    if lowercase:
        column = F.lower(column)
    return F.regexp_extract_all(column, F.lit(f"[{WORD}]+"), F.lit(0))


def preview(text: Column | str, width: int = 80) -> Column:
    """The first ``width`` characters, with ``...`` when something was cut."""
    column = as_column(text)
    return F.when(F.length(column) > width, F.concat(F.substring(column, 1, width), F.lit("..."))).otherwise(column)
