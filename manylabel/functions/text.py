"""String expressions for cleaning free text and parsing loose fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from manylabel.functions.fixed import MAX_TEXT, NAME_REPEATS, PUNCTUATION


def strip_non_ascii(c: Column) -> Column:
    """Drop characters above 127; texts without any skip the regular expression."""
    replaced = F.regexp_replace(c, r"[^\x00-\x7F]", "")
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(replaced)


def to_lower(c: Column) -> Column:
    return F.lower(c)


def delete_chars(c: Column, chars: str = PUNCTUATION) -> Column:
    return F.translate(c, chars, "")


def squeeze_spaces(c: Column) -> Column:
    return F.when(~F.contains(c, F.lit("  ")), c).otherwise(F.regexp_replace(c, " +", " "))


def strip_urls(c: Column) -> Column:
    """Replace `` http...`` up to and including the next blank by one blank."""
    replaced = F.regexp_replace(c, r" http[^\n]*? ", " ")
    return F.when(~F.contains(c, F.lit(" http")), c).otherwise(replaced)


def truncate_words(c: Column, n: int = MAX_TEXT) -> Column:
    """Cut at the first blank at or after offset ``n``; keep the text if there is none."""
    blank = F.locate(" ", c, n + 1)
    return F.when(blank == 0, c).otherwise(F.substring(c, F.lit(1), blank - 1))


def count_char(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def too_sparse(c: Column, share: int = 4) -> Column:
    """More than one in ``share`` characters is a blank."""
    return count_char(c, " ") > F.floor(F.length(c) / share)


def parse_count(c: Column) -> Column:
    """``1,000,000+`` -> 1000000.0; no digits -> 0.0."""
    digits = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), "([0-9]+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("double"), F.lit(0.0))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L} ]", "")


def boost(name: Column, text: Column, k: int = NAME_REPEATS) -> Column:
    """Put the name ``k`` times before the text so that it weighs more."""
    filled = F.concat(F.coalesce(name, F.lit("")), F.lit(" "))
    return F.concat(F.repeat(filled, k), F.coalesce(text, F.lit("")))


def fill(c: Column, value: str = "") -> Column:
    return F.coalesce(c, F.lit(value))


def flatten_lines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def underscore(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def strip_blank(c: Column) -> Column:
    """Trim every kind of white space, tabs and line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines_to_list(c: Column) -> Column:
    """One item per line -> one ``;``-separated string."""
    return F.replace(strip_blank(c), F.lit("\n"), F.lit(";"))


def clean_characters(c: Column) -> Column:
    """ASCII only, lower case, no punctuation: what the density test looks at."""
    return delete_chars(to_lower(strip_non_ascii(c)))


def clean_spacing(c: Column, max_length: int = MAX_TEXT) -> Column:
    return truncate_words(strip_urls(squeeze_spaces(c)), max_length)
