"""Text predicates and clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when trimming.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Accepted shapes of ids and names.
BASE58 = r"^[1-9A-HJ-NP-Za-km-z]+\z"
IDENTIFIER = r"^[A-Za-z0-9_.:-]+\z"

_HTTP_URL = (
    r"(?i)^https?://"
    r"(?:[^/?#@\s]*@)?"
    r"(?:(?:\[[0-9a-f:.]+\]|[^/?#@\s:\[\]<>\"%\\^`{|}]+)(?::[0-9]*)?|:[0-9]*)"
    r"(?:[/?#].*)?\z"
)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_base58(c: Column) -> Column:
    return strip(c).rlike(BASE58)


def is_identifier(c: Column) -> Column:
    return c.rlike(IDENTIFIER)


def is_http_url(c: Column) -> Column:
    """http or https with a non-empty host, whole escapes and no control characters."""
    url = strip(c)
    path = F.regexp_extract(url, r"(?s)^[^:]*://[^/?#]*([^?#]*)", 1)
    return (
        url.rlike(_HTTP_URL)
        & ~url.rlike(r"[\x00-\x1f\x7f]")
        & ~path.rlike(r"%(?![0-9A-Fa-f]{2})")
    )


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def to_double(c: Column) -> Column:
    """Plain decimal text, inf or nan as a double; anything else is missing."""
    text = strip(c)
    plain = text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    named = text.rlike(r"(?i)^[+-]?(?:inf|infinity|nan)\z")
    value = text.try_cast("double")
    overflow = plain & (F.abs(value) == F.lit(float("inf")))
    return F.when((plain | named) & ~overflow, value)


def sanitize_stage(c: Column) -> Column:
    """Lower-case stage label limited to letters, digits, '_' and '-'."""
    text = strip(F.lower(c))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("unknown")).otherwise(
        F.regexp_replace(text, r"[^a-z0-9_-]", "_")
    )


def blank_default(c: Column, fallback: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(fallback)).otherwise(c)
