"""Names, codes and headers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of legal forms that a name is compared without.
LEGAL_WORDS = ("PVT", "PRIVATE", "LTD", "LIMITED", "LLP", "INC", "CO", "COMPANY", "CORP", "CORPORATION", "THE", "PLC", "P", "L", "ENTERPRISES", "ENTERPRISE")
# Words that say nothing about who a party is.
NAME_STOPWORDS = ("A", "AN", "AND", "M", "MEDICAL", "HEALTHCARE", "HOSPITAL", "OF", "P", "PRIVATE", "S", "SCIENCE", "SERVICES", "THE", "UNIT", "INSTITUTE", "LIMITED")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def first_value(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*map(blank_to_null, columns))


def header_key(c: Column) -> Column:
    """A header as a key: without byte-order mark, lower case, everything but letters and digits one underscore."""
    plain = F.lower(F.replace(c, F.lit("﻿"), F.lit("")))
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_name(c: Column) -> Column:
    spelt = F.replace(F.upper(c), F.lit("&"), F.lit(" AND "))
    return F.trim(F.regexp_replace(F.regexp_replace(spelt, "[^A-Z0-9 ]", " "), " +", " "))


def core_name(c: Column) -> Column:
    """The normalised name without words of legal forms, unless nothing else is left."""
    whole = normalize_name(c)
    words = F.filter(F.split(whole, " "), lambda w: ~w.isin(*LEGAL_WORDS))
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), whole)


def compact_name(c: Column) -> Column:
    return F.replace(core_name(c), F.lit(" "), F.lit(""))


def normalize_code(c: Column) -> Column:
    return F.upper(F.translate(c, " \t\n\x0b\f\r", ""))


def split_list(c: Column) -> Column:
    parts = F.transform(F.split(c, "[;,|/]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def initialism(c: Column) -> Column:
    """Initials of the core name's words that say something, null below three."""
    words = F.filter(F.split(core_name(c), " "), lambda w: ~w.isin(*NAME_STOPWORDS))
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.length(initials) >= 3, initials)


def mask_identifier(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 5), F.lit("****"), F.substring(c, 10, 1))


def client_id(pan: Column, name: Column) -> Column:
    """Twenty hexadecimal digits of the digest of the PAN, else of the core name."""
    return F.substring(F.sha2(F.coalesce(blank_to_null(pan), core_name(name)), 256), 1, 20)


# The identifiers' formats.
PAN, TAN = "^[A-Z]{5}[0-9]{4}[A-Z]$", "^[A-Z]{4}[0-9]{5}[A-Z]$"
GSTIN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"


def is_pan(c: Column) -> Column:
    return c.rlike(PAN)


def is_tan(c: Column) -> Column:
    return c.rlike(TAN)


def is_gstin(c: Column) -> Column:
    return c.rlike(GSTIN)


def pan_status(c: Column) -> Column:
    given = blank_to_null(c)
    return F.when(given.isNull(), "NOT_PROVIDED").when(is_pan(F.upper(given)), "FORMAT_VALID_UNVERIFIED").otherwise("FORMAT_INVALID")
