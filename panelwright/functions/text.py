"""Column expressions that bring identifiers, names and numbers as typed to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_only_id(c: Column) -> Column:
    """'1923.0' and 1923 to '1923'; what isn't a number to ''."""
    return F.coalesce(c.cast("string").try_cast("double").cast("bigint").cast("string"), F.lit(""))


def lower_alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def upper_alnum(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def subject_id(c: Column, prefix: str) -> Column:
    """The upper-case id that starts with ``prefix`` and digits, with a suffix unless that names a specimen; null if there is none."""
    found = F.regexp_extract(c, rf"(?i)({prefix}[0-9]+(?:_(?!tumou?r|organoids?)[a-z0-9]+)?)", 1)
    return F.nullif(F.upper(found), F.lit(""))


def specimen(c: Column, prefix: str) -> Column:
    """The specimen word after an id, singular and capitalised; null if there is none."""
    return F.nullif(F.initcap(F.regexp_replace(F.lower(F.regexp_extract(c, rf"(?i){prefix}[0-9]+(?:_[a-z0-9]+)*?_(tumou?r|organoids?)", 1)), "s$", "")), F.lit(""))


def label_and_number(c: Column) -> tuple[Column, Column]:
    """'SYMBOL (123)' to its label and number; the whole text and -1 where it isn't written so."""
    label, number = F.regexp_extract(c, r"^(.+?)\s*\(([0-9]+)\)\s*$", 1), F.regexp_extract(c, r"^(.+?)\s*\(([0-9]+)\)\s*$", 2)
    return F.when(label != "", label).otherwise(c), F.coalesce(number.try_cast("bigint"), F.lit(-1).cast("bigint"))


def dose(c: Column) -> Column:
    """The number between two commas of a written tuple; null if there is none."""
    return F.regexp_extract(c, r",\s*([0-9.eE+-]+)\s*,", 1).try_cast("double")


def first_of_many(c: Column) -> Column:
    """The first of several ids parted by commas, as a number; words for nothing give null."""
    return F.trim(F.split(c, ",").getItem(0)).try_cast("double").cast("bigint")


def text_or_null(c: Column) -> Column:
    """Trimmed text; blank and the words for nothing give null."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "nan", "none", "null", "n/a", "-"), t)


def number_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def key_block(c: Column) -> Column:
    """The first block of a structure key, without case, white space and the name before '='."""
    return F.substring(F.regexp_replace(F.upper(F.regexp_replace(c, r"\s+", "")), "^INCHIKEY=", ""), 1, 14)


def bits(c: Column) -> Column:
    """'0101' to [0.0, 1.0, 0.0, 1.0]."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: x.cast("double"))
