"""Identifiers as people write them, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(c: Column) -> Column:
    """Upper case without any white space, zero-width characters included."""
    return F.upper(F.regexp_replace(c, r"[\s ​﻿]+", ""))


def canonical_patient(c: Column) -> Column:
    """One form for all writings of a patient id; null where nothing is left.

    Letter case, white space, a separator after the letters and a specimen word at the end don't matter.
    Any other suffix, such as a time point, makes another patient.
    """
    bare = F.regexp_replace(squeezed(c), r"_(TUMOU?RS?|ORGANOIDS?)$", "")
    return F.nullif(F.regexp_replace(bare, r"^([A-Z]+)[-_]+([0-9])", "$1$2"), F.lit(""))


def canonical_donor(c: Column) -> Column:
    """One form for all writings of a donor code; null for placeholders: no digits, or zeros only."""
    bare = F.regexp_replace(squeezed(c), r"[^A-Z0-9]", "")
    digits = F.ltrim(F.regexp_extract(bare, r"([0-9]+)$", 1), F.lit("0"))
    return F.when(digits != "", F.concat(F.regexp_extract(bare, r"^([A-Z]*)", 1), F.lit("-"), digits))
