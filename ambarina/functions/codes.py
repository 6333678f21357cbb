"""Codes of the three systems: shapes, sentinels, levels, corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of codes, and the length of an ATC code by level.
SHAPES = {"cie10": r"^[A-Z][0-9]{2}(\.[0-9A-Z]{1,2})?$", "snomed_ct": r"^[1-9][0-9]{5,17}$", "atc": r"^[A-Z]([0-9]{2}([A-Z]([A-Z]([0-9]{2})?)?)?)?$"}
ATC_LEVELS = {1: 1, 3: 2, 4: 3, 5: 4, 7: 5}
_CODE = r"((?:[A-Z]{2,5} )?[A-Z]?[0-9][0-9A-Z.]*)"
ARROW = _CODE + r"\s*→\s*" + _CODE


def real(code: Column) -> Column:
    """The code, or null for the sentinel ``N/A``."""
    return F.nullif(code, F.lit("N/A"))


def well_formed(code: Column, system: str) -> Column:
    return code.rlike(SHAPES[system])


def atc_codes(atc: Column) -> Column:
    """The codes of a field that may hold two, parted by a slash; empty for null or ``N/A``."""
    return F.filter(F.split(F.coalesce(real(atc), F.lit("")), r"\s*/\s*"), lambda x: x != "")


def atc_level(atc: Column) -> Column:
    out = F.lit(None).cast("int")
    for length, level in ATC_LEVELS.items():
        out = F.when(F.length(atc) == length, level).otherwise(out)
    return out


def corrections(text: Column) -> Column:
    """[{old, new}] of the arrows between two codes in a correction; prose around an arrow is no pair."""
    bare = lambda x: F.regexp_replace(x, r"^[A-Z]+ |\.$", "")
    old, new = F.regexp_extract_all(text, F.lit(ARROW), 1), F.regexp_extract_all(text, F.lit(ARROW), 2)
    return F.transform(F.arrays_zip(old.alias("old"), new.alias("new")), lambda p: F.struct(bare(p["old"]).alias("old"), bare(p["new"]).alias("new")))
