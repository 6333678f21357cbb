"""Scalar text functions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"\[([^\]]+)\]"


def leading_tag(texto: Column) -> Column:
    """The stage direction a text begins with, without brackets; null if none."""
    t = F.regexp_extract(texto, "^" + TAG, 1)
    return F.when(t != "", t)


def tags(texto: Column) -> Column:
    return F.regexp_extract_all(texto, F.lit(TAG), 1)


def without_tags(texto: Column) -> Column:
    return F.trim(F.regexp_replace(texto, r"\s*" + TAG + r"\s*", " "))


def prefix(texto: Column, n: int = 500) -> Column:
    return F.left(texto, F.lit(n))


def semantic_tag(term: Column) -> Column:
    """``disorder`` of ``… (disorder)``; null if the term ends in no bracket."""
    t = F.regexp_extract(term, r"\(([^()]*)\)$", 1)
    return F.when(t != "", t)


def folded(text: Column) -> Column:
    """Lower case without accents, invisible characters or surplus blanks, for comparing what was written in several ways."""
    plain = F.translate(F.lower(text), "áéíóúüñàèìòùâêîôûçäëïö", "aeiouunaeiouaeioucaeio")
    seen = F.regexp_replace(plain, r"[\p{M}\p{Cf}]", "")
    return F.trim(F.regexp_replace(seen, r"[\s\u00a0\u2000-\u200a\u202f\u3000]+", " "))


def age_years(edad: Column, unidad: Column) -> Column:
    """Years from an age that may be in months."""
    return F.when(unidad == "meses", edad / F.lit(12.0)).otherwise(edad.cast("double"))


def bmi(peso_kg: Column, talla_cm: Column) -> Column:
    return peso_kg / F.pow(F.try_divide(talla_cm, F.lit(100.0)), F.lit(2.0))
