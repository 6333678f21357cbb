"""Figures of a collection, and the summary document made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded
from .codes import distinct_codes


def totals(cases: DataFrame, turns: DataFrame, size: Column | None = None) -> DataFrame:
    """One row: cases, specialties as written, turns, characters. ``size``: the length of the text of turns that come without it."""
    size = F.length("texto").cast("long") if size is None else size
    c = cases.agg(F.count("*").alias("n_cases"), F.countDistinct("especialidad").alias("n_especialidades"))
    t = turns.agg(F.count("*").alias("n_turns"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_chars"))
    return side_by_side(c, t)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """The columns of several one-row tables as one row, without a join."""
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r, allowMissingColumns=True)
    return whole.agg(*(F.first(c, ignorenulls=True).alias(c) for c in whole.columns))


def by_specialty(cases: DataFrame) -> DataFrame:
    """Cases by specialty as written: total, common, rare. A null es_rara is neither."""
    rara = F.col("diagnostico_principal.es_rara")
    return cases.groupBy("especialidad").agg(F.count("*").alias("total"), F.count_if(~rara).alias("comunes"), F.count_if(rara).alias("raras"))


def canonical_specialty(especialidad):
    """The specialty without case, accents, blanks and the words of a unit before it."""
    return F.regexp_replace(folded(especialidad), r"^(servicio|serv\.?|consulta|unidad)( de)? ", "")


def validation_sources(cases: DataFrame) -> DataFrame:
    """Distinct sources, without the note after `` - ``."""
    s = cases.select(F.explode("validacion.fuentes_validacion").alias("s"))
    return s.select(F.split("s", " - ", 2)[0].alias("fuente")).distinct()


def summary_document(cases: DataFrame, turns: DataFrame, codes: DataFrame, size: Column | None = None) -> DataFrame:
    """One row, ``document``: the summary as nested JSON with specialty names as keys, in their order. Specialties are few by nature."""
    t = totals(cases, turns, size)
    s = by_specialty(cases).filter("especialidad is not null").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("especialidad", F.struct("total", "comunes", "raras").alias("v"))))).alias("especialidades"))
    k = distinct_codes(codes).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("system", "n_codes")))).alias("k"))
    one = side_by_side(t, s, k)
    doc = F.struct(
        F.col("n_cases").alias("total_transcripciones"),
        F.col("n_especialidades").alias("total_especialidades"),
        F.col("n_turns").alias("total_dialogos"),
        F.col("n_chars").alias("total_caracteres"),
        F.struct(*(F.col("k")[s].alias(f"{s}_unicos") for s in ("cie10", "snomed_ct", "atc"))).alias("estadisticas_codigos"),
        F.col("especialidades"),
    )
    return one.select(F.to_json(doc).alias("document"))


def sizes_mb(sizes: DataFrame, column: str = "n_bytes") -> DataFrame:
    """Files, total and mean size in MB with one decimal, halves to even. No file: 0 files and null sizes."""
    mb = F.col(column) / F.lit(1048576.0)
    return sizes.agg(F.count(column).alias("n_files"), F.bround(F.sum(mb), 1).alias("total_mb"), F.bround(F.avg(mb), 1).alias("mean_mb"))
