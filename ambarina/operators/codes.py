"""Coded entities of cases as relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C

LISTS = {"diagnosticos_secundarios": ("cie10", "snomed_ct"), "sintomas": ("cie10", "snomed_ct"), "procedimientos": ("snomed_ct",), "medicamentos": ("atc", "snomed_ct")}


def codes_of(cases: DataFrame, key: str = "id") -> DataFrame:
    """case_id, kind, idx, nombre, system, code, term: a row a code of the principal diagnosis and of whichever lists the table has.

    Null codes are left out; the sentinel ``N/A`` is kept as written (``functions.codes.real`` drops it). Empty lists give no rows.
    """
    parts = []

    def stack(df: DataFrame, kind: str, systems: tuple[str, ...]) -> None:
        pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.col(f"__e.{s}").alias("code")) for s in systems)))
        one = df.select("case_id", "idx", "__e.nombre", F.col("__e.snomed_termino").alias("term"), pairs.alias("__c"))
        parts.append(one.select("case_id", F.lit(kind).alias("kind"), "idx", "nombre", "__c.system", "__c.code", "term").filter("code is not null"))

    if "diagnostico_principal" in cases.columns:
        stack(cases.select(F.col(key).alias("case_id"), F.lit(0).alias("idx"), F.col("diagnostico_principal").alias("__e")), "diagnostico_principal", ("cie10", "snomed_ct"))
    for kind, systems in LISTS.items():
        if kind in cases.columns:
            stack(cases.select(F.col(key).alias("case_id"), F.posexplode(kind).alias("idx", "__e")), kind, systems)
    return reduce(DataFrame.unionByName, parts)


def codes_of_items(items: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """The same relation of items that are rows of a table: case_id, kind, idx, nombre, snomed_termino and a column a system."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.col(s).alias("code")) for s in systems)))
    one = items.select("case_id", "kind", "idx", "nombre", F.col("snomed_termino").alias("term"), pairs.alias("__c"))
    return one.select("case_id", "kind", "idx", "nombre", "__c.system", "__c.code", "term").filter("code is not null")


def distinct_codes(codes: DataFrame) -> DataFrame:
    """Distinct codes and occurrences by system, over all lists."""
    return codes.groupBy("system").agg(F.countDistinct("code").alias("n_codes"), F.count("*").alias("n_occurrences"))


def ambiguous_codes(codes: DataFrame) -> DataFrame:
    """Codes that stand for several terms: a code is no key of a dimension."""
    terms = codes.filter("term is not null").groupBy("system", "code").agg(F.countDistinct("term").alias("n_terms"))
    return terms.filter("n_terms > 1")


def code_dimension(codes: DataFrame) -> DataFrame:
    """The reference list of codes in use: a row for each (system, code, term)."""
    return codes.groupBy("system", "code", "term").agg(F.count("*").alias("n"))


def corrections_of(cases: DataFrame, key: str = "id") -> DataFrame:
    """case_id, old, new of the corrections a case records; they hold within their case only."""
    texts = cases.select(F.col(key).alias("case_id"), F.explode("validacion.correcciones_aplicadas").alias("t"))
    return texts.select("case_id", F.explode(C.corrections(F.col("t"))).alias("p")).select("case_id", "p.old", "p.new")


def apply_corrections(codes: DataFrame, rules: DataFrame) -> DataFrame:
    """Codes with ``corrected``: the new code where the case has a rule for it, else the code itself. Two rules for one code: the smaller new code."""
    one = rules.groupBy("case_id", "old").agg(F.min("new").alias("__new"))
    return codes.join(one, (codes.case_id == one.case_id) & (codes.code == one.old), "left").select(codes["*"], F.coalesce("__new", codes.code).alias("corrected"))
