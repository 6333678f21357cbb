"""Queries of this subpackage's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, level, mix, sample, split, terms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# --- 3: oversized items


def _limits(spark: SparkSession, d: str) -> dict[str, tuple[int, int]]:
    """The limits by kind of item; a kind without one is not cut."""
    return {"dialogo": split.NO_LIMIT, "turno": split.NO_LIMIT} | split.limits(table(spark, d, "limites"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The items that were cut."""
    turns, by = table(spark, d, "turnos").select("case_id", "seq", "texto"), _limits(spark, d)
    dialogues = split.split_dialogues(turns, *by["dialogo"]).select("case_id", F.lit(-1).alias("seq"))
    single = split.split_texts(turns, *by["turno"], ("case_id", "seq"), values=False).select("case_id", "seq")
    return dialogues.unionByName(single).distinct()


@query
def p3_dialogue_pieces(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "turnos").select("case_id", "seq", "texto")
    return split.piece_texts(turns, split.split_dialogues(turns, *_limits(spark, d)["dialogo"]))


@query
def p3_turn_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(table(spark, d, "turnos"), *_limits(spark, d)["turno"], ("case_id", "seq"))


# --- 6: token ids


@query
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id")


@query
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_counts(table(spark, d, "documents"), "doc_id", keep=("source",))


# --- 8: reading level


def _levels(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = level.fitted(level.labelled(documents, table(spark, d, "niveles_muestra"))) or level.fitted(level.seeded(documents)) or level.train([])
    return level.levels(documents, model, keep=keep)


@query
def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d, "source", "lang")


@query
def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return level.profile(_levels(spark, d, "source"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "niveles_muestra").select("doc_id").distinct()
    new = _levels(spark, d, "lang").filter(level.spanish(F.col("lang")) & (F.col("n_words") >= 60) & F.col("nivel").isNotNull())
    return new.join(known, "doc_id", "left_anti").select("doc_id", "nivel")


# --- 7: mixtures


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = bpe.token_counts(table(spark, d, "documents"), "doc_id", keep=("source",))
    return mix.mix(sizes, table(spark, d, "mezcla"))


@query
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].select("mezcla_id", "doc_id", "usos")


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources that stay short though every document is used as often as allowed."""
    return _mix(spark, d)[1].filter("corto and tokens < objetivo").select("mezcla_id", "source").distinct()


# --- 2: samples by quota


@query
def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    signed, wanted, _ = sample.solve(table(spark, d, "casos"), table(spark, d, "cuotas"))
    return sample.draw(signed, wanted).select("plan_id", "id")


@query
def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return sample.solve(table(spark, d, "casos"), table(spark, d, "cuotas"))[2]


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The categories that the repaired sample leaves short for want of records."""
    return p2_shares(spark, d).filter("corto").select("plan_id", "categoria").distinct()


# --- 1: free values to a canonical list


@query
def p1_resolved(spark: SparkSession, d: str) -> DataFrame:
    return terms.resolve(table(spark, d, "entradas"), table(spark, d, "terminologia"))


@query
def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return p1_resolved(spark, d).filter("termino_id is null").select("entrada_id", "veredicto")


@query
def p1_similar(spark: SparkSession, d: str) -> DataFrame:
    """The item with the most similar form (name, synonym or foreign term) for every distinct name as typed: the shuffled join alone."""
    left = table(spark, d, "entradas").filter("nombre is not null").select(F.col("nombre").alias("l"), F.col("nombre").alias("text")).distinct()
    forms = terms.form_rows(table(spark, d, "terminologia")).groupBy("form").agg(F.min("k").alias("termino_id"))
    best = terms.similarity_join(left, forms.select(F.col("form").alias("r"), F.col("form").alias("text")), terms.SIMILAR)
    return best.join(forms, best.r == forms.form).select(F.col("l").alias("nombre"), "termino_id", "jaccard")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    entries, listed = table(spark, d, "entradas"), table(spark, d, "terminologia")
    got = terms.resolve(entries.withColumn("entrada_id", F.struct("entrada_id", "nombre")), listed).filter("termino_id is not null")
    names = listed.select("termino_id", F.col("nombre").alias("__n"))
    named = got.select("entrada_id.*", "termino_id").join(names, "termino_id")
    return named.filter(~F.col("nombre").eqNullSafe(F.col("__n"))).select("entrada_id", "termino_id").distinct()
