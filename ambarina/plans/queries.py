"""The core queries by name: each takes (spark, folder of tables) and gives a DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes as C
from ..functions import text as X
from ..operators import codes as K
from ..operators import dialogue as D
from ..operators import manifest as M
from ..operators import packing as P
from ..operators import planning as L
from ..operators import status as S
from ..operators import summary as U
from ..operators import units as V
from ..operators.drift import key_types
from ..schema import CASE
from ..sources import sinks
from ..sources.cases import documents
from ..sources.summary import specialties_of
from ..sources.tables import first_delivery, table, without_redelivery

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ROOT = "/audio"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def turns(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return without_redelivery(table(spark, d, "turnos"), ["case_id", "seq"], list(columns))


def cases(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Cases once each; of a redelivered case the first delivery."""
    t = table(spark, d, "casos")
    return first_delivery(t.select("id", "recibido_en", *columns), ["id"]).drop("recibido_en")


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    """case_id, seq and n, the length of the text, of every turn once."""
    return without_redelivery(table(spark, d, "turnos").withColumn("n", F.length("texto").cast("long")), ["case_id", "seq"], ["n"])


@query
def scan_dialogue_sorted(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d, "rol", "texto").orderBy("case_id", "seq")


@query
def turn_project_voice(spark: SparkSession, d: str) -> DataFrame:
    return D.request_turns(D.with_voice(turns(spark, d, "rol", "texto"), cases(spark, d, "voces")))


@query
def voice_dimension(spark: SparkSession, d: str) -> DataFrame:
    return D.voice_dimension(cases(spark, d, "voces"))


@query
def nest_unnest_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Turns as ordered lists, a list a stretch of a case, and back."""
    nested = P.stretches(table(spark, d, "turnos"), "rol", "texto")
    return nested.select("case_id", F.explode("__t").alias("t")).select("case_id", "t.seq", "t.rol", "t.texto")


@query
def case_measures(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).groupBy("case_id").agg(F.count("*").alias("n_turns"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_chars"))


@query
def route_single_vs_chunked(spark: SparkSession, d: str) -> DataFrame:
    return P.route(case_measures(spark, d))


@query
def turns_by_role(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d, "rol").groupBy("rol").agg(F.count("*").alias("n_turns"))


@query
def turns_by_phase(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d, "fase").groupBy("fase").agg(F.count("*").alias("n_turns"))


@query
def canonical_roles(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d, "rol").groupBy(D.canonical_rol("rol").alias("rol")).agg(F.count("*").alias("n_turns"))


def _read_rol() -> Column:
    """The canonical role; one that has none stays as written, and so has no voice."""
    return F.coalesce(D.canonical_rol("rol"), F.col("rol"))


def _plan(spark: SparkSession, d: str, canonical: bool = False) -> tuple[DataFrame, DataFrame, Column | None]:
    """(cases, turns, role): what status and packing run on. Roles count as written, or as ``_read_rol`` reads them."""
    return cases(spark, d, "audio_file", "diagnostico_principal", "voces"), table(spark, d, "turnos"), _read_rol() if canonical else None


def _status(spark: SparkSession, d: str, canonical: bool = False) -> DataFrame:
    c, t, rol = _plan(spark, d, canonical)
    return L.status(c, L.turn_stretches(t, rol))


def _chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("case_id").agg((F.max("chunk_no") + 1).cast("long").alias("n_chunks"))


def _paths(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    return M.chunk_paths(chunks, cases(spark, d, "audio_file").select(F.col("id").alias("case_id"), M.output_path(ROOT).alias("path")))


@query
def case_status(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d)


@query
def case_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return S.rollup(_status(spark, d))


@query
def case_status_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Which cases the ``*_whole`` queries plan, and why the others fail."""
    return _status(spark, d, True)


# Requests of the cases that ``case_status`` has as success; ``*_whole``: of those of ``case_status_canonical``.


@query
def chunk_pack_dialogue(spark: SparkSession, d: str) -> DataFrame:
    return L.chunks(*_plan(spark, d))


@query
def chunk_pack_dialogue_whole(spark: SparkSession, d: str) -> DataFrame:
    return L.chunks(*_plan(spark, d, True))


@query
def chunk_count_per_case(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_counts(L.chunks(*_plan(spark, d)))


@query
def chunk_count_per_case_whole(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_counts(L.chunks(*_plan(spark, d, True)))


@query
def chunk_pack_lines(spark: SparkSession, d: str) -> DataFrame:
    return P.pack_lines(table(spark, d, "documents"), "doc_id").withColumnRenamed("n_turns", "n_lines")


@query
def chunk_paths(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d, L.chunks(*_plan(spark, d)))


@query
def chunk_paths_whole(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d, L.chunks(*_plan(spark, d, True)))


@query
def concat_filelist(spark: SparkSession, d: str) -> DataFrame:
    return M.file_lists(chunk_paths(spark, d))


@query
def concat_filelist_whole(spark: SparkSession, d: str) -> DataFrame:
    return M.file_lists(chunk_paths_whole(spark, d))


@query
def request_manifest(spark: SparkSession, d: str) -> DataFrame:
    return L.requests(*_plan(spark, d))


@query
def request_manifest_whole(spark: SparkSession, d: str) -> DataFrame:
    return L.requests(*_plan(spark, d, True))


@query
def output_paths(spark: SparkSession, d: str) -> DataFrame:
    p = M.output_path(ROOT)
    return cases(spark, d, "audio_file").select("id", p.alias("path"), M.folder(p).alias("folder"), M.list_path(p).alias("list_file"))


@query
def error_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.prefix(F.col("text"), 500).alias("prefix"))


@query
def size_kb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", M.kilobytes(F.octet_length("text")).alias("kb"))


@query
def size_totals_mb(spark: SparkSession, d: str) -> DataFrame:
    return U.sizes_mb(table(spark, d, "documents").select(F.octet_length("text").alias("n_bytes")))


@query
def summary_totals(spark: SparkSession, d: str) -> DataFrame:
    return U.totals(cases(spark, d, "especialidad"), _lengths(spark, d), F.col("n"))


@query
def summary_by_specialty(spark: SparkSession, d: str) -> DataFrame:
    return U.by_specialty(cases(spark, d, "especialidad", "diagnostico_principal"))


@query
def summary_by_canonical_specialty(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d, "especialidad", "diagnostico_principal")
    return U.by_specialty(c.withColumn("especialidad", U.canonical_specialty(F.col("especialidad"))))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of all five lists: those of the cases, and of the items in ``entradas`` and ``medicaciones``, each item once."""
    item = ["case_id", "idx", "nombre", "snomed_ct", "snomed_termino", "recibido_en"]
    e = table(spark, d, "entradas").filter(F.col("lista").isin("diagnosticos_secundarios", "sintomas"))
    e = first_delivery(e.select("entrada_id", "lista", "cie10", *item), ["entrada_id"]).withColumnRenamed("lista", "kind")
    m = first_delivery(table(spark, d, "medicaciones").select("medicacion_id", "atc", *item), ["medicacion_id"]).withColumn("kind", F.lit("medicamentos"))
    own = K.codes_of(cases(spark, d, "diagnostico_principal", "procedimientos"))
    return own.unionByName(K.codes_of_items(e, K.LISTS["sintomas"])).unionByName(K.codes_of_items(m, K.LISTS["medicamentos"]))


@query
def codes_relation(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d)


@query
def distinct_codes_by_system(spark: SparkSession, d: str) -> DataFrame:
    return K.distinct_codes(_codes(spark, d))


@query
def code_frequency(spark: SparkSession, d: str) -> DataFrame:
    return K.code_dimension(_codes(spark, d))


@query
def ambiguous_codes(spark: SparkSession, d: str) -> DataFrame:
    return K.ambiguous_codes(_codes(spark, d))


@query
def code_shape_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entradas").select("entrada_id", "cie10", "snomed_ct").distinct()
    return e.select("entrada_id", C.well_formed(F.col("cie10"), "cie10").alias("cie10_ok"), C.well_formed(F.col("snomed_ct"), "snomed_ct").alias("snomed_ok"))


@query
def atc_levels(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "medicaciones").select("medicacion_id", "atc").distinct()
    return m.select("medicacion_id", F.posexplode(C.atc_codes(F.col("atc"))).alias("pos", "code")).select("medicacion_id", "pos", "code", C.atc_level(F.col("code")).alias("level"))


@query
def semantic_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "terminologia").select("termino_id", X.semantic_tag(F.col("snomed_termino")).alias("tag"))


@query
def validation_sources(spark: SparkSession, d: str) -> DataFrame:
    return U.validation_sources(cases(spark, d, "validacion"))


@query
def correction_pairs(spark: SparkSession, d: str) -> DataFrame:
    return K.corrections_of(cases(spark, d, "validacion"))


@query
def corrected_codes(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d, "validacion", "diagnostico_principal", "procedimientos")
    return K.apply_corrections(K.codes_of(c), K.corrections_of(c)).select("case_id", "kind", "idx", "system", "code", "corrected")


@query
def notes_unnest(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d, "notas_adicionales").select("id", F.posexplode("notas_adicionales").alias("pos", "nota"))


@query
def voices_unnest(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d, "voces").select("id", F.explode("voces").alias("key", "voice_id"))


@query
def age_in_years(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d, "paciente")
    return c.select("id", F.round(X.age_years(F.col("paciente.edad"), F.col("paciente.edad_unidad")), 4).alias("years"))


@query
def rare_cases(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d, "diagnostico_principal").filter("diagnostico_principal.es_rara").select("id", F.col("diagnostico_principal.nombre").alias("nombre"))


@query
def specialty_mismatch(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d, "especialidad", "medico").withColumn("a", U.canonical_specialty(F.col("especialidad"))).withColumn("b", U.canonical_specialty(F.col("medico.especialidad")))
    return c.filter("a <> b").select("id", "a", "b")


@query
def tag_extract(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turnos").withColumns({"tag": X.leading_tag(F.col("texto")), "n_tags": F.size(X.tags(F.coalesce("texto", F.lit("")))).cast("long")})
    return without_redelivery(t, ["case_id", "seq"], ["tag", "n_tags"])  # after the tags are read, so that no text is shuffled


@query
def tag_frequency(spark: SparkSession, d: str) -> DataFrame:
    t = without_redelivery(table(spark, d, "turnos").withColumn("tag", X.leading_tag(F.col("texto"))), ["case_id", "seq"], ["tag"])
    return t.groupBy("tag").agg(F.count("*").alias("n")).filter("tag is not null")


@query
def json_field_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query
def body_mass_index(spark: SparkSession, d: str) -> DataFrame:
    """From peso and talla in the common units (kg, cm), however they are written; of each the first reading by lectura_id.

    Amounts that are not positive are no readings. ``incierto``: the unit of either reading is uncertain.
    """
    c = table(spark, d, "constantes").filter("nombre in ('peso', 'talla')")
    read = V.vitals_in_common_units(c, table(spark, d, "unidades")).filter("comun > 0")
    v = read.join(c.select("lectura_id", "case_id").distinct(), "lectura_id")
    first = v.groupBy("case_id").pivot("clase", ["peso", "talla"]).agg(F.min_by(F.struct("comun", "incierto"), "lectura_id"))
    both = first.filter("peso is not null and talla is not null")
    return both.select("case_id", F.bround(X.bmi(F.col("peso.comun"), F.col("talla.comun")), 3).alias("imc"), (F.col("peso.incierto") | F.col("talla.incierto")).alias("incierto"))


@query
def pressure_names_joined(spark: SparkSession, d: str) -> DataFrame:
    """Readings under one name for each pressure, whichever of the two names was used."""
    v = table(spark, d, "constantes").select("lectura_id", "nombre").distinct()
    return v.groupBy(F.regexp_replace("nombre", "^(tension|presion)_arterial_", "presion_arterial_").alias("nombre")).agg(F.count("*").alias("n"))


@query
def misspelt_unit_key(spark: SparkSession, d: str) -> DataFrame:
    """Units recovered from the misspelt column."""
    v = table(spark, d, "constantes").select("lectura_id", "unidad", "unitem").distinct()
    return v.filter("unidad is null and unitem is not null").select("lectura_id", F.col("unitem").alias("unidad"))


@query
def summary_document(spark: SparkSession, d: str) -> DataFrame:
    return U.summary_document(cases(spark, d, "especialidad", "diagnostico_principal"), _lengths(spark, d), _codes(spark, d), F.col("n"))


@query
def summary_keys_as_rows(spark: SparkSession, d: str) -> DataFrame:
    """The specialties of the summary document, read back from its text."""
    return specialties_of(summary_document(spark, d), "document")


@query
def centre_load(spark: SparkSession, d: str) -> DataFrame:
    """Turns and characters by centre (the skewed key), with the centre's name; the hot centre is pre-aggregated before its shuffle."""
    t = without_redelivery(table(spark, d, "turnos").withColumn("n", F.length("texto").cast("long")), ["case_id", "seq"], ["centro_id", "n"])
    by = t.groupBy("centro_id").agg(F.count("*").alias("n_turns"), F.sum("n").alias("n_chars"))
    return by.join(table(spark, d, "centros"), "centro_id", "left").select("centro_id", "nombre", "n_turns", "n_chars")


# Documents: the payloads of ``registros``, each a whole document in one row.


def _documents(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """registro_id and fields of every record once; what is written otherwise than the schema has it is null."""
    r = table(spark, d, "registros").select("registro_id", "payload").distinct()
    return documents(r, "payload", T.StructType([f for f in CASE if f.name in fields]))


@query
def document_status(spark: SparkSession, d: str) -> DataFrame:
    """Of every record one row: whether its document can be voiced as it is written, and the first thing that stops it."""
    docs = documents(table(spark, d, "registros").select("registro_id", "payload").distinct(), "payload")
    return docs.select("registro_id", S.nested_reason().alias("reason")).withColumn("status", F.when(F.col("reason").isNull(), S.OK).otherwise(S.FAILED))


@query
def document_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of the documents that hold phases and dialogues as lists, two levels down."""
    t = D.turns_of(_documents(spark, d, "transcripcion"), "registro_id")
    return t.select(F.col("case_id").alias("registro_id"), "phase_idx", "fase", "turn_idx", "seq", "rol", "texto")


@query
def document_vitals(spark: SparkSession, d: str) -> DataFrame:
    """The entries of the vitals map of every document: open keys to rows."""
    v = _documents(spark, d, "constantes_vitales")
    return v.select("registro_id", F.explode("constantes_vitales").alias("nombre", "v")).select("registro_id", "nombre", "v.valor", "v.unidad")


@query
def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    """The keys at the top of the documents with the type of their value, and whether the schema has them so."""
    return key_types(table(spark, d, "registros").select("registro_id", "payload").distinct(), "payload")


@query
def file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records to process by sender, each once."""
    r = table(spark, d, "registros").select("registro_id", "remitente").distinct()
    return r.groupBy("remitente").agg(F.count("*").alias("n"))


# A run's answers: ``events`` stands for a log of calls, the case being the user, the chunk the event in order, and the status 200 but for
# some values of ``k``.


def _answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k % 10 == 3, 500).when(k % 10 == 7, 201).when(k % 25 != 4, 200)
    return e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("chunk_no"), status.alias("http_status"))


@query
def response_success(spark: SparkSession, d: str) -> DataFrame:
    """Calls by whether they succeeded: exactly 200, no other and no missing status."""
    return _answers(spark, d).groupBy("http_status", S.succeeded("http_status").alias("ok")).agg(F.count("*").alias("n"))


@query
def chunk_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What became of each chunk: the first failure ends its case, later chunks are not attempted."""
    return S.chunk_outcome(_answers(spark, d))


@query
def run_rollup(spark: SparkSession, d: str) -> DataFrame:
    return S.rollup(S.chunk_outcome(_answers(spark, d)).select("case_id", "status").distinct())


@query
def concat_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Joining parts: cases by chunks and what the tool did (of the last answer), with status, detail and whether the parts are removed."""
    tool = F.element_at(F.array(*map(F.lit, ("ok", "error", "absent", "timeout"))), (F.pmod(F.col("n_chunks") + F.col("case_id"), F.lit(4)) + 1).cast("int"))
    runs = _answers(spark, d).groupBy("case_id").agg(F.count("*").alias("n_chunks")).withColumn("tool", tool)
    return S.concat_outcome(runs)


@query
def send_requests(spark: SparkSession, d: str) -> DataFrame:
    """The plan of ``request_manifest_whole`` sent to a call that answers by the length of the payload, without a network: one row a request."""

    def call(payload: str) -> tuple[int, bytes]:
        n = len(payload)
        if n % 11 == 0:
            raise TimeoutError("no answer")
        return (200, b"x" * (n % 100)) if n % 7 else (429, b"slow down")

    return sinks.send(request_manifest_whole(spark, d), call)
