"""Queries of the general data-preparation operators: nested records (p4) and quantities (p5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested as N
from ..operators import units as U
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, N.Plan]:
    records = table(spark, d, "registros")
    return records, N.relations(N.schema_graph(records, "payload", N.CASE_SHAPE))


@query
def p4_graph(spark: SparkSession, d: str) -> DataFrame:
    return N.schema_graph(table(spark, d, "registros"), "payload", N.CASE_SHAPE)


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """A redelivered record gives the same rows again; they are distinct by (record, list, parent, position)."""
    records, plan = _records(spark, d)
    return N.shred(records, "payload", "registro_id", plan, N.CASE_SHAPE, N.CASE_SHAPE.lists, values=False).distinct()


@query
def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every element of every table of the plan, with its keys; valor is a JSON object of the columns it takes in."""
    records, plan = _records(spark, d)
    rows = N.shred(records, "payload", "registro_id", plan, N.CASE_SHAPE)
    valor = F.to_json(F.map_from_entries(F.sort_array(F.map_entries("valor"))))
    return rows.select("registro_id", F.col("lista").alias("tabla"), "clave", "padre_tabla", "padre_clave", "pos", valor.alias("valor")).distinct()


@query
def p4_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Records that give no row, with the reason."""
    return N.rejects(table(spark, d, "registros"), "payload", "registro_id", N.CASE_SHAPE)


ORACLES["p4_rejected"] = """SELECT DISTINCT registro_id, CASE WHEN payload IS NULL THEN 'nulo' WHEN trim(payload) = '' THEN 'vacío' WHEN NOT json_valid(payload) THEN 'incompleto' ELSE 'sin objeto' END AS motivo
  FROM registros WHERE payload IS NULL OR CASE WHEN json_valid(payload) THEN json_type(payload) NOT IN ('OBJECT', 'ARRAY', 'VARCHAR') ELSE true END"""


# the same by a recursive query of one step a level: a text that holds JSON is opened, a list's elements are those of an array, of numbered keys,
# of keys that name phases, or the value itself
_OPENED = "CASE WHEN json_type({0}) = 'VARCHAR' AND regexp_full_match(trim({0}->>'$'), '[\\[{{].*[\\]}}]', 's') AND json_valid({0}->>'$') THEN CAST({0}->>'$' AS JSON) ELSE {0} END"
_LISTS = "('transcripcion', 'dialogos', 'medicamentos', 'diagnosticos_secundarios', 'sintomas')"
_TABLE = f"k IN {_LISTS}"
_INSIDE = "((k = 'dialogos' AND o = 'transcripcion') OR (k = 'medicamentos' AND o = 'diagnosticos_secundarios'))"
_PHASE = _OPENED.format("json_extract(c, '/' || x)")
_ELEMENTS = f"""WITH RECURSIVE r AS (SELECT DISTINCT registro_id, CAST(payload AS JSON) AS j FROM registros WHERE json_valid(payload)),
 t AS (SELECT registro_id, {_OPENED.format('j')} AS v, '' AS path, 'caso' AS o, -1 AS op, 'caso' AS tabla, '' AS clave, CAST(NULL AS VARCHAR) AS lista, CAST(NULL AS VARCHAR) AS padre_lista, CAST(NULL AS INTEGER) AS padre_pos,
    CAST(NULL AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS padre_tabla, CAST(NULL AS VARCHAR) AS padre_clave FROM r
  UNION ALL
  SELECT registro_id, {_OPENED.format('e.e')}, e.path, CASE WHEN {_TABLE} THEN k ELSE o END, CASE WHEN {_TABLE} THEN e.p ELSE op END, CASE WHEN {_TABLE} THEN k ELSE tabla END, CASE WHEN {_TABLE} THEN e.path ELSE clave END,
    CASE WHEN {_TABLE} THEN k END, CASE WHEN {_INSIDE} THEN o ELSE 'caso' END, CASE WHEN {_INSIDE} THEN op ELSE -1 END, e.p, tabla, clave
  FROM (SELECT registro_id, o, op, tabla, clave, k, unnest(list_transform(CASE
      WHEN k IS NULL OR k NOT IN {_LISTS} THEN [{{'p': -1, 'e': c}}]
      WHEN json_type(c) = 'ARRAY' THEN list_transform(CAST(c AS JSON[]), lambda x, i: {{'p': CAST(i - 1 AS INTEGER), 'e': x}})
      WHEN json_type(c) = 'OBJECT' AND len(json_keys(c)) = 0 THEN []
      WHEN json_type(c) = 'OBJECT' AND list_bool_and(list_transform(json_keys(c), lambda x: regexp_full_match(x, '[0-9]+'))) THEN list_transform(json_keys(c), lambda x: {{'p': CAST(x AS INTEGER), 'e': json_extract(c, '/' || x)}})
      WHEN json_type(c) = 'OBJECT' AND k = 'transcripcion' AND NOT list_has_any(json_keys(c), ['fase', 'dialogos']) THEN list_transform(json_keys(c), lambda x, i: {{'p': CAST(i - 1 AS INTEGER), 'e':
        CASE WHEN list_has_any(json_keys({_PHASE}), ['fase']) THEN {_PHASE} WHEN list_has_any(json_keys({_PHASE}), ['dialogos']) THEN json_merge_patch(json_object('fase', x), {_PHASE})
          ELSE json_object('fase', x, 'dialogos', json_extract(c, '/' || x)) END}})
      WHEN json_type(c) = 'VARCHAR' AND c->>'$' = '' THEN []
      ELSE [{{'p': 0, 'e': c}}] END, lambda y: {{'p': y.p, 'e': y.e, 'path': CASE WHEN {_TABLE} THEN path || '/' || y.p ELSE path END}})) AS e
    FROM (SELECT registro_id, o, op, tabla, clave, u.k AS k, u.path AS path, {_OPENED.format('u.c')} AS c FROM (SELECT registro_id, o, op, tabla, clave, unnest(CASE json_type(v)
        WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda x: {{'k': x, 'c': json_extract(v, '/' || replace(replace(x, '~', '~0'), '/', '~1')), 'path': path || '/' || replace(replace(x, '~', '~0'), '/', '~1')}})
        WHEN 'ARRAY' THEN list_transform(CAST(v AS JSON[]), lambda x, i: {{'k': CAST(NULL AS VARCHAR), 'c': x, 'path': path || '/' || (i - 1)}}) ELSE [] END) AS u FROM t)))
  WHERE json_type(e.e) <> 'NULL' AND ({_TABLE} OR json_type(e.e) IN ('OBJECT', 'ARRAY')))"""
_CODED = "cie10 nombre snomed_ct snomed_termino"
_COLUMNS = {"transcripcion": "fase", "dialogos": "audio_tag rol texto", "medicamentos": "atc dosis indicacion nombre posologia", "diagnosticos_secundarios": _CODED, "sintomas": _CODED}
ORACLES["p4_found"] = f"{_ELEMENTS} SELECT DISTINCT registro_id, lista, padre_lista, padre_pos, pos FROM t WHERE lista IS NOT NULL"
for _lista, _names in _COLUMNS.items():
    _values = ", ".join(f"CASE WHEN json_type(v) = 'OBJECT' THEN v->>'$.{n}' END AS {n}" for n in _names.split())
    ORACLES[f"p4_{_lista}"] = f"{_ELEMENTS} SELECT DISTINCT registro_id, clave, padre_tabla, padre_clave, padre_lista, padre_pos, pos, {_values}, CASE WHEN json_type(v) <> 'OBJECT' THEN v->>'$' END AS valor FROM t WHERE lista = '{_lista}'"


def _flat(lista: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        records, plan = _records(spark, d)
        return N.flat_table(N.shred(records, "payload", "registro_id", plan, N.CASE_SHAPE, (lista,)), plan, lista, "registro_id").distinct()

    return run


for _lista in (N.ROOT, *N.CASE_SHAPE.lists):
    QUERIES[f"p4_{_lista}"] = _flat(_lista)


@query
def p5_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every amount in the common unit of its magnitude."""
    units = table(spark, d, "unidades")
    v = U.vitals_in_common_units(table(spark, d, "constantes"), units)
    m = U.doses_in_common_units(table(spark, d, "medicaciones"), units)
    columns = ["magnitud", "valor", "dicha", "unidad_id", "comun", "juicio", "posterior", "incierto"]
    return v.select(F.lit("constantes").alias("tabla"), F.col("lectura_id").alias("fila_id"), *columns).unionByName(m.select(F.lit("medicaciones").alias("tabla"), F.col("medicacion_id").alias("fila_id"), *columns))


@query
def p5_unread(spark: SparkSession, d: str) -> DataFrame:
    """Rows that have no place in ``p5_amounts``, with the reason: with it they are all rows of both tables."""
    units = table(spark, d, "unidades")
    v = U.unread_vitals(table(spark, d, "constantes"), units).select(F.lit("constantes").alias("tabla"), F.col("lectura_id").alias("fila_id"), "motivo")
    return v.unionByName(U.unread_doses(table(spark, d, "medicaciones"), units).select(F.lit("medicaciones").alias("tabla"), F.col("medicacion_id").alias("fila_id"), "motivo"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    common = [r.unidad_id for r in table(spark, d, "unidades").filter("es_comun").select("unidad_id").collect()]
    return p5_amounts(spark, d).filter(~F.col("unidad_id").isin(*common)).select("tabla", "fila_id", "unidad_id").distinct()
